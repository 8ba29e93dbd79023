"""Inputs that the given tables do not show: odd headers, ids, numbers, keys and sizes."""

import json
import os
import subprocess
import sys
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from marketframe.functions import scan, storage
from marketframe.functions.schema import context_columns
from marketframe.functions.windows import HALO, check_block
from marketframe.operators import bars as ob, book as bk, history as hs, touch
from marketframe.operators.models import with_weights
from marketframe.sources import book as sb, trades as tr, venue as vn

T0 = datetime(2024, 1, 1)


def test_headers_in_any_order_and_ids_of_any_type(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        "symbol,timestamp,trdMatchID,price,size,side\n"
        "X,1704067200,b7c1-uuid,10,1,Buy\nX,1704067200,a0f3-uuid,12,1,Sell\nX,oops,c-uuid,9,1,Buy\n"
    )
    (tmp_path / "b.csv").write_text("size,price,timestamp,symbol\n2,11,1704067201,Y\n2,,1704067201,Y\n")
    out = tr.read_trade_csv(spark, str(tmp_path))
    got = sorted((r.symbol, r.price, r.size, r.side, r.seq, r.trade_id) for r in out.collect())
    assert got == [
        ("X", 10.0, 1.0, "Buy", None, "b7c1-uuid"),
        ("X", 12.0, 1.0, "Sell", None, "a0f3-uuid"),
        ("Y", 11.0, 2.0, "Buy", None, None),
    ]
    # equal times are ordered by place in the file
    bar = ob.time_bars(out.filter("symbol = 'X'"), "5m", order=("ts", "pos")).first()
    assert (bar.open, bar.close) == (10.0, 12.0)
    named = tr.TradeColumns(timestamp="t", price="p", size="q", id="i")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "c.csv").write_text("i,q,p,t\n7,1,5,1704067200\n")
    row = tr.read_trade_csv(spark, str(tmp_path / "sub"), named).first()
    assert (row.seq, row.price, row.size) == (7, 5.0, 1.0)


def test_files_without_needed_columns_are_named(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("foo,bar\n1,2\n")
    with pytest.warns(UserWarning, match="bad.csv"), pytest.raises(FileNotFoundError):
        tr.read_trade_csv(spark, str(tmp_path))


def test_line_numbers_do_not_depend_on_blocks(spark, tmp_path):
    for name, n in (("a", 700), ("b", 33)):
        rows = [
            "{broken" if i % 10 == 4
            else json.dumps({"type": "delta", "ts": i, "data": {"s": name, "b": [["1", "2"]]}, "seq": 2 * i + 1})
            for i in range(1, n + 1)
        ]
        (tmp_path / f"{name}.jsonl").write_text("\n".join(rows) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        msgs = sb.read_book_lines(spark, str(tmp_path)).collect()
        samples = bk.count_samples(sb.read_book_lines(spark, str(tmp_path)), 50).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    # the sequence is odd only, the line number is what is counted
    assert all(m.seq == 2 * m.line + 1 for m in msgs) and len(msgs) == 630 + 30
    assert sorted(s.seq for s in samples) == [2 * i + 1 for i in range(50, 701, 50)]


def test_malformed_numbers_are_left_out(spark):
    good = {"e": "aggTrade", "s": "X", "p": "1.5", "q": "2", "T": 1, "a": 1, "m": False}
    bad = {**good, "p": "abc"}
    raw = spark.createDataFrame([(json.dumps(good),), (json.dumps(bad),)], "value string")
    assert [r.price for r in tr.normalise_agg_trades(raw).collect()] == [1.5]
    assert sorted(r.route for r in tr.route_events(raw).collect()) == ["bad", "trade"]
    lists = spark.createDataFrame(
        [("X", 0, [["1", "1", "x", "1", "1", "1"], ["zz", "1", "1", "1", "1", "1"]])],
        "symbol string, batch int, list array<array<string>>",
    )
    rows = vn.normalise_klines(lists).collect()
    assert [(r.timestamp, r.open, r.high) for r in rows] == [(1, 1.0, None)]
    levels = spark.createDataFrame([([["1", "2"], ["x", "2"]],)], "l array<array<string>>")
    assert levels.select(sb.sanitise_levels(F.col("l"), True)).first()[0] == [["1", "2"]]


def test_touch_beyond_a_chunk(spark):
    bars = spark.createDataFrame(
        [("X", T0 + timedelta(minutes=i), i, 128, 5.0, 5.0, 5.0 - 4.0 * (i == 90), 5.0) for i in range(128)],
        "symbol string, bar timestamp_ntz, idx long, n long, open double, high double, low double, close double",
    )
    asked = spark.createDataFrame(
        [("X", 1, 96, 2.0, float("inf"))], "symbol string, start long, stop long, floor double, ceiling double"
    )
    for chunk in (16, 128):
        assert touch.first_touch(bars, asked, 95, chunk).first().hit_idx == 90


def test_slow_or_fast_means_are_refused():
    check_block(2 / 10, 1024)
    with pytest.raises(ValueError, match="remembers"):
        check_block(0.001, 1024)
    with pytest.raises(ValueError, match="range of doubles"):
        check_block(0.9, 1024)


def test_context_is_never_a_prefix():
    assert context_columns(["close", "rsi", "x"]) == ["rsi"]
    assert context_columns(["a", "b"], ["b"]) == ["b"]
    with pytest.raises(ValueError):
        context_columns(["a", "b"])


def test_backfill_plans_the_whole_gap(spark):
    bars = spark.createDataFrame([("X", T0)], "symbol string, bar timestamp_ntz")
    now = F.lit((T0 + timedelta(hours=2500)).isoformat()).cast("timestamp_ntz")
    plan = hs.backfill_plan(bars, "1h", now)
    assert plan.count() == 2500 and plan.agg(F.max("request")).first()[0] == 2


def test_repeated_bars_and_changes(spark):
    rows = [("X", T0, 1.0), ("X", T0, 2.0)]
    a = spark.createDataFrame(rows, "symbol string, bar timestamp_ntz, close double")
    b = spark.createDataFrame(rows[::-1], "symbol string, bar timestamp_ntz, close double")
    assert hs.merge_history([a]).collect() == hs.merge_history([b]).collect()
    base = spark.createDataFrame(rows[:1], "symbol string, bar timestamp_ntz, close double")
    assert [r.close for r in hs.update_cells(base, a, ["close"]).collect()] == [2.0]


def test_null_keys_are_keys(spark):
    rows = [(None, T0 + timedelta(hours=i), float(i)) for i in range(5)]
    df = spark.createDataFrame(rows, "symbol string, bar timestamp_ntz, x double")
    assert [r.idx for r in scan.with_row_index(df, "bar").orderBy("bar").collect()] == list(range(5))
    peaks = scan.running_peak(
        df, ["symbol"], F.col("bar").cast("date"), ["bar"], {"s": F.col("x")}, "s"
    )
    assert peaks.count() == 5
    runs = scan.islands(df, ["symbol"], F.floor("x"), "x", lambda a, b: b - a > 2)
    assert [r.island for r in runs.collect()] == [0.0] * 5


def test_weights_come_from_training_rows(spark):
    rows = [(1, False)] + [(0, False)] * 3 + [(1, True)] * 50
    df = spark.createDataFrame(rows, "y int, held_out boolean")
    assert with_weights(df, "y").filter("y = 1").first().weight == 3.0


def test_live_window_is_what_batch_looks_back():
    from marketframe.streaming.bar_close import LIVE_WINDOW

    assert LIVE_WINDOW > HALO


def test_scope_deletes_what_it_wrote(spark):
    with storage.scope():
        df = storage.materialise(spark.range(3), "scoped")
        path = df.inputFiles()[0].removeprefix("file://")
        assert os.path.exists(path) and df.count() == 3
    assert not os.path.exists(os.path.dirname(path))


def test_queries_run_from_another_folder(tmp_path):
    """Executors get the package whatever the driver's working directory."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (
        f"import sys; sys.path.insert(0, {root!r})\n"
        "from pyspark.sql import SparkSession\n"
        "s = (SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false')"
        ".config('spark.sql.shuffle.partitions', '2').getOrCreate())\n"
        "import __spark_entry__ as e\n"
        "print('ROWS', e.queries()['label_barrier'](s, '/root/testdata/sf0.001').count())\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run(
        [sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300
    )
    assert "ROWS" in said.stdout, said.stderr[-2000:]
