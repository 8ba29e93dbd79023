"""Streams replayed from files equal their batch twins."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window, functions as F

from marketframe.operators import bars as ob, book as bk
from marketframe.operators.features import add_features
from marketframe.functions.scan import with_row_index
from marketframe.plans import views as v
from marketframe.streaming import feeds
from marketframe.streaming.bar_close import BarClose
from marketframe.streaming.book_state import stream_book
from marketframe.streaming.silence import stream_silences
from tests.conftest import SF

T0 = datetime(2024, 1, 1)


def source(spark, df, path, parts, order):
    """``df`` written as ``parts`` ordered files, read one file per trigger."""
    rows = df.withColumn("_p", F.ntile(parts).over(Window.orderBy(order)))
    for k in range(1, parts + 1):
        rows.filter(F.col("_p") == k).drop("_p").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(stream, tmp_path, name, mode="append"):
    q = (
        stream.writeStream.format("memory").queryName(name).outputMode(mode)
        .option("checkpointLocation", str(tmp_path / f"ck-{name}")).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return q


def test_book_stream_equals_intervals(spark, tmp_path):
    msgs = v.book_msgs(spark, SF)
    run(stream_book(source(spark, msgs, str(tmp_path / "in"), 4, "seq"), 5), tmp_path, "book_stream")
    cols = ["symbol", "seq", "side", "price", "size"]
    got = sorted(map(tuple, spark.table("book_stream").select(*cols).collect()))
    want = bk.book_at(bk.book_intervals(msgs), bk.count_samples(msgs, 5), 5).select(*cols)
    assert got and got == sorted(map(tuple, want.collect()))


def test_bar_stream_equals_batch(spark, tmp_path):
    trades = v.trades(spark, SF)
    end = trades.agg(F.max("ts")).first()[0] + timedelta(days=2)
    closer = spark.createDataFrame([("zz", end, 10**9, 1.0, 1.0, "Buy")], trades.schema)
    feed = source(spark, trades.unionByName(closer), str(tmp_path / "in"), 3, "seq")
    run(feeds.stream_bars(feed, "1h"), tmp_path, "bar_stream")
    got = spark.table("bar_stream").filter("symbol <> 'zz'")
    want = ob.time_bars(trades, "1h", order=("seq",)).select(*got.columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_repeats_are_dropped(spark, tmp_path):
    rows = [("A", T0 + timedelta(seconds=s), s) for s in (1, 1, 2, 3, 3)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, x int")
    run(feeds.drop_repeats(source(spark, df, str(tmp_path / "in"), 2, "ts"), ["symbol", "ts"], "1 minute"), tmp_path, "rep")
    assert spark.table("rep").count() == 3


def test_rotated_sink_and_alerts(spark, tmp_path):
    trades = v.trades(spark, SF)
    feed = source(spark, trades, str(tmp_path / "in"), 2, "seq")
    out = str(tmp_path / "out")
    feeds.rotate_sink(feeds.rotated(feed, "trade", F.col("ts")), out, str(tmp_path / "ck")).trigger(
        availableNow=True
    ).start().awaitTermination()
    back = spark.read.parquet(out)
    assert back.count() == trades.count()
    assert back.filter("dt <> cast(ts as date)").count() == 0
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.log").write_text("[ERROR] x\nheartbeat\n[ERROR] Connection reset\n")
    lines = spark.readStream.text(str(tmp_path / "logs")).withColumnRenamed("value", "text")
    run(feeds.alert_stream(lines), tmp_path, "alert_stream")
    assert spark.table("alert_stream").count() == 1


def test_silence_timer(spark, tmp_path):
    rows = [("a", T0 + timedelta(seconds=s)) for s in (0, 300, 5000)] + [("b", T0 + timedelta(seconds=s)) for s in range(0, 5001, 500)]
    df = spark.createDataFrame(rows, "service string, ts timestamp_ntz").withColumn("event_time", F.col("ts").cast("timestamp"))
    feed = source(spark, df, str(tmp_path / "in"), 8, "ts")
    run(stream_silences(feed, "service", 600, "1 second"), tmp_path, "quiet")
    got = {(r["key"], r["silent_from"]) for r in spark.table("quiet").collect()}
    zone = spark.range(1).select((F.lit(T0 + timedelta(seconds=300)).cast("timestamp_ntz").cast("timestamp")).alias("t")).first()["t"]
    assert got == {("a", zone)}


def test_bar_close_equals_batch(spark, tmp_path):
    bars = ob.time_bars(v.trades(spark, SF), "1h", order=("seq",)).filter("symbol in ('click', 'view')")
    bars = bars.withColumns({"ob_spread_mean": F.lit(0.1), "processed_at": F.col("bar") + F.expr("interval 3607 seconds")})
    feed = source(spark, bars, str(tmp_path / "in"), 3, "bar")
    sink = BarClose(str(tmp_path / "state"), "1h", groups=("trend", "flow", "regime"))
    feed.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "ck")).trigger(
        availableNow=True
    ).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "state" / "features")).toPandas().set_index(["symbol", "bar"]).sort_index()
    want = add_features(with_row_index(bars, "bar"), ("trend", "flow", "regime")).toPandas().set_index(["symbol", "bar"]).sort_index()
    assert len(got) == len(want)
    for c in ("atr", "rsi", "ema_21_slope", "vol_z", "macro_dist_1d", "atr_regime"):
        assert got[c].to_numpy() == pytest.approx(want[c].to_numpy(), rel=1e-9, abs=1e-9)
    alerts = {r["alert"] for r in spark.read.parquet(str(tmp_path / "state" / "alerts")).select("alert").distinct().collect()}
    assert alerts == {"gap", "latency"}


def test_json_round_trip_of_raw_feed(spark, tmp_path):
    """Raw venue text goes through routing and normalisation as a stream."""
    from marketframe.sources import trades as tr

    (tmp_path / "raw").mkdir()
    msgs = [{"e": "aggTrade", "s": "X", "p": "2", "q": "3", "T": 1704067200000, "a": 1, "m": True}, {"e": "kline", "s": "X"}]
    (tmp_path / "raw" / "a.jsonl").write_text("\n".join(map(json.dumps, msgs)) + "\n{oops\n")
    raw = spark.readStream.text(str(tmp_path / "raw"))
    run(tr.route_events(raw).groupBy("route").count(), tmp_path, "routes", "complete")
    assert dict(spark.table("routes").collect()) == {"trade": 1, "ignored": 1, "bad": 1}
    run(tr.normalise_agg_trades(raw), tmp_path, "raw_trades")
    r = spark.table("raw_trades").first()
    assert (r["side"], r["grossValue"], r["timestamp"]) == ("Sell", 6.0, 1704067200.0)


def closed(spark, days, first=0, symbol="A"):
    """One bar an hour, all day."""
    rows = [(symbol, T0 + timedelta(hours=24 * first + h), 1.0 + h) for h in range(24 * days)]
    bars = spark.createDataFrame(rows, "symbol string, bar timestamp_ntz, close double")
    return bars.withColumns({c: F.col("close") for c in ("open", "high", "low", "volume", "taker_buy_ratio")})


def test_history_reads_only_the_days_of_the_window(spark, tmp_path):
    sink = BarClose(str(tmp_path), "1h", groups=(), window=30)
    sink._store(closed(spark, 40).withColumn("batch", F.lit(0).cast("long")), "b0")
    closed(spark, 1).select("symbol", F.col("bar").cast("date").alias("began")).write.parquet(f"{tmp_path}/symbols")
    past = sink.recent(closed(spark, 1, first=40))
    plan = past._jdf.queryExecution().executedPlan().toString()
    scans = [line.split("PartitionFilters") for line in plan.splitlines() if "PartitionFilters" in line]
    days = [filters for columns, filters in scans if "dt#" in columns]
    assert days and all("dt#" in filters.split("]")[0] for filters in days)
    dates = past.agg(F.min("bar")).first()[0]
    assert (T0 + timedelta(days=40)) - dates <= timedelta(days=4)
    # a symbol whose bars have gaps gets the older days too
    sparse = closed(spark, 40, symbol="B").filter("dayofyear(bar) % 5 = 1")
    sink._store(sparse.withColumn("batch", F.lit(1).cast("long")), "b1")
    sparse.select("symbol", F.col("bar").cast("date").alias("began")).write.mode("append").parquet(f"{tmp_path}/symbols")
    new = closed(spark, 1, first=40, symbol="B")
    assert sink.recent(new).filter("symbol = 'B'").count() >= 30


def test_retries_and_compaction_keep_every_bar_once(spark, tmp_path):
    sink = BarClose(str(tmp_path), "1h", groups=(), window=30, compact_parts=3)
    hours = closed(spark, 1)
    for k in range(6):
        part = hours.filter(F.hour("bar") % 6 == k)
        sink(part, k)
        if k % 2:
            sink(part, k)
    sink(hours.filter("false"), 6)
    day = sink._folders(spark, f"{tmp_path}/history/dt=2024-01-01")
    assert 0 < len(day) <= 4
    got = sink.history(hours).orderBy("bar").collect()
    assert [(r.bar, r.close) for r in got] == [(r.bar, r.close) for r in hours.orderBy("bar").collect()]
    assert {r.batch: 0 for r in got} == dict.fromkeys(range(6), 0)
    assert spark.read.parquet(f"{tmp_path}/features").count() == 24


def test_replay_runs_arrival_by_arrival(spark):
    from marketframe.streaming import replay

    rows = closed(spark, 2).withColumn("seq", F.hour("bar"))
    feed = replay.arrivals(rows, "bar", 4, late=F.col("seq") == 3, repeated=F.col("seq") == 5)
    seen = []
    replay.run_batches(spark, feed, lambda df, k: seen.append((k, df.count())))
    assert sum(n for _, n in seen) == 48 + 2 and len(seen) == 5 - 1
    assert feed.filter("seq = 3 and dayofyear(bar) = 1").first()["arrival"] == 1
    assert replay.arrivals(rows.filter("false"), "bar", 4).count() == 0
