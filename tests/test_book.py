"""Interval book against a plain replay of messages."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketframe.operators import book as bk

SCHEMA = "symbol string, seq long, ts timestamp_ntz, type string, b array<array<string>>, a array<array<string>>"


def messages(n=300, seed=0, first_snapshot=3):
    rng = np.random.default_rng(seed)
    rows = []
    for symbol in ("X", "Y"):
        for seq in range(n):
            side = lambda base, step: [
                [f"{base + step * int(k):.1f}", "0" if rng.random() < 0.3 else f"{rng.integers(1, 9)}"]
                for k in rng.choice(12, rng.integers(0, 5), replace=False)
            ]
            kind = "snapshot" if seq == first_snapshot or rng.random() < 0.02 else "delta"
            rows.append((symbol, seq, datetime(2024, 1, 1) + timedelta(seconds=seq), kind,
                         side(100, -0.1), side(100.1, 0.1)))
    return rows


def replay(rows, every, require_snapshot):
    out, books, ready, numbers = [], {}, set(), {}
    for symbol, seq, ts, kind, b, a in sorted(rows, key=lambda r: r[:2]):
        numbers[symbol] = numbers.get(symbol, 0) + 1
        book = books.setdefault(symbol, {"b": {}, "a": {}})
        if kind == "snapshot":
            book["b"].clear()
            book["a"].clear()
            ready.add(symbol)
        elif require_snapshot and symbol not in ready:
            continue
        for s, levels in (("b", b), ("a", a)):
            for p, z in levels:
                if float(z) == 0:
                    book[s].pop(float(p), None)
                else:
                    book[s][float(p)] = float(z)
        if numbers[symbol] % every == 0:
            out += [(symbol, seq, s, p, z) for s in "ba" for p, z in book[s].items()]
    return sorted(out)


@pytest.mark.parametrize("bucket,chunk,require", [(7, 50, True), (50, 10_000, False), (3, 11, True)])
def test_intervals_equal_replay(spark, bucket, chunk, require):
    rows = messages(seed=bucket)
    df = spark.createDataFrame(rows, SCHEMA)
    got = bk.book_at(
        bk.book_intervals(df, chunk, require), bk.count_samples(df, 7), bucket
    ).select("symbol", "seq", "side", "price", "size")
    assert sorted(map(tuple, got.collect())) == replay(rows, 7, require)


@pytest.mark.parametrize("bucket", [9, 10_000])
def test_every_nth_message_whatever_its_number(spark, bucket):
    odd = [(s, 2 * q + 1, ts, *rest) for s, q, ts, *rest in messages(n=120, seed=4)]
    odd += [("Z", 10**12 + q * q, *rest) for s, q, *rest in messages(n=40, seed=5) if s == "X"]
    df = spark.createDataFrame(odd, SCHEMA)
    samples = bk.count_samples(df, 6, bucket)
    want = []
    for symbol in ("X", "Y", "Z"):
        want += [(symbol, q) for q in sorted(r[1] for r in odd if r[0] == symbol)[5::6]]
    assert sorted((r.symbol, r.seq) for r in samples.collect()) == want
    got = bk.book_at(bk.book_intervals(df, bucket), samples, bucket)
    assert sorted(map(tuple, got.select("symbol", "seq", "side", "price", "size").collect())) == replay(
        odd, 6, True
    )


def test_book_plan_holds_no_list_of_samples(spark):
    df = spark.createDataFrame(messages(n=50), SCHEMA)
    plan = bk.book_at(bk.book_intervals(df), bk.count_samples(df, 5))
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in text and "collect_list" not in text


def test_metrics_by_hand(spark):
    levels = spark.createDataFrame(
        [("X", 1, s, p, z) for s, p, z in
         [("b", 100.0, 2.0), ("b", 99.0, 6.0), ("b", 90.0, 99.0), ("a", 101.0, 1.0), ("a", 103.0, 3.0)]],
        "symbol string, seq long, side string, price double, size double",
    ).withColumn("ts", F.expr("timestamp_ntz'2024-01-01 00:00:00'"))
    m = bk.book_metrics(bk.top_levels(levels, 2)).first()
    assert m["spread"] == 1.0
    assert m["micro_dev"] == pytest.approx((101 * 2 + 100 * 1) / (3 + 1e-9) - 100.5)
    assert m["imbalance"] == pytest.approx((8 - 4) / 12)
    assert m["bid_slope"] == pytest.approx(1 / 8) and m["ask_slope"] == pytest.approx(2 / 4)
    assert m["bid_integrity"] == 0.25 and m["ask_integrity"] == 0.25


def test_one_sided_book_is_left_out(spark):
    levels = spark.createDataFrame(
        [("X", 1, "b", 100.0, 2.0)], "symbol string, seq long, side string, price double, size double"
    ).withColumn("ts", F.expr("timestamp_ntz'2024-01-01 00:00:00'"))
    assert bk.book_metrics(bk.top_levels(levels)).count() == 0


def test_live_bars_keep_unset_timestamps(spark):
    rows = [("X", i, "1970-01-01 00:00:00", float(i)) for i in range(3)]
    df = spark.createDataFrame(rows, "symbol string, seq long, t string, spread double").select(
        "symbol", "seq", F.col("t").cast("timestamp_ntz").alias("ts"), "spread",
        *[F.lit(1.0).alias(m) for m in bk.METRICS if m != "spread"],
    )
    out = bk.book_bars_live(df, "5m").first()
    assert out["ob_update_count"] == 1 and out["ob_spread_mean"] == 1.0


def test_copies_are_output_rows_on_sparse_sequences(spark):
    """Three levels over fifty million sequence numbers and four samples."""
    far = 50_000_000
    levels = spark.createDataFrame(
        [("X", 0, "b", 9.0, 1.0, 0, None, far), ("X", 0, "a", 11.0, 1.0, 0, far // 2, far),
         ("X", 0, "a", 12.0, 2.0, far // 2, None, far), ("X", 0, "b", 8.0, 1.0, 5, 6, far)],
        "symbol string, epoch long, side string, price double, size double, seq_from long,"
        " seq_to long, last_seq long",
    )
    times = [datetime(2024, 1, 1, 0, 0, i) for i in range(4)]
    seqs = [0, far // 2 - 1, far // 2, far]
    samples = spark.createDataFrame(
        [("X", q, t) for q, t in zip(seqs, times)], "symbol string, seq long, ts timestamp_ntz"
    )
    got = sorted((r.seq, r.side, r.price) for r in bk.book_at(levels, samples).collect())
    assert got == sorted(
        [(q, "b", 9.0) for q in seqs]
        + [(q, "a", 11.0) for q in seqs[:2]] + [(q, "a", 12.0) for q in seqs[2:]]
    )
    assert bk.book_at(levels, samples.filter("false")).count() == 0
