"""History scenarios: merge, rescue, streaks, gaps, backfill, quality, health."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from marketframe.operators import health as hl, history as hs

T0 = datetime(2024, 1, 1)
SCHEMA = "symbol string, bar timestamp_ntz, close double, ob_spread_mean double"


def bars(spark, spans, close=1.0, bad=(), symbol="A"):
    """5m bars at the given numbers; ``bad`` numbers have no book."""
    rows = [(symbol, T0 + timedelta(minutes=5 * i), close, 0.0 if i in bad else 0.1) for i in spans]
    return spark.createDataFrame(rows, SCHEMA)


def now(i):
    return F.expr(f"timestamp_ntz'{T0 + timedelta(minutes=5 * i)}'")


def streak(df, at, cap=1000):
    return hs.warmup(df, "5m", now(at), cap).first()["streak"]


def test_merge_prefers_first(spark):
    out = hs.merge_history([bars(spark, range(20), 1.0), bars(spark, range(10, 40), 2.0)])
    assert out.count() == 40
    assert out.filter("close = 1.0").count() == 20


@pytest.mark.parametrize("spans,bad,want", [
    (range(60), (), 60),
    ([i for i in range(60) if i != 30], (), 29),
    (range(60), range(10), 50),
    (range(60), (59,), 0),
    ([0], (), 1),
    ([*range(10), 12, 13], (11,), 2),
    ([*range(10), 12, 13], (12,), 1),
])
def test_streak(spark, spans, bad, want):
    assert streak(bars(spark, spans, bad=bad), max(spans) + 1) == want


def test_streak_cap_and_staleness(spark):
    df = bars(spark, range(60))
    assert streak(df, 60, cap=25) == 25
    assert streak(df, 61) == 60 and streak(df, 62) == 0


def test_rescue_only_from_warm_backup(spark):
    cold, warm = bars(spark, range(5)), bars(spark, range(50), 2.0)
    both = hs.rescue(cold, warm, "5m", now(50), 20)
    assert both.count() == 50 and both.filter("close = 1.0").count() == 5
    weak = bars(spark, range(50), 2.0, bad=range(45))
    assert hs.rescue(cold, weak, "5m", now(50), 20).count() == 5
    fresh = bars(spark, range(50))
    assert hs.rescue(fresh, bars(spark, range(60), 2.0), "5m", now(50), 20).count() == 50
    other = hs.rescue(cold, bars(spark, range(50), symbol="B"), "5m", now(50), 20)
    assert other.count() == 55


def test_gaps_ignore_repeats(spark):
    df = bars(spark, [0, 1, 1, 2, 5, 6])
    got = hs.gaps(df, "5m").first()
    assert hs.gaps(df, "5m").count() == 1 and got["missing"] == 2


def test_backfill_ten_plus_twelve(spark):
    old = bars(spark, range(10))
    plan = hs.backfill_plan(old, "5m", now(21))
    assert plan.count() == 12
    out = hs.backfill(old, bars(spark, range(5, 40), 3.0).drop("ob_spread_mean"), plan, ["ob_spread_mean"])
    assert out.count() == 22 and out.filter("ob_spread_mean = 0 and close = 3.0").count() == 12
    assert hs.backfill_plan(old, "5m", now(11)).count() == 0
    assert hs.backfill_plan(old, "5m", now(5000)).count() == 4991


def test_update_keeps_old_where_new_is_null(spark):
    base = bars(spark, range(3))
    change = spark.createDataFrame([("A", T0, None, 9.0)], SCHEMA)
    got = hs.update_cells(base, change, ["close", "ob_spread_mean"]).orderBy("bar").first()
    assert got["close"] == 1.0 and got["ob_spread_mean"] == 9.0


def test_quality(spark):
    df = bars(spark, [0, 1, 3], bad=(1,)).withColumns(
        {"ob_update_count": F.lit(3).cast("long"), "lag_ms": F.lit(6000), "x": F.lit(None).cast("double")}
    )
    q = hs.quality_report(df, "5m", ["close", "x"]).first()
    assert (q["bars"], q["gaps"], q["nulls"], q["stale_spread"], q["frozen_book"], q["late"], q["latest"]) == (3, 1, 3, 1, 2, 3, "gap")


def test_alert_lines(spark):
    lines = spark.createDataFrame(
        [("[ERROR] boom",), ("[ERROR] Connection reset by peer",), ("all fine",), ("x (HIGH LATENCY)",)], "text string"
    )
    assert sorted(r["pattern"] for r in hl.alerts(lines).collect()) == ["(HIGH LATENCY)", "[ERROR]"]


def test_silences(spark):
    rows = [("s", T0 + timedelta(seconds=s)) for s in (0, 100, 800, 86_400)]
    df = spark.createDataFrame(rows, "service string, ts timestamp_ntz")
    until = F.expr("timestamp_ntz'2024-01-02 00:00:30'")
    got = sorted(r["seconds"] for r in hl.silences(df, ["service"], 600, until).collect())
    assert got == [700.0, 85600.0]
