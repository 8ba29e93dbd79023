"""Bar history: merging, rescue, gaps, warm-up, backfill, quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.joins import small_side_join
from ..functions.scan import Running, running
from ..functions.timeutil import micros_to_ntz, ntz_micros, timeframe_seconds

# Limits of the live checks.
MAX_LAG_MS = 5000
MIN_UPDATES = 5
REQUEST_BARS = 1000


def merge_history(parts: Sequence[DataFrame]) -> DataFrame:
    """Union of histories; of equal bars the one from the earliest part stays.

    Bars repeated inside a part resolve by a hash of their cells, the same in every run.
    """
    stacked = None
    for rank, part in enumerate(parts):
        tagged = part.withColumn("_rank", F.lit(rank))
        stacked = tagged if stacked is None else stacked.unionByName(tagged, allowMissingColumns=True)
    cells = [c for c in stacked.columns if c not in ("symbol", "bar", "_rank")]
    w = Window.partitionBy("symbol", "bar").orderBy("_rank", F.xxhash64(*cells), *cells)
    return (
        stacked.withColumn("_rn", F.row_number().over(w))
        .filter(F.col("_rn") == 1)
        .drop("_rank", "_rn")
    )


def update_cells(base: DataFrame, changes: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Base rows with non-NULL cells of ``changes`` written over them.

    Where changes repeat a bar, the largest value of each cell counts.
    """
    keys = ["symbol", "bar"]
    new = changes.groupBy(*keys).agg(*[F.max(c).alias(f"_n_{c}") for c in columns])
    joined = base.join(new, keys, "left")
    return joined.select(
        *[
            F.coalesce(F.col(f"_n_{c}"), F.col(c)).alias(c) if c in columns else F.col(c)
            for c in base.columns
        ]
    )


def _with_previous(bars: DataFrame) -> DataFrame:
    day = F.col("bar").cast("date")
    return running(
        bars, ["symbol"], day, ["bar"], [Running("prev_bar", "last", F.col("bar"), inclusive=False)]
    )


def _delta_us() -> Column:
    return ntz_micros(F.col("bar")) - ntz_micros(F.col("prev_bar"))


def gaps(bars: DataFrame, timeframe: str) -> DataFrame:
    """Holes in a history with the number of missing bars; overlaps are no gaps."""
    step = timeframe_seconds(timeframe) * 1_000_000
    return (
        _with_previous(bars.select("symbol", "bar").distinct())
        .filter(_delta_us() > step)
        .select(
            "symbol",
            F.col("prev_bar").alias("gap_from"),
            F.col("bar").alias("gap_to"),
            (F.floor((_delta_us() - 1) / step)).alias("missing"),
        )
    )


def continuity(bars: DataFrame, timeframe: str) -> DataFrame:
    """``first``, ``ok`` or ``gap`` per bar against the bar before it."""
    step = timeframe_seconds(timeframe) * 1_000_000
    status = (
        F.when(F.col("prev_bar").isNull(), "first")
        .when(_delta_us() == step, "ok")
        .otherwise("gap")
    )
    return _with_previous(bars).withColumn("continuity", status)


def warmup(bars: DataFrame, timeframe: str, now: Column, cap: int) -> DataFrame:
    """Length of the latest run of valid, contiguous bars per symbol.

    A bar is valid with a positive ``ob_spread_mean``.  Every bar that cannot
    be preceded by a run names the earliest possible start of one; the latest
    such start fixes the run.  A history older than two bars counts 0.
    """
    step = timeframe_seconds(timeframe) * 1_000_000
    at = ntz_micros(F.col("bar"))
    begins = F.when(F.coalesce(F.col("ob_spread_mean"), F.lit(0.0)) <= 0, at + step).when(
        F.col("prev_bar").isNull() | (_delta_us() != step), at
    )
    run = _with_previous(bars).groupBy("symbol").agg(
        F.max(at).alias("last"), F.max(begins).alias("start")
    )
    length = F.greatest((F.col("last") - F.col("start")) / step + 1, F.lit(0))
    stale = ntz_micros(now) - F.col("last") > 2 * step
    return run.select(
        "symbol",
        F.when(stale, 0).otherwise(F.least(length, F.lit(cap))).cast("long").alias("streak"),
    )


def rescue(
    main: DataFrame, backup: DataFrame, timeframe: str, now: Column, need: int
) -> DataFrame:
    """Main history, completed from a warm backup where main is cold."""
    cold = warmup(main, timeframe, now, need).filter(F.col("streak") < need)
    warm = warmup(backup, timeframe, now, need).filter(F.col("streak") >= need).select("symbol")
    known = main.select("symbol").distinct()
    absent = backup.select("symbol").distinct().join(known, "symbol", "left_anti")
    chosen = warm.join(cold.select("symbol").unionByName(absent), "symbol", "left_semi")
    return merge_history([main, small_side_join(backup, chosen, ["symbol"], "left_semi")])


def backfill_plan(
    bars: DataFrame, timeframe: str, now: Column, request_bars: int = REQUEST_BARS
) -> DataFrame:
    """All bars missing between the last one and ``now`` where over two are due.

    ``request`` numbers the pages of ``request_bars`` bars that a venue is asked for.
    """
    step = timeframe_seconds(timeframe) * 1_000_000
    last = bars.groupBy("symbol").agg(F.max("bar").alias("last_bar"))
    start = ntz_micros(F.col("last_bar")) + step
    due = ntz_micros(now) - ntz_micros(F.col("last_bar"))
    count = F.floor((ntz_micros(now) - start) / step) + 1
    return (
        last.filter(due > 2 * step)
        .withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)))
        .select(
            "symbol",
            micros_to_ntz(start + F.col("_i") * step).alias("bar"),
            F.floor(F.col("_i") / request_bars).alias("request"),
        )
    )


def backfill(bars: DataFrame, downloaded: DataFrame, plan: DataFrame, zero: Sequence[str]) -> DataFrame:
    """History with planned, downloaded bars appended; ``zero`` columns are 0."""
    new = downloaded.join(plan, ["symbol", "bar"], "left_semi").withColumns(
        {c: F.lit(0.0) for c in zero}
    )
    return merge_history([bars, new])


def quality_report(bars: DataFrame, timeframe: str, checked: Sequence[str]) -> DataFrame:
    """Counts of suspect bars per symbol.

    Needs ``ob_spread_mean``, ``ob_update_count`` and ``lag_ms``; ``checked``
    are the columns whose NULLs are counted.
    """
    flag = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).cast("long")
    nulls = sum((F.when(F.col(c).isNull(), 1).otherwise(0) for c in checked), F.lit(0))
    spread = F.coalesce(F.col("ob_spread_mean"), F.lit(0.0))
    updates = F.coalesce(F.col("ob_update_count"), F.lit(0))
    return continuity(bars, timeframe).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("bars"),
        flag(F.col("continuity") == "gap").alias("gaps"),
        F.sum(nulls).cast("long").alias("nulls"),
        flag(spread <= 0).alias("stale_spread"),
        flag((spread > 0) & (updates < MIN_UPDATES)).alias("frozen_book"),
        flag(F.col("lag_ms") > MAX_LAG_MS).alias("late"),
        F.max_by("continuity", "bar").alias("latest"),
    )
