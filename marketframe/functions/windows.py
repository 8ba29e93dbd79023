"""Rolling and exponential windows over chunked, row-numbered series.

Input rows come from ``scan.chunk_with_past``: everything below partitions by
``(symbol, _chunk)``, so one exchange serves all of it.

Exponential means use scaled prefix sums.  Inside a block of row numbers
``S_p = r^p * sum(x_q * r^-q)``; the history before the block enters through
the end value of the previous block.  A block is long enough that anything
older weighs under 1e-17 of the result, less than a double can hold.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

FAST_BLOCK = 1024
SLOW_BLOCK = 18 * FAST_BLOCK
CHUNK = 4 * SLOW_BLOCK
HALO = SLOW_BLOCK

_PART = ("symbol", "_chunk")


def series() -> Window:
    return Window.partitionBy(*_PART).orderBy("idx")


def lag(x: Column, k: int = 1) -> Column:
    return F.lag(x, k).over(series())


def rolling(agg, x: Column, n: int, min_periods: int | None = None) -> Column:
    """Sliding-frame aggregate, NULL below ``min_periods`` values."""
    frame = series().rowsBetween(-(n - 1), 0)
    need = n if min_periods is None else min_periods
    return F.when(F.count(x).over(frame) >= need, agg(x).over(frame))


def rolling_mean(x: Column, n: int, min_periods: int | None = None) -> Column:
    return rolling(F.avg, x, n, min_periods)


def rolling_std(x: Column, n: int, min_periods: int | None = None) -> Column:
    return rolling(F.stddev_samp, x, n, min_periods)


def rolling_sum(x: Column, n: int, min_periods: int | None = None) -> Column:
    return rolling(F.sum, x, n, min_periods)


@dataclass(frozen=True)
class Long:
    """Long-frame mean or sum computed as a difference of prefix sums."""

    out: str
    kind: str
    col: str
    n: int
    min_periods: int


def add_long_rolling(df: DataFrame, specs: Sequence[Long]) -> DataFrame:
    upto = series().rowsBetween(Window.unboundedPreceding, 0)
    cols = sorted({s.col for s in specs})
    df = df.withColumns(
        {f"_ps_{c}": F.coalesce(F.sum(c).over(upto), F.lit(0.0)) for c in cols}
        | {f"_pc_{c}": F.count(c).over(upto) for c in cols}
    )
    out = {}
    for s in specs:
        total = F.col(f"_ps_{s.col}") - F.coalesce(lag(F.col(f"_ps_{s.col}"), s.n), F.lit(0.0))
        count = F.col(f"_pc_{s.col}") - F.coalesce(lag(F.col(f"_pc_{s.col}"), s.n), F.lit(0))
        value = total / F.nullif(count, F.lit(0)) if s.kind == "mean" else total
        out[s.out] = F.when(count >= s.min_periods, value)
    return df.withColumns(out).drop(*[f"_p{k}_{c}" for c in cols for k in "sc"])


@dataclass(frozen=True)
class Ewm:
    """Exponential mean of ``col``; ``seed`` is the row number of its first value.

    ``adjust`` divides by the sum of the weights; otherwise the first value
    starts the recursion ``y = (1 - alpha) * y + alpha * x``.
    """

    out: str
    col: str
    alpha: float
    adjust: bool
    seed: int = 0
    min_periods: int = 1


def span(n: int) -> float:
    return 2.0 / (n + 1.0)


def check_block(alpha: float, block: int) -> None:
    """A block must outlast the memory of the mean and stay within doubles."""
    left = block * math.log1p(-alpha)
    if left > math.log(1e-15):
        raise ValueError(f"alpha {alpha} remembers more than the {block} rows before a block")
    if left < math.log(1e-300):
        raise ValueError(f"weights of alpha {alpha} leave the range of doubles in {block} rows")


def add_ewm(df: DataFrame, specs: Sequence[Ewm], block: int) -> DataFrame:
    for s in specs:
        check_block(s.alpha, block)
    pos = F.col("idx") % block
    here = (
        Window.partitionBy(*_PART, "_blk")
        .orderBy("idx")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    earlier = series().rowsBetween(Window.unboundedPreceding, -1)
    local, carried, result = {}, {}, {}
    for s in specs:
        r = F.lit(1.0 - s.alpha)
        x = F.col(s.col)
        if not s.adjust:
            x = F.when(F.col("idx") == s.seed, x / s.alpha).otherwise(x)
        local[f"_s_{s.out}"] = F.sum(x * F.pow(r, -pos)).over(here) * F.pow(r, pos)
        ends = F.when(pos == block - 1, F.col(f"_s_{s.out}"))
        carried[f"_c_{s.out}"] = F.last(ends, ignorenulls=True).over(earlier)
        total = F.col(f"_s_{s.out}") + F.pow(r, pos + 1) * F.coalesce(
            F.col(f"_c_{s.out}"), F.lit(0.0)
        )
        age = F.col("idx") - s.seed + 1
        if s.adjust:
            y = total * s.alpha / (1.0 - F.pow(r, age))
        else:
            y = total * s.alpha
        result[s.out] = F.when(age >= s.min_periods, y)
    return (
        df.withColumn("_blk", F.floor(F.col("idx") / block))
        .withColumns(local)
        .withColumns(carried)
        .withColumns(result)
        .drop("_blk", *local, *carried)
    )
