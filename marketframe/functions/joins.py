"""Joins of a large table with a small side; shuffles with a bounded number of rows a task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from .storage import materialise

#: Bytes of Parquet up to which a small side is sent to every executor.  Packed numbers and
#: strings take about ten times as much in memory.
BROADCAST_BYTES = 16 << 20
#: Parts that a key of the large side is dealt to when the small side is too large for that.
SALT = 64
#: Rows that a task takes of a spread shuffle.  Adaptive execution merges partitions by their
#: compressed size, and narrow rows grow more than tenfold in a sort.
TASK_ROWS = 500_000


def written_bytes(df: DataFrame) -> int:
    """Size of the files a scan reads, as Spark's own statistics have it."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small_side_join(
    large: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    most_bytes: int = BROADCAST_BYTES,
    salt: int = SALT,
) -> DataFrame:
    """``large`` joined with ``small`` (inner, left, left_semi, left_anti) on few distinct keys.

    The small side is written and measured.  Up to ``most_bytes`` it is broadcast and the
    large side stays where it is.  Above, each of its rows is copied to ``salt`` parts and
    the large side's rows are dealt to these by a hash, so a key that holds a third of all
    rows spreads over as many tasks.  Keys compare as in an ordinary equi-join: null
    matches nothing.
    """
    on = list(on)
    small = materialise(small, "small-side")
    if written_bytes(small) <= most_bytes:
        return large.join(F.broadcast(small), on, how)
    parts = F.sequence(F.lit(0), F.lit(salt - 1))
    dealt = large.withColumn("_salt", F.pmod(F.xxhash64(*large.columns), F.lit(salt)).cast("int"))
    return dealt.join(small.withColumn("_salt", F.explode(parts)), [*on, "_salt"], how).drop("_salt")


def spread(df: DataFrame, on: Sequence[str], rows: int, task_rows: int = TASK_ROWS) -> DataFrame:
    """``df`` dealt by ``on`` to as many tasks as ``rows`` need, so that sorts do not grow with them.

    Both sides of a join get the same ``rows``.  What fits the cores is left to adaptive execution.
    """
    if rows <= task_rows * df.sparkSession.sparkContext.defaultParallelism:
        return df
    return df.repartition(-(-rows // task_rows), *on)
