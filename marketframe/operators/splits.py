"""Leak-free splits, standardisation and sequence windows."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.joins import small_side_join
from ..functions.scan import chunk_with_past


def split_chrono(df: DataFrame, cuts: Sequence[tuple[str, float]]) -> DataFrame:
    """Name the time split of each row by its rank.

    ``cuts``: names with cumulative upper fractions, e.g. ``[("train", .7),
    ("val", .85), ("test", 1.0)]``; a bound is ``floor(n * fraction)``.
    """
    rule = None
    for name, upto in cuts:
        bound = F.floor(F.col("n") * F.lit(float(upto)))
        inside = F.col("idx") < bound
        rule = F.when(inside, name) if rule is None else rule.when(inside, name)
    return df.withColumn("split", rule)


def cpcv(df: DataFrame, n_groups: int = 5, n_test: int = 2, purge: int = 50) -> DataFrame:
    """Combinatorial purged folds: one row per bar and fold with its role.

    Groups are equal runs of rows, the remainder in the last.  Every choice of
    ``n_test`` groups is a fold; the last ``purge`` rows of a training group
    that precedes a test group are left out.
    """
    size = F.floor(F.col("n") / n_groups)
    group = F.least(
        F.when(size > 0, F.floor(F.col("idx") / size)).otherwise(n_groups - 1),
        F.lit(n_groups - 1),
    )
    folds = list(combinations(range(n_groups), n_test))
    group_end = F.when(group == n_groups - 1, F.col("n")).otherwise((group + 1) * size)
    roles = []
    for k, chosen in enumerate(folds):
        test = group.isin(*chosen)
        before_test = (group + 1).isin(*chosen)
        late = F.col("idx") >= group_end - purge
        role = F.when(test, "test").when(before_test & late, None).otherwise("train")
        roles.append(F.struct(F.lit(k).alias("fold"), role.alias("role")))
    return (
        df.withColumn("_r", F.explode(F.array(*roles)))
        .select(*df.columns, F.col("_r.fold").alias("fold"), F.col("_r.role").alias("role"))
        .filter(F.col("role").isNotNull())
    )


def fit_scaler(
    df: DataFrame, columns: Sequence[str], train: Column, keys: Sequence[str] = ("symbol",)
) -> DataFrame:
    """Mean and population deviation of the training rows; zero deviation is 1.

    A key whose training rows hold no value of a column gets 0 and 1 for it.
    """
    aggs = []
    for c in columns:
        dev = F.stddev_pop(c)
        aggs += [
            F.coalesce(F.avg(c), F.lit(0.0)).alias(f"{c}__mean"),
            F.when(dev > 0, dev).otherwise(1.0).alias(f"{c}__scale"),
        ]
    return df.filter(train).groupBy(*keys).agg(*aggs)


def apply_scaler(
    df: DataFrame,
    scaler: DataFrame,
    columns: Sequence[str],
    keys: Sequence[str] = ("symbol",),
    how: str = "inner",
) -> DataFrame:
    """Standardised copies ``<c>_scaled``; the scaler has one row per key.

    With ``how = "left"`` rows of a key without training rows stay, and their copies are NULL.
    """
    joined = small_side_join(df, scaler, list(keys), how)
    scaled = {f"{c}_scaled": (F.col(c) - F.col(f"{c}__mean")) / F.col(f"{c}__scale") for c in columns}
    return joined.withColumns(scaled).drop(
        *[f"{c}__{part}" for c in columns for part in ("mean", "scale")]
    )


def sequences(df: DataFrame, columns: Sequence[str], length: int = 60, chunk: int = 8192) -> DataFrame:
    """Last ``length`` feature rows per bar, oldest first, where complete."""
    rows = chunk_with_past(df, max(chunk, length), length - 1)
    w = Window.partitionBy("symbol", "_chunk").orderBy("idx").rowsBetween(-(length - 1), 0)
    vector = F.array(*[F.col(c).cast("double") for c in columns])
    return (
        rows.withColumn("sequence", F.collect_list(vector).over(w))
        .filter(F.col("_own") & (F.col("idx") >= length - 1))
        .drop("_chunk", "_own")
    )
