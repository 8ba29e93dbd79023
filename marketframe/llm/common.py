"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: White space of the word definition ``[^\x20\x09-\x0D]+``; a fixed value.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, as ``alias=name``: other columns cannot clash later."""
    return df.select(*[column(df, name).alias(alias) for alias, name in columns.items()])


def column(df: DataFrame, name: str) -> Column:
    return df["`" + name.replace("`", "``") + "`"]


def parts_for(df_rows: int, per_part: int, least: int = 1) -> int:
    """Number of parts of at most about ``per_part`` rows."""
    return max(least, -(-df_rows // per_part))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))
