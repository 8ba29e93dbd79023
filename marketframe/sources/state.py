"""Tables the system keeps: history, open positions, parameters, manifests."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.parse import expand
from ..functions.storage import materialise

# Strategy and model defaults a parameter set may override.
PARAM_DEFAULTS = {
    "base_limit_offset_atr": 0.88,
    "take_profit_atr": 1.2,
    "stop_loss_atr": 3.9,
    "learning_rate": 0.05,
    "max_depth": 5,
    "num_leaves": 32,
    "model_threshold": 0.60,
    "direction_threshold": 0.5,
    "aggressive_threshold": 0.8,
    "ob_levels": 50,
}
# Older names found in parameter files.
PARAM_ALIASES = {"limit_offset_atr": "base_limit_offset_atr"}

_INT_PARAMS = {"max_depth", "num_leaves", "ob_levels"}


def params_schema() -> str:
    kind = lambda n: "int" if n in _INT_PARAMS else "double"
    names = [*PARAM_DEFAULTS, *PARAM_ALIASES]
    return "symbol string, timeframe string, " + ", ".join(
        f"{n} {kind(PARAM_ALIASES.get(n, n))}" for n in names
    )


def resolve_params(raw: DataFrame) -> DataFrame:
    """One complete parameter row per input row: given keys over defaults."""
    alias_of = {v: k for k, v in PARAM_ALIASES.items()}
    cols = []
    for name, default in PARAM_DEFAULTS.items():
        given = [F.col(name)]
        if name in alias_of:
            given.append(F.col(alias_of[name]))
        cols.append(F.coalesce(*given, F.lit(default)).alias(name))
    drop = {*PARAM_DEFAULTS, *PARAM_ALIASES}
    return raw.select(*[c for c in raw.columns if c not in drop], *cols)


def parse_params(lines: DataFrame) -> DataFrame:
    """Parameter JSON in column ``value``; other columns are kept."""
    keep = [c for c in lines.columns if c != "value"]
    return resolve_params(expand(lines, F.from_json("value", params_schema()), keep))


def read_params(spark: SparkSession, paths) -> DataFrame:
    raw = spark.read.schema(params_schema()).option("multiLine", True).json(paths)
    return resolve_params(raw)


def save_positions(
    stored: DataFrame, current: DataFrame, managed: DataFrame | None = None
) -> DataFrame:
    """Stored ledger with the open rows of the managed symbols replaced by ``current``.

    ``managed`` (column ``symbol``) names the symbols whose open positions
    ``current`` holds completely, also those with none left; without it only the
    symbols found in ``current`` are replaced.  Rows of other symbols and closed
    rows stay.
    """
    names = current.select("symbol") if managed is None else managed.select("symbol")
    symbols = names.distinct().withColumn("status", F.lit("open"))
    return stored.join(symbols, ["symbol", "status"], "left_anti").unionByName(current)


MANIFEST = "path string, timeframe string, levels int, built_at timestamp"


def stale_files(files: DataFrame, manifest: DataFrame, timeframe: str, levels: int) -> DataFrame:
    """Source files that must be recomputed.

    ``files``: ``path``, ``mtime``.  ``manifest``: ``path``, ``timeframe``,
    ``levels``, ``built_at``.  A result is fresh only for the same timeframe
    and depth and if it was built after the last change of its source.
    """
    same = manifest.filter((F.col("timeframe") == timeframe) & (F.col("levels") == levels))
    built = same.groupBy("path").agg(F.max("built_at").alias("built_at"))
    return (
        files.join(built, "path", "left")
        .filter(F.col("built_at").isNull() | (F.col("built_at") <= F.col("mtime")))
        .select("path", "mtime")
    )


def manifest_rows(built: DataFrame, timeframe: str, levels: int, built_at: Column) -> DataFrame:
    """Manifest entries of files just computed, to be appended once their results are written."""
    return built.select(
        "path", F.lit(timeframe).alias("timeframe"), F.lit(levels).alias("levels"), built_at.alias("built_at")
    )


def build_stale(
    files: DataFrame, manifest: DataFrame, timeframe: str, levels: int, compute, root: str
) -> DataFrame:
    """Compute the stale ones of ``files`` and record them; returns the manifest.

    ``files``: ``path``, ``mtime``, as ``file_listing`` gives them.  ``compute(stale)`` gets
    the stale rows as a table and gives rows with a ``path`` column.  Results replace their
    file's own partition under ``root/results`` before the manifest under ``root/manifest``
    grows, so a build that breaks off is repeated and one that is recorded is complete.
    Paths stay on the executors.
    """
    spark = files.sparkSession
    stale = materialise(stale_files(files, manifest, timeframe, levels), "stale-files")
    if not stale.isEmpty():
        write_partitions(compute(stale), f"{root}/results", ["path"])
        rows = manifest_rows(stale, timeframe, levels, F.current_timestamp())
        rows.write.mode("append").parquet(f"{root}/manifest")
    return load_manifest(spark, root)


def load_manifest(spark: SparkSession, root: str) -> DataFrame:
    """The manifest under ``root``; empty before the first build."""
    spark.createDataFrame([], MANIFEST).write.mode("append").parquet(f"{root}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifest")


def file_listing(spark: SparkSession, paths) -> DataFrame:
    """Path and modification time of text sources."""
    return (
        spark.read.format("binaryFile").load(paths)
        .select("path", F.col("modificationTime").alias("mtime"))
    )


def write_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Replace only the partitions present in ``df``."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*by)
        .parquet(path)
    )


def save_version(df: DataFrame, root: str) -> str:
    """Write a new complete version of a table and publish it.

    Spark's committer makes the data visible at once; the one-row pointer table
    is appended last, so readers never see a partial version.
    """
    spark = df.sparkSession
    version = uuid.uuid4().hex
    df.write.parquet(f"{root}/versions/{version}")
    pointer = spark.range(1).select(
        F.lit(version).alias("version"), F.current_timestamp().alias("at")
    )
    pointer.coalesce(1).write.mode("append").parquet(f"{root}/pointer")
    return version


def load_version(spark: SparkSession, root: str) -> DataFrame:
    pointer = spark.read.parquet(f"{root}/pointer")
    version = pointer.agg(F.max_by("version", "at").alias("v")).first()["v"]
    return spark.read.parquet(f"{root}/versions/{version}")


def with_columns_or_zero(df: DataFrame, names: list[str]) -> DataFrame:
    """Add missing numeric columns as 0.0 (schema drift of old files)."""
    return df.withColumns({n: F.lit(0.0) for n in names if n not in df.columns})


