"""Order-book messages: JSON-lines files and raw depth payloads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.parse import expand
from ..functions.timeutil import epoch_number_to_ntz

LEVELS = "array<array<string>>"
BOOK_SCHEMA = (
    f"topic string, type string, ts long, data struct<s:string,b:{LEVELS},a:{LEVELS}>,"
    " u long, seq long, cts long"
)
SNAPSHOT_SCHEMA = f"s string, T long, E long, lastUpdateId long, bids {LEVELS}, asks {LEVELS}"


def parse_book_lines(lines: DataFrame) -> DataFrame:
    """JSON lines (column ``value``) to book messages.

    Lines that do not parse and lines without data are left out; other columns
    of ``lines`` (file, line number) stay.
    """
    keep = [c for c in lines.columns if c != "value"]
    data, empty = F.col("data"), F.array().cast(LEVELS)
    return (
        expand(lines, F.from_json("value", BOOK_SCHEMA), keep)
        .filter(F.col("type").isNotNull() & data.isNotNull())
        .select(
            *keep,
            data["s"].alias("symbol"),
            "type",
            F.col("ts").alias("ts_ms"),
            epoch_number_to_ntz(F.col("ts").cast("double")).alias("ts"),
            "seq",
            "u",
            "cts",
            F.coalesce(data["b"], empty).alias("b"),
            F.coalesce(data["a"], empty).alias("a"),
        )
        .filter((F.size("b") > 0) | (F.size("a") > 0) | (F.col("type") == "snapshot"))
    )


def numbered_lines(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """``value, file, line`` of text files; ``line`` counts from 1 in each file.

    Every block of a file counts its lines, the counts of the blocks before it are
    added, and no file is read by one task alone.
    """
    lines = spark.read.text(paths).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"),
    )
    blocks = lines.groupBy("file", "block").agg(
        F.min("id").alias("first"), F.count(F.lit(1)).alias("n")
    )
    before = (
        Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = blocks.select(
        "file", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1).alias("shift")
    )
    return lines.join(starts, ["file", "block"]).select(
        "value", "file", (F.col("id") + F.col("shift")).alias("line")
    )


def read_book_lines(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """Book files with file and line number kept; bad lines count but give no row."""
    return parse_book_lines(numbered_lines(spark, paths))


def _message(kind: str, s: Column, ts: Column, b: Column, a: Column, u: Column, seq: Column, cts: Column):
    empty = F.array().cast(LEVELS)
    return [
        F.concat(F.lit("orderbook.200."), s).alias("topic"),
        F.lit(kind).alias("type"),
        ts.alias("ts"),
        F.struct(
            s.alias("s"), F.coalesce(b, empty).alias("b"), F.coalesce(a, empty).alias("a")
        ).alias("data"),
        u.alias("u"),
        seq.alias("seq"),
        cts.alias("cts"),
    ]


def normalise_depth(raw: DataFrame) -> DataFrame:
    """Raw incremental depth JSON (column ``value``) to delta messages.

    The payload tells ``e`` from ``E`` and ``u`` from ``U``, so it is read as a
    map, whose keys keep their case.
    """
    m = F.col("m")
    levels = lambda k: F.from_json(m[k], LEVELS)
    number = lambda k: m[k].try_cast("long")
    return (
        expand(raw, F.struct(F.from_json("value", "map<string,string>").alias("m")))
        .filter(m["e"] == "depthUpdate")
        .select(
            *_message(
                "delta", m["s"], number("T"), levels("b"), levels("a"), number("u"), number("U"),
                number("E"),
            )
        )
    )


def normalise_snapshots(raw: DataFrame, now_ms: Column) -> DataFrame:
    """Raw full-depth JSON to snapshot messages.

    A payload without time takes ``now_ms``; one without event time its time.
    """
    m = F.col("m")
    ts = F.coalesce(m["T"], F.col("now"))
    last = m["lastUpdateId"]
    return (
        expand(raw, F.struct(F.from_json("value", SNAPSHOT_SCHEMA).alias("m"), now_ms.alias("now")))
        .filter(m["s"].isNotNull())
        .select(
            *_message(
                "snapshot", m["s"], ts, m["bids"], m["asks"], last, last, F.coalesce(m["E"], ts)
            )
        )
    )


def sanitise_levels(levels: Column, allow_zero_size: bool) -> Column:
    """Keep positive prices with positive (for deltas also zero) sizes."""
    def good(x):
        price, size = x[0].try_cast("double"), x[1].try_cast("double")
        return (price > 0) & ((size >= 0) if allow_zero_size else (size > 0))

    return F.filter(levels, good)
