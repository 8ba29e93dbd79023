"""Trade tapes: CSV files, raw venue messages, columnar storage, routing."""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.parse import expand
from ..functions.timeutil import epoch_number_to_ntz

# Column order of the trade files.
TRADE_COLUMNS = [
    "timestamp", "symbol", "side", "size", "price", "tickDirection", "trdMatchID",
    "grossValue", "homeNotional", "foreignNotional", "RPI",
]

_TYPES = {
    "timestamp": "double", "size": "double", "price": "double", "grossValue": "double",
    "homeNotional": "double", "foreignNotional": "double", "RPI": "int",
}


@dataclass(frozen=True)
class TradeColumns:
    """Names of the columns a trade file may have; ``side`` and ``id`` may be missing."""

    timestamp: str = "timestamp"
    symbol: str = "symbol"
    side: str = "side"
    size: str = "size"
    price: str = "price"
    id: str = "trdMatchID"

AGG_TRADE_SCHEMA = "e string, s string, p string, q string, T long, a long, m boolean"


def ddl(columns: Sequence[str]) -> str:
    return ", ".join(f"`{c}` {_TYPES.get(c, 'string')}" for c in columns)


def project_trades(raw: DataFrame, seq: Column) -> DataFrame:
    """The trade tape: four columns plus symbol and sequence; side defaults to Buy."""
    side = F.col("side") if "side" in raw.columns else F.lit(None).cast("string")
    return raw.select(
        "symbol",
        epoch_number_to_ntz(F.col("timestamp")).alias("ts"),
        seq.alias("seq"),
        "price",
        "size",
        F.coalesce(side, F.lit("Buy")).alias("side"),
    )


def parse_trade_lines(lines: DataFrame, columns: Sequence[str]) -> DataFrame:
    """CSV lines (column ``value``) of files that share one header."""
    parsed = expand(lines, F.from_csv("value", ddl(columns)))
    return project_trades(
        parsed.filter(F.col("timestamp").isNotNull() & F.col("price").isNotNull()),
        F.col("trdMatchID").try_cast("long"),
    )


def _first_lines(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyarrow import fs

    for part in parts:
        lines = []
        for uri in part["path"]:
            # a listing writes local paths with one slash, Arrow wants three
            plain = "file://" + uri[5:] if uri.startswith("file:/") and uri[6:7] != "/" else uri
            filesystem, path = fs.FileSystem.from_uri(plain)
            with filesystem.open_input_file(path) as f:
                head = b""
                while b"\n" not in head and (more := f.read(1 << 16)):
                    head += more
            lines.append(head.split(b"\n", 1)[0].decode("utf-8", "replace").strip("\r\ufeff "))
        yield part.assign(header=lines)


def file_headers(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """``path, header`` (first line) of every file; only the first bytes are read."""
    files = spark.read.format("binaryFile").load(paths).select("path")
    return files.mapInPandas(_first_lines, "path string, header string")


def read_trade_csv(
    spark: SparkSession, paths: Sequence[str] | str, names: TradeColumns = TradeColumns()
) -> DataFrame:
    """All trade files under ``paths``; every file may have its own header.

    Columns are found by name, in any order.  The first line of each file is read on
    the executors; files with the same header are scanned together, once.  Files
    without the needed columns are skipped with a warning that names them.  Ids of any type are read:
    ``seq`` is the id where it is a whole number, ``trade_id`` its text, and ``pos``
    (place in the file) orders trades of equal time that have no ``seq``.  Rows whose
    time, price or size is not a number are left out.
    """
    by_header: dict[str, list[str]] = {}
    for row in file_headers(spark, paths).collect():
        by_header.setdefault(row["header"], []).append(row["path"])
    out = None
    for header, files in sorted(by_header.items()):
        columns = [c.strip().strip('"') for c in header.split(",")]
        missing = {names.timestamp, names.price, names.size} - set(columns)
        if missing:
            warnings.warn(f"skipped {len(files)} files without {sorted(missing)}: {sorted(files)[:5]}")
            continue
        schema = ", ".join(f"`_{i}` string" for i in range(len(columns)))
        raw = spark.read.schema(schema).option("header", True).csv(sorted(files))
        found = {c: F.col(f"_{i}") for i, c in enumerate(columns)}
        place = F.struct(
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),
        )
        none = F.lit(None).cast("string")
        number = lambda c: found[c].try_cast("double")
        part = raw.select(
            found.get(names.symbol, symbol_of_path(F.col("_metadata.file_path"))).alias("symbol"),
            number(names.timestamp).alias("timestamp"),
            number(names.price).alias("price"),
            number(names.size).alias("size"),
            found.get(names.side, none).alias("side"),
            found.get(names.id, none).alias("trade_id"),
            place.alias("pos"),
        ).filter("timestamp is not null and price is not null and size is not null")
        tape = part.select(
            "symbol",
            epoch_number_to_ntz(F.col("timestamp")).alias("ts"),
            F.col("trade_id").try_cast("long").alias("seq"),
            "price",
            "size",
            F.coalesce("side", F.lit("Buy")).alias("side"),
            "trade_id",
            "pos",
        )
        out = tape if out is None else out.unionByName(tape)
    if out is None:
        raise FileNotFoundError(f"no trade file under {paths}")
    return out


def symbol_of_path(path: Column) -> Column:
    """Symbol from ``.../<SYMBOL>/Trade/<file>`` or ``.../<SYMBOL>/Orderbook/<file>``."""
    folder = F.regexp_extract(path, r"([^/]+)/(?:Trade|Orderbook)/[^/]+$", 1)
    return F.regexp_replace(folder, "_Binance$", "")


def discover_symbols(files: DataFrame) -> DataFrame:
    """Distinct symbols of a listing (column ``path``): USDT folders, no mirrors."""
    folder = F.regexp_extract("path", r"([^/]+)/(?:Trade|Orderbook)/[^/]+$", 1)
    return (
        files.select(folder.alias("symbol"))
        .filter(F.col("symbol").contains("USDT") & ~F.col("symbol").endswith("_Binance"))
        .distinct()
    )


def write_trades(trades: DataFrame, path: str, mode: str = "append") -> None:
    """Columnar store partitioned by symbol and day."""
    day = trades.withColumn("dt", F.col("ts").cast("date"))
    day.write.mode(mode).partitionBy("symbol", "dt").parquet(path)


def agg_trade() -> list[Column]:
    """Trade-file columns from the fields of a raw aggregate trade."""
    price, size = F.col("p").try_cast("double"), F.col("q").try_cast("double")
    return [
        (F.col("T") / 1000.0).alias("timestamp"),
        F.col("s").alias("symbol"),
        F.when(F.col("m"), "Sell").otherwise("Buy").alias("side"),
        size.alias("size"),
        price.alias("price"),
        F.lit("ZeroPlusTick").alias("tickDirection"),
        F.col("a").alias("trdMatchID"),
        (price * size).alias("grossValue"),
        size.alias("homeNotional"),
        (price * size).alias("foreignNotional"),
        F.lit(0).alias("RPI"),
    ]


def normalise_agg_trades(raw: DataFrame) -> DataFrame:
    """Raw JSON (column ``value``) of aggregate trades to trade-file rows.

    Trades whose price or size is not a number are left out; ``route_events`` calls
    them bad.
    """
    parsed = expand(raw, F.from_json("value", AGG_TRADE_SCHEMA))
    numbers = F.col("p").try_cast("double").isNotNull() & F.col("q").try_cast("double").isNotNull()
    return parsed.filter((F.col("e") == "aggTrade") & numbers).select(*agg_trade())


def route_events(raw: DataFrame) -> DataFrame:
    """Tag raw messages: trade, depth, ignored, or bad (not parsable, malformed numbers)."""
    head = F.from_json("value", "e string, s string, p string, q string")
    wrong = lambda c: head[c].isNotNull() & head[c].try_cast("double").isNull()
    malformed = (head["e"] == "aggTrade") & (wrong("p") | wrong("q"))
    kind = (
        F.when(head.isNull() | (head["e"].isNull() & head["s"].isNull()) | malformed, "bad")
        .when(head["e"] == "aggTrade", "trade")
        .when(head["e"] == "depthUpdate", "depth")
        .otherwise("ignored")
    )
    return raw.withColumns({"route": kind, "symbol": head["s"]})


def rotation_key(ts: Column) -> Column:
    """UTC calendar day used to rotate output partitions."""
    return F.date_format(ts.cast("date"), "yyyy-MM-dd")


def valid_trades(trades: DataFrame) -> DataFrame:
    return trades.filter((F.col("price") > 0) & (F.col("size") > 0))

