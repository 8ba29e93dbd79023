"""Streaming feeds: rotated sinks, bars, de-duplication, log alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions.num import ratio
from ..functions.timeutil import window_duration
from ..operators.bars import trade_bar_aggs, with_trade_metrics
from ..operators.health import alerts
from ..sources.trades import rotation_key


def rotated(rows: DataFrame, kind: str, ts: Column) -> DataFrame:
    """Rows with the partition columns ``kind`` and ``dt`` (UTC day)."""
    return rows.withColumns({"kind": F.lit(kind), "dt": rotation_key(ts)})


def rotate_sink(rows: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Append a rotated stream under symbol, kind and day.

    One stream serves all symbols; the file sink's log makes retries exact.
    """
    return (
        rows.writeStream.format("parquet")
        .partitionBy("symbol", "kind", "dt")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )


def with_event_time(trades: DataFrame, lateness: str) -> DataFrame:
    """Watermark on ``event_time``: the NTZ time read as UTC."""
    return trades.withColumn("event_time", F.col("ts").cast("timestamp")).withWatermark(
        "event_time", lateness
    )


def stream_bars(trades: DataFrame, timeframe: str, lateness: str = "10 minutes") -> DataFrame:
    """Trade bars that close once the watermark passes their end (append mode)."""
    rows = with_trade_metrics(with_event_time(trades.filter(F.col("price").isNotNull()), lateness))
    bars = rows.groupBy("symbol", F.window("event_time", window_duration(timeframe)).alias("w")).agg(
        *trade_bar_aggs(("seq",))
    )
    return bars.select(
        "symbol",
        F.col("w.start").cast("timestamp_ntz").alias("bar"),
        *[c for c in bars.columns if c not in ("symbol", "w")],
        ratio(F.col("dollar_val"), F.col("volume")).alias("vwap"),
        ratio(F.col("vol_buy"), F.col("volume")).alias("taker_buy_ratio"),
    )


def drop_repeats(rows: DataFrame, keys: list[str], lateness: str) -> DataFrame:
    """First arrival per key within the lateness bound."""
    return with_event_time(rows, lateness).dropDuplicatesWithinWatermark(keys).drop("event_time")


def alert_stream(lines: DataFrame) -> DataFrame:
    """Critical log lines; stateless, so the batch operator serves the stream."""
    return alerts(lines)
