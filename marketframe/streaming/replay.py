"""Replays of stored tables: the same rows as a stream, in a chosen order of arrival."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.storage import materialise, new_folder


def arrivals(
    rows: DataFrame,
    ts: str,
    parts: int,
    late: Column | None = None,
    repeated: Column | None = None,
) -> DataFrame:
    """``rows`` with the number of the ``arrival`` they come with, from 0.

    Time is cut into ``parts`` equal spans.  Rows where ``late`` holds come one arrival
    after their span, rows where ``repeated`` holds come with their own and the next.
    """
    rows = materialise(rows, "replay-rows")
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    ends = rows.agg(F.min(micros).alias("lo"), F.max(micros).alias("hi")).first()
    if ends["lo"] is None:
        return rows.withColumn("arrival", F.lit(0))
    width = max(1, -(-(ends["hi"] - ends["lo"] + 1) // parts))
    at = F.floor((micros - ends["lo"]) / width).cast("int")
    never = F.lit(False)
    late, repeated = (never if c is None else F.coalesce(c, never) for c in (late, repeated))
    own = at + late.cast("int")
    return rows.withColumn(
        "arrival", F.explode(F.when(repeated, F.array(own, own + 1)).otherwise(F.array(own)))
    )


def _through(
    spark: SparkSession, arriving: DataFrame, start: Callable[[DataFrame, str], StreamingQuery]
) -> None:
    """Write one arrival after the other to a feed and run the stream over each.

    Every run starts from the checkpoint of the one before, as after a restart, and takes
    all files of its arrival.
    """
    held = new_folder(spark, "replay-parts")
    arriving.write.partitionBy("arrival").parquet(held)
    numbers = sorted(r[0] for r in arriving.select("arrival").distinct().collect())
    columns = [c for c in arriving.columns if c != "arrival"]
    schema = arriving.select(*columns).schema
    stored = spark.read.schema(arriving.schema).parquet(held)
    path, state = new_folder(spark, "replay-feed"), new_folder(spark, "replay-state")
    for k in numbers:
        stored.filter(F.col("arrival") == k).select(*columns).write.mode("append").parquet(path)
        start(spark.readStream.schema(schema).parquet(path), state).awaitTermination()


def replayed(
    spark: SparkSession, arriving: DataFrame, plan: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """What ``plan`` of the stream has written when all arrivals are through."""
    out, schema = new_folder(spark, "replay-out"), []

    def start(feed: DataFrame, state: str) -> StreamingQuery:
        stream = plan(feed)
        schema[:] = [stream.schema]
        writer = stream.writeStream.format("parquet").option("path", out).outputMode("append")
        return writer.option("checkpointLocation", state).trigger(availableNow=True).start()

    _through(spark, arriving, start)
    return spark.read.schema(schema[0]).parquet(out)


def run_batches(spark: SparkSession, arriving: DataFrame, each: Callable[[DataFrame, int], None]) -> None:
    """Hand every arrival to ``each`` as a micro-batch."""

    def start(feed: DataFrame, state: str) -> StreamingQuery:
        writer = feed.writeStream.foreachBatch(each).option("checkpointLocation", state)
        return writer.trigger(availableNow=True).start()

    _through(spark, arriving, start)
