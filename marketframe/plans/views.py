"""The given star-schema tables seen as market data.

Each function maps a table to one logical input (trade tape, book messages,
positions, ...) row by row; the only grouping gathers at most 25 consecutive
events into one book message.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.joins import spread
from .rounding import rnd


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prop_k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trades_of(table(spark, sf_dir, "events"))


def trades_of(events: DataFrame) -> DataFrame:
    third = F.col("event_id") % 3
    return events.select(
        F.col("event_type").alias("symbol"),
        "ts",
        F.col("event_id").alias("seq"),
        F.col("value").alias("price"),
        (prop_k() + 1).cast("double").alias("size"),
        F.when(third == 0, "Buy").when(third == 1, "Sell").otherwise("Unknown").alias("side"),
    )


def trades_with_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("symbol"),
        F.col("o_orderdate").alias("ts"),
        F.col("o_orderkey").alias("seq"),
        F.col("o_totalprice").alias("price"),
        F.lit(1.0).alias("size"),
        F.when(status == "F", "buy").when(status == "O", "SELL").otherwise("none").alias("side"),
    )


def book_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per level update: 25 consecutive event ids form one message."""
    step = (F.floor(F.col("user_id") / 2) % 25).cast("int")
    bid = F.col("user_id") % 2 == 0
    # eighths are exact in binary, so equal spreads compare equal
    eighths = F.when(bid, 800 - step).otherwise(801 + step)
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"),
        F.floor(F.col("event_id") / 25).alias("seq"),
        "ts",
        F.col("event_id").alias("pos"),
        F.when(bid, "b").otherwise("a").alias("side"),
        (eighths / 8).cast("decimal(10,3)").cast("string").alias("price"),
        F.when(prop_k() % 10 == 0, 0.0).otherwise(F.col("value")).cast("string").alias("size"),
    )


def book_msgs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Book messages in the common schema, every 100th one a snapshot."""
    side = lambda s: F.transform(
        F.filter("levels", lambda x: x["side"] == s),
        lambda x: F.array(x["price"], x["size"]),
    )
    grouped = (
        book_levels(spark, sf_dir)
        .groupBy("symbol", "seq")
        .agg(
            F.max("ts").alias("ts"),
            F.array_sort(F.collect_list(F.struct("pos", "side", "price", "size"))).alias("levels"),
        )
    )
    return grouped.select(
        "symbol",
        "seq",
        "ts",
        F.when(F.col("seq") % 100 == 0, "snapshot").otherwise("delta").alias("type"),
        side("b").alias("b"),
        side("a").alias("a"),
    )


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    buy = F.col("o_orderstatus") == "F"
    p = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("trade_id"),
        F.col("o_custkey").alias("account"),
        F.col("o_orderpriority").alias("symbol"),
        F.when(buy, "Buy").otherwise("Sell").alias("side"),
        (F.lit(1) + F.col("o_custkey") % 50).alias("size"),
        p.alias("entry_price"),
        rnd(F.when(buy, p * 0.99).otherwise(p * 1.01), 2).alias("stop_loss"),
        rnd(F.when(buy, p * 1.02).otherwise(p * 0.98), 2).alias("take_profit"),
        F.col("o_orderdate").alias("entry_time"),
        F.when(F.col("o_orderstatus") == "P", "closed").otherwise("open").alias("status"),
    )


def executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as fills; the link id prefix says who placed the order."""
    li = table(spark, sf_dir, "lineitem")
    rows = li.count()
    li = spread(li, ["l_orderkey"], rows)
    od = spread(table(spark, sf_dir, "orders"), ["o_orderkey"], rows)
    flag = F.col("l_returnflag")
    prefix = F.when(flag == "N", "LIMIT-").when(flag == "A", "AUTO-").otherwise("EXT-")
    return li.join(od, li.l_orderkey == od.o_orderkey).select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("supp"),
        F.col("l_linenumber").alias("line"),
        F.concat(prefix, F.col("l_orderkey").cast("string")).alias("link_id"),
        F.col("o_custkey").alias("account"),
        F.col("o_orderpriority").alias("symbol"),
        F.when(F.col("l_linestatus") == "F", "Buy").otherwise("Sell").alias("side"),
        F.col("l_quantity").alias("qty"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_shipdate").alias("ts"),
    )


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as service log lines: errors, heartbeats, ignorable noise."""
    kind = F.col("event_type")
    text = (
        F.when(kind == "error", F.concat(F.lit("[ERROR] code "), F.col("user_id").cast("string")))
        .when(kind == "signup", F.lit("heartbeat ok"))
        .when(kind == "view", F.lit("poll done (HIGH LATENCY)"))
        .otherwise(F.lit("info"))
    )
    noise = F.col("event_id") % 4 == 0
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 10).alias("service"),
        F.col("event_id").alias("line_no"),
        "ts",
        F.when(noise, F.concat(text, F.lit(" Connection reset"))).otherwise(text).alias("text"),
    )
