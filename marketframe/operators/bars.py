"""Time bars from a trade tape, and taker flow."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.num import encode_side, ratio
from ..functions.timeutil import bar_of


def _order_key(order: Sequence[str]) -> Column:
    return F.col(order[0]) if len(order) == 1 else F.struct(*order)


def with_trade_metrics(trades: DataFrame) -> DataFrame:
    """Side code, buy and sell volume, traded value per row."""
    code = encode_side(F.col("side"))
    return trades.withColumns(
        {
            "side_num": code,
            "vol_buy": F.when(code == 1, F.col("size")).otherwise(0.0),
            "vol_sell": F.when(code == -1, F.col("size")).otherwise(0.0),
            "dollar_val": F.col("price") * F.col("size"),
        }
    )


def trade_bar_aggs(order: Sequence[str]) -> list[Column]:
    key, price = _order_key(order), F.col("price")
    return [
        F.min_by(price, key).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, key).alias("close"),
        F.sum("size").alias("volume"),
        F.sum("vol_buy").alias("vol_buy"),
        F.sum("vol_sell").alias("vol_sell"),
        F.count(F.lit(1)).alias("trade_count"),
        F.sum("dollar_val").alias("dollar_val"),
    ]


def time_bars(
    trades: DataFrame,
    timeframe: str,
    order: Sequence[str] = ("ts", "seq"),
    with_path: bool = False,
) -> DataFrame:
    """OHLCV bars per symbol and epoch-aligned bucket; empty buckets are absent.

    ``order`` ranks trades inside a bar.  One total-order column (a feed
    sequence number) keeps the aggregate hash based; a tuple breaks timestamp
    ties exactly but makes Spark aggregate by sorting (about 3x slower).
    """
    aggs = trade_bar_aggs(order)
    if with_path:
        aggs.append(price_path_agg(order).alias("price_path"))
    return (
        with_trade_metrics(trades.filter(F.col("price").isNotNull()))
        .groupBy("symbol", bar_of(F.col("ts"), timeframe).alias("bar"))
        .agg(*aggs)
        .withColumns(
            {
                "vwap": ratio(F.col("dollar_val"), F.col("volume")),
                "taker_buy_ratio": ratio(F.col("vol_buy"), F.col("volume")),
            }
        )
    )


def price_path_agg(order: Sequence[str]) -> Column:
    """Prices of a bar in trade order."""
    ordered = F.array_sort(F.collect_list(F.struct(*order, "price")))
    return F.transform(ordered, lambda x: x["price"])


def price_paths(trades: DataFrame, timeframe: str, order=("ts", "seq")) -> DataFrame:
    return (
        trades.filter(F.col("price").isNotNull())
        .groupBy("symbol", bar_of(F.col("ts"), timeframe).alias("bar"))
        .agg(price_path_agg(order).alias("price_path"))
    )


def clean_bars(bars: DataFrame) -> DataFrame:
    """Bars with a positive close."""
    return bars.filter(F.col("close") > 0)


def taker_flow(trades: DataFrame, timeframe: str) -> DataFrame:
    """Share of taker buys per bar, 0.5 where nothing traded."""
    buys = F.sum(F.when(F.col("side") == "Buy", F.col("size")).otherwise(0.0))
    total = F.sum("size")
    return trades.groupBy("symbol", bar_of(F.col("ts"), timeframe).alias("bar")).agg(
        buys.alias("taker_buy_vol"),
        total.alias("taker_total_vol"),
        F.coalesce(F.when(total > 0, buys / total), F.lit(0.5)).alias("taker_buy_ratio"),
    )


def live_bars(klines: DataFrame, flow: DataFrame, book: DataFrame) -> DataFrame:
    """Closed venue bars with taker flow and book metrics, absent parts filled."""
    metrics = [c for c in book.columns if c not in ("symbol", "bar")]
    return (
        klines.select("symbol", "bar", "open", "high", "low", "close", "volume")
        .join(flow.select("symbol", "bar", "taker_buy_ratio"), ["symbol", "bar"], "left")
        .join(book, ["symbol", "bar"], "left")
        .fillna(0.5, subset=["taker_buy_ratio"])
        .fillna(0, subset=metrics)
    )
