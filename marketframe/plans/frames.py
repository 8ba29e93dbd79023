"""End-to-end plans over the given tables: book, joined bars, features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scan import with_row_index
from ..functions.storage import materialise
from ..operators import bars as ob, book as bk
from ..operators.features import add_features
from . import views as v

# Messages per sample where a plan samples by count.
SAMPLE_EVERY = 5
SAMPLE_STEP = "1 second"
LEVELS = 50
TIMEFRAME = "5m"
BOOK_COLUMNS = [
    "ob_spread_mean", "ob_micro_dev_mean", "ob_micro_dev_std", "ob_micro_dev_last",
    "ob_imbalance_mean", "ob_imbalance_last", "ob_bid_depth_mean", "ob_ask_depth_mean",
    "ob_bid_slope_mean", "ob_ask_slope_mean", "ob_bid_integrity_mean", "ob_ask_integrity_mean",
]


def book_messages(spark: SparkSession, d: str) -> DataFrame:
    # parsed and gathered once, then read as columns
    return materialise(v.book_msgs(spark, d), "book-messages")


def sampled_book(
    msgs: DataFrame, every: int | None = None, step: str = SAMPLE_STEP
) -> DataFrame:
    """The book at the last message of each time step, or at every ``every``-th message."""
    samples = bk.count_samples(msgs, every) if every else bk.time_samples(msgs, step)
    return bk.book_at(bk.book_intervals(msgs), samples)


def book_metrics(
    spark: SparkSession, d: str, every: int | None = SAMPLE_EVERY, step: str = SAMPLE_STEP
) -> DataFrame:
    book = sampled_book(book_messages(spark, d), every, step)
    return bk.book_metrics(bk.top_levels(book, LEVELS))


def indexed_bars(spark: SparkSession, d: str, timeframe: str = TIMEFRAME) -> DataFrame:
    """Trade bars with dense row numbers.

    Bars are written once: they are orders of magnitude fewer than trades and
    every later step reads them more than once.
    """
    bars = ob.time_bars(v.trades(spark, d), timeframe, order=("seq",))
    return with_row_index(materialise(bars, "bars"), "bar", valid=F.col("close") > 0)


def joined_bars(spark: SparkSession, d: str, timeframe: str = TIMEFRAME) -> DataFrame:
    """Bars with forward-filled book columns (0 before the first book bar)."""
    bars = ob.time_bars(v.trades(spark, d), timeframe, order=("seq",))
    book = bk.book_bars(book_metrics(spark, d), timeframe)
    joined = materialise(bk.bars_with_book(bars, book), "joined")
    return with_row_index(
        joined, "bar", fill=BOOK_COLUMNS, valid=F.col("close") > 0
    ).fillna(0.0, subset=BOOK_COLUMNS)


def features(spark: SparkSession, d: str, groups=("trend", "flow", "book", "regime")) -> DataFrame:
    """Feature frame; the book side is built only if a group needs it."""
    bars = joined_bars(spark, d) if "book" in groups else indexed_bars(spark, d)
    return add_features(bars, groups)


def bars_with_atr(spark: SparkSession, d: str) -> DataFrame:
    return add_features(indexed_bars(spark, d), groups=())
