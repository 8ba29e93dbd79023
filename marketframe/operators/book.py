"""Order-book reconstruction, sampling and liquidity metrics.

A book is not replayed message by message.  Every level update is valid from
its sequence number until the next update of the same level or the next
snapshot, so the book at any sample is an interval lookup.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scan import Running, running
from ..functions.storage import materialise
from ..functions.timeutil import bar_of

# Fixed value: keeps size-weighted quotients finite.
TINY = 1e-9

METRICS = [
    "spread", "micro_dev", "imbalance", "bid_depth", "ask_depth",
    "bid_slope", "ask_slope", "bid_integrity", "ask_integrity",
]
MEAN_ONLY = [
    "bid_depth", "ask_depth", "bid_slope", "ask_slope", "bid_integrity", "ask_integrity",
]


def level_updates(msgs: DataFrame) -> DataFrame:
    """One row per level of each message with numeric price and size."""
    tagged = lambda c, s: F.transform(
        c, lambda x, i: F.struct(F.lit(s).alias("side"), i.alias("pos"), x.alias("lv"))
    )
    return (
        msgs.select(
            "symbol", "seq", "epoch", "epoch_end", "last_seq",
            F.explode(F.concat(tagged("b", "b"), tagged("a", "a"))).alias("u"),
        )
        .select(
            "symbol", "seq", "epoch", "epoch_end", "last_seq", "u.side", "u.pos",
            F.col("u.lv")[0].cast("double").alias("price"),
            F.col("u.lv")[1].cast("double").alias("size"),
        )
    )


def with_epochs(
    msgs: DataFrame, bucket_seqs: int = 10_000, require_snapshot: bool = True
) -> DataFrame:
    """Add the sequence numbers of the governing and the next snapshot.

    One row per bucket of sequence numbers lists its snapshots and carries the
    neighbouring ones; messages look up their bucket.  ``last_seq`` is the
    symbol's last message.  Deltas before the first snapshot are dropped, or
    kept in epoch -1 when ``require_snapshot`` is off.
    """
    bucket = F.floor(F.col("seq") / bucket_seqs)
    snap = F.when(F.col("type") == "snapshot", F.col("seq"))
    per_bucket = msgs.groupBy("symbol", bucket.alias("_eb")).agg(
        F.collect_set(snap).alias("_snaps"), F.max("seq").alias("_max")
    )
    by = Window.partitionBy("symbol")
    before = by.orderBy("_eb").rowsBetween(Window.unboundedPreceding, -1)
    after = by.orderBy("_eb").rowsBetween(1, Window.unboundedFollowing)
    lookup = per_bucket.select(
        "symbol", "_eb", "_snaps",
        F.max(F.array_max("_snaps")).over(before).alias("_prev"),
        F.min(F.array_min("_snaps")).over(after).alias("_next"),
        F.max("_max").over(by).alias("last_seq"),
    )
    seq = F.col("seq")
    at_or_before = F.array_max(F.filter("_snaps", lambda s: s <= seq))
    later = F.array_min(F.filter("_snaps", lambda s: s > seq))
    found = F.struct(
        F.coalesce(at_or_before, "_prev", F.lit(-1).cast("long")).alias("epoch"),
        F.coalesce(later, "_next").alias("epoch_end"),
    )
    # a one-row generator: a filter on its fields stays above the join
    marked = (
        msgs.withColumn("_eb", bucket)
        .join(lookup, ["symbol", "_eb"])
        .select(*msgs.columns, "last_seq", F.inline(F.array(found)))
    )
    return marked.filter(F.col("epoch") >= 0) if require_snapshot else marked


def book_intervals(
    msgs: DataFrame, bucket_seqs: int = 10_000, require_snapshot: bool = True
) -> DataFrame:
    """Validity ``[seq_from, seq_to)`` of every level; open ends are NULL.

    The window key holds one price level of one snapshot epoch, so a busy
    symbol spreads over all its levels.
    """
    level = Window.partitionBy("symbol", "epoch", "side", "price").orderBy("seq", "pos")
    return (
        level_updates(with_epochs(msgs, bucket_seqs, require_snapshot))
        .withColumn("nxt", F.lead("seq").over(level))
        .withColumn("seq_to", F.coalesce("nxt", "epoch_end"))
        .filter((F.col("size") != 0) & (F.col("seq_to").isNull() | (F.col("seq_to") > F.col("seq"))))
        .select(
            "symbol", "epoch", "side", "price", "size", F.col("seq").alias("seq_from"), "seq_to",
            "last_seq",
        )
    )


def count_samples(
    msgs: DataFrame, every: int = 50, bucket_seqs: int = 10_000
) -> DataFrame:
    """Every ``every``-th message.

    With a ``line`` column, which counts all lines of a file from 1, bad ones included,
    those on every ``every``-th line of their file.  Messages without a file are numbered
    from 1 per symbol in the order of ``seq``, whatever gaps the numbers have; such a
    frame is read twice, so hand in a scan or a materialised intermediate.
    """
    if "line" not in msgs.columns:
        msgs = running(
            msgs.select("symbol", "seq", "ts"),
            ["symbol"],
            F.floor(F.col("seq") / bucket_seqs),
            ["seq"],
            [Running("line", "count", F.lit(1))],
        )
    return msgs.filter(F.col("line") % every == 0).select("symbol", "seq", "ts")


def time_samples(msgs: DataFrame, step: str = "1 second") -> DataFrame:
    """Last message of every time step."""
    return (
        msgs.groupBy("symbol", F.window("ts", step).alias("w"))
        .agg(F.max("seq").alias("seq"), F.max_by("ts", "seq").alias("ts"))
        .drop("w")
    )


def book_at(
    intervals: DataFrame,
    samples: DataFrame,
    bucket_seqs: int = 10_000,
) -> DataFrame:
    """Live levels at each sample: an interval join as an equi-join on sample numbers.

    Samples and both ends of every interval form one stream per symbol and chunk of
    sequence numbers; the running count of samples numbers the samples and tells each end
    how many lie before it.  An interval is copied to the samples between its ends only,
    so copies are output rows however far apart sequence numbers lie.  The sample's number
    stays as ``bucket``: later steps that name it reuse the join's partitioning.
    """
    held = ["epoch", "side", "price", "size", "seq_from"]
    # read for the numbers, the chunks' counts and the merge
    samples = materialise(samples.select("symbol", F.col("seq").alias("at"), "ts"), "samples")
    intervals = materialise(
        intervals.select("symbol", *held, F.coalesce("seq_to", F.col("last_seq") + 1).alias("_end")),
        "book-intervals",
    )
    chunk = F.floor(F.col("at") / bucket_seqs)
    numbered = running(
        samples, ["symbol"], chunk, ["at"],
        [Running("bucket", "count", F.lit(1), inclusive=False)],
    ).select("symbol", "bucket", F.col("at").alias("seq"), "ts")
    # an end goes before a sample of its number: starts include it, stops leave it out
    ends = intervals.select(
        "symbol", *held, F.explode(F.array("seq_from", "_end")).alias("at"), F.lit(0).alias("sample")
    )
    counted = running(
        ends.unionByName(samples.withColumn("sample", F.lit(1)).drop("ts"), allowMissingColumns=True),
        ["symbol"], chunk, ["at", "sample"],
        [Running("bucket", "sum", F.col("sample"), inclusive=False)],
    )
    live = (
        counted.filter("sample = 0")
        .groupBy("symbol", *held)
        .agg(F.min("bucket").alias("_first"), F.max("bucket").alias("_stop"))
        .filter(F.col("_first") < F.col("_stop"))
        .withColumn("bucket", F.explode(F.sequence(F.col("_first"), F.col("_stop") - 1)))
    )
    return numbered.join(live, ["symbol", "bucket"]).select(
        "symbol", "bucket", "seq", "ts", "side", "price", "size"
    )


def _sample_keys(df: DataFrame) -> list[str]:
    """Columns of one sample; the join bucket first where it is known."""
    return ["symbol", *(["bucket"] if "bucket" in df.columns else []), "seq"]


def top_levels(levels: DataFrame, k: int = 50) -> DataFrame:
    """Best ``k`` levels per side of each sample, ranked from 1."""
    toward = F.when(F.col("side") == "b", -F.col("price")).otherwise(F.col("price"))
    w = Window.partitionBy(*_sample_keys(levels), "side").orderBy(toward)
    return levels.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _side_sum(side: str) -> Column:
    return F.sum(F.when(F.col("side") == side, F.col("size")))


def _at_rank(side: str, col: str, extreme) -> Column:
    return extreme(F.col(col), F.when(F.col("side") == side, F.col("rank")))


def book_metrics(ranked: DataFrame) -> DataFrame:
    """Nine liquidity measures per sample; one-sided books are left out."""
    agg = ranked.groupBy(*_sample_keys(ranked), "ts").agg(
        _at_rank("b", "price", F.min_by).alias("bb"),
        _at_rank("b", "size", F.min_by).alias("bs"),
        _at_rank("a", "price", F.min_by).alias("ba"),
        _at_rank("a", "size", F.min_by).alias("as"),
        _at_rank("b", "price", F.max_by).alias("b_deep"),
        _at_rank("a", "price", F.max_by).alias("a_deep"),
        _side_sum("b").alias("bid_depth"),
        _side_sum("a").alias("ask_depth"),
    )
    c = F.col
    bid, ask = c("bid_depth"), c("ask_depth")
    positive = lambda depth, v: F.when(depth > 0, v / depth).otherwise(0.0)
    micro = (c("ba") * c("bs") + c("bb") * c("as")) / (c("bs") + c("as") + TINY)
    return agg.filter(c("bb").isNotNull() & c("ba").isNotNull()).select(
        "symbol",
        "seq",
        "ts",
        (c("ba") - c("bb")).alias("spread"),
        (micro - (c("ba") + c("bb")) / 2).alias("micro_dev"),
        ((bid - ask) / (bid + ask + TINY)).alias("imbalance"),
        bid.alias("bid_depth"),
        ask.alias("ask_depth"),
        positive(bid, c("bb") - c("b_deep")).alias("bid_slope"),
        positive(ask, c("a_deep") - c("ba")).alias("ask_slope"),
        positive(bid, c("bs")).alias("bid_integrity"),
        positive(ask, c("as")).alias("ask_integrity"),
    )


def _bar_aggs(std) -> list[Column]:
    named = lambda m, how, col: col.alias(f"ob_{m}_{how}")
    return [
        named("spread", "mean", F.avg("spread")),
        named("micro_dev", "mean", F.avg("micro_dev")),
        named("micro_dev", "std", std("micro_dev")),
        named("micro_dev", "last", F.max_by("micro_dev", "seq")),
        named("imbalance", "mean", F.avg("imbalance")),
        named("imbalance", "last", F.max_by("imbalance", "seq")),
        *[named(m, "mean", F.avg(m)) for m in MEAN_ONLY],
    ]


def book_bars(metrics: DataFrame, timeframe: str) -> DataFrame:
    """Mean, sample deviation and last value per bar, over all files at once."""
    return metrics.groupBy("symbol", bar_of(F.col("ts"), timeframe).alias("bar")).agg(
        *_bar_aggs(F.stddev_samp)
    )


def book_bars_live(metrics: DataFrame, timeframe: str) -> DataFrame:
    """Live form: one sample per timestamp, population deviation, update count.

    The earliest sample of a timestamp counts; unset timestamps (the epoch)
    are never duplicates of each other.
    """
    unset = F.col("ts") == F.expr("timestamp_ntz'1970-01-01 00:00:00'")
    same = F.when(unset, F.col("seq"))
    first = metrics.groupBy("symbol", "ts", same.alias("_u")).agg(
        F.min("seq").alias("seq"), *[F.min_by(m, "seq").alias(m) for m in METRICS]
    )
    return first.groupBy("symbol", bar_of(F.col("ts"), timeframe).alias("bar")).agg(
        F.count_distinct("ts").alias("ob_update_count"), *_bar_aggs(F.stddev_pop)
    )


def bars_with_book(bars: DataFrame, book: DataFrame) -> DataFrame:
    """Trade bars with the book bar of the same bucket; NULL where none."""
    return bars.join(book, ["symbol", "bar"], "left")


def spread_guard(tops: DataFrame, max_spread: float = 0.002) -> DataFrame:
    """Pause flag per sample: empty side or spread above ``max_spread`` of the bid.

    ``tops`` has one row per sample with ``best_bid`` and ``best_ask``.
    """
    bid, ask = F.col("best_bid"), F.col("best_ask")
    pct = F.when(bid > 0, (ask - bid) / bid)
    return tops.withColumn("spread_pct", pct).withColumn(
        "verdict",
        F.when(bid.isNull() | ask.isNull(), "pause_empty")
        .when(pct > max_spread, "pause_spread")
        .otherwise("ok"),
    )
