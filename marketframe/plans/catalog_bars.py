"""Registered queries: tape, bars, book."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import num
from ..operators import bars as ob, book as bk
from . import frames, sqltext as q, views as v
from .registry import query
from .rounding import rnd, sql_rnd as R

BAR_SQL = f"""SELECT symbol, bar, open, high, low, close, {R('volume')} AS volume,
 {R('vol_buy')} AS vol_buy, {R('vol_sell')} AS vol_sell, trade_count,
 {R('dollar_val')} AS dollar_val, {R('vwap')} AS vwap, {R('taker_buy_ratio', 6)} AS taker_buy_ratio
 FROM bars"""


def _shown(bars):
    return bars.select(
        "symbol", "bar", "open", "high", "low", "close",
        rnd("volume").alias("volume"), rnd("vol_buy").alias("vol_buy"),
        rnd("vol_sell").alias("vol_sell"), "trade_count", rnd("dollar_val").alias("dollar_val"),
        rnd("vwap").alias("vwap"), rnd("taker_buy_ratio", 6).alias("taker_buy_ratio"),
    )


@query("bars", f"WITH {q.TRADES}, {q.bars('1 hour')} {BAR_SQL}")
def bars(spark, d):
    return _shown(ob.time_bars(v.trades(spark, d), "1h", order=("seq",)))


TIES = """trades AS (
  SELECT o_orderpriority AS symbol, o_orderdate AS ts, o_orderkey AS seq, o_totalprice AS price,
         1.0::DOUBLE AS size,
         CASE o_orderstatus WHEN 'F' THEN 'buy' WHEN 'O' THEN 'SELL' ELSE 'none' END AS side
  FROM orders)"""


@query("bars_ties", f"WITH {TIES}, {q.bars('1 day')} {BAR_SQL}")
def bars_ties(spark, d):
    return _shown(ob.time_bars(v.trades_with_ties(spark, d), "1d", order=("ts", "seq")))


@query(
    "price_path",
    f"""WITH {q.TRADES} SELECT symbol, time_bucket(INTERVAL '1 hour', ts) AS bar,
    array_to_string(list(price ORDER BY ts, seq), '|') AS path FROM trades GROUP BY 1, 2""",
)
def price_path(spark, d):
    paths = ob.price_paths(v.trades(spark, d), "1h")
    text = F.transform("price_path", lambda x: x.cast("string"))
    return paths.select("symbol", "bar", F.array_join(text, "|").alias("path"))


@query(
    "clean_bars",
    f"""WITH {q.TRADES}, {q.bars('5 minutes')} SELECT symbol, bar, close - 5 AS close
    FROM bars WHERE close - 5 > 0""",
)
def clean_bars(spark, d):
    shifted = ob.time_bars(v.trades(spark, d), "5m", order=("seq",)).withColumn(
        "close", F.col("close") - 5
    )
    return ob.clean_bars(shifted).select("symbol", "bar", "close")


@query(
    "side_encode",
    f"""WITH {TIES} SELECT symbol, seq, CAST(CASE lower(side) WHEN 'buy' THEN 1 WHEN 'sell' THEN -1
    ELSE 0 END AS INTEGER) AS side_num, CASE WHEN lower(side) = 'buy' THEN size ELSE 0 END AS vol_buy,
    CASE WHEN lower(side) = 'sell' THEN size ELSE 0 END AS vol_sell, price * size AS dollar_val
    FROM trades""",
)
def side_encode(spark, d):
    return ob.with_trade_metrics(v.trades_with_ties(spark, d)).select(
        "symbol", "seq", "side_num", "vol_buy", "vol_sell", "dollar_val"
    )


FLOW = """flow AS (
  SELECT symbol, time_bucket(INTERVAL '5 minutes', ts) AS bar,
    sum(CASE WHEN side = 'Buy' THEN size ELSE 0 END) AS taker_buy_vol, sum(size) AS taker_total_vol,
    CASE WHEN sum(size) > 0 THEN sum(CASE WHEN side = 'Buy' THEN size ELSE 0 END) / sum(size)
      ELSE 0.5 END AS taker_buy_ratio
  FROM trades GROUP BY 1, 2)"""


@query(
    "taker_flow",
    f"""WITH {q.TRADES}, {FLOW} SELECT symbol, bar, taker_buy_vol, taker_total_vol,
    {R('taker_buy_ratio', 6)} AS taker_buy_ratio FROM flow""",
)
def taker_flow(spark, d):
    return ob.taker_flow(v.trades(spark, d), "5m").withColumn(
        "taker_buy_ratio", rnd("taker_buy_ratio", 6)
    )


# --- book -----------------------------------------------------------------


@query(
    "book_intervals",
    f"WITH {q.INTERVALS} SELECT symbol, epoch, side, price, size, seq_from, seq_to FROM intervals",
)
def book_intervals(spark, d):
    return bk.book_intervals(v.book_msgs(spark, d)).drop("last_seq")


@query(
    "book_samples",
    f"""WITH {q.LEVELS} SELECT symbol, seq, ts FROM msgs
    QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY seq) % 50 = 0""",
)
def book_samples(spark, d):
    return bk.count_samples(frames.book_messages(spark, d))


@query(
    "book_samples_timed",
    f"""WITH {q.LEVELS} SELECT symbol, max(seq) AS seq, arg_max(ts, seq) AS ts FROM msgs
    GROUP BY symbol, time_bucket(INTERVAL '6 hours', ts)""",
)
def book_samples_timed(spark, d):
    return bk.time_samples(v.book_msgs(spark, d), "6 hours")


@query("book_at", f"WITH {q.BOOK_AT} SELECT symbol, seq, ts, side, price, size FROM book")
def book_at(spark, d):
    return frames.sampled_book(frames.book_messages(spark, d), frames.SAMPLE_EVERY).drop("bucket")


@query(
    "book_topk",
    f"WITH {q.BOOK_AT} SELECT symbol, seq, side, rank, price, size FROM ranked WHERE rank <= 5",
)
def book_topk(spark, d):
    book = frames.sampled_book(frames.book_messages(spark, d), frames.SAMPLE_EVERY)
    return bk.top_levels(book, 5).select(
        "symbol", "seq", "side", F.col("rank").cast("long").alias("rank"), "price", "size"
    )


@query(
    "book_metrics",
    f"""WITH {q.metrics(50)} SELECT symbol, seq, ts,
    {", ".join(f"{R(m, 6)} AS {m}" for m in bk.METRICS)} FROM metrics""",
)
def book_metrics(spark, d):
    return frames.book_metrics(spark, d).select(
        "symbol", "seq", "ts", *[rnd(m, 6).alias(m) for m in bk.METRICS]
    )


@query(
    "book_metrics_timed",
    f"""WITH {q.metrics(50, q.BOOK_AT_TIMES)} SELECT symbol, seq, ts,
    {", ".join(f"{R(m, 6)} AS {m}" for m in bk.METRICS)} FROM metrics""",
)
def book_metrics_timed(spark, d):
    return frames.book_metrics(spark, d, every=None, step="30 minutes").select(
        "symbol", "seq", "ts", *[rnd(m, 6).alias(m) for m in bk.METRICS]
    )


@query(
    "book_bars",
    f"""WITH {q.book_bars('1 hour')} SELECT symbol, bar,
    {", ".join(f"{R(m, 6)} AS {m}" for m in q.OB_COLUMNS)} FROM book_bars""",
)
def book_bars(spark, d):
    return bk.book_bars(frames.book_metrics(spark, d), "1h").select(
        "symbol", "bar", *[rnd(m, 6).alias(m) for m in q.OB_COLUMNS]
    )


LIVE_BOOK = q.book_bars("1 day", std="stddev_pop")


@query(
    "book_bars_live",
    f"""WITH {LIVE_BOOK}, counts AS (SELECT symbol, time_bucket(INTERVAL '1 day', ts) AS bar,
    count(DISTINCT ts) AS ob_update_count FROM metrics GROUP BY 1, 2)
    SELECT symbol, bar, ob_update_count, {", ".join(f"{R(m, 6)} AS {m}" for m in q.OB_COLUMNS)}
    FROM book_bars JOIN counts USING (symbol, bar)""",
)
def book_bars_live(spark, d):
    # every sample twice: the repeated timestamp must not count
    metrics = frames.book_metrics(spark, d)
    again = metrics.withColumns({"seq": F.col("seq") + 1, "spread": F.col("spread") + 1})
    return bk.book_bars_live(metrics.unionByName(again), "1d").select(
        "symbol", "bar", "ob_update_count", *[rnd(m, 6).alias(m) for m in q.OB_COLUMNS]
    )


@query(
    "spread_guard",
    f"""WITH {q.metrics(1)}, full_book AS (SELECT s.symbol, s.seq, a.bb AS best_bid, a.ba AS best_ask
      FROM samples s LEFT JOIN agg a USING (symbol, seq)),
    p AS (SELECT *, CASE WHEN best_bid > 0 THEN (best_ask - best_bid) / best_bid END AS pct FROM full_book)
    SELECT symbol, seq, best_bid, best_ask, {R('pct', 6)} AS spread_pct,
    CASE WHEN best_bid IS NULL OR best_ask IS NULL THEN 'pause_empty'
         WHEN pct > 0.002 THEN 'pause_spread' ELSE 'ok' END AS verdict FROM p""",
)
def spread_guard(spark, d):
    msgs = frames.book_messages(spark, d)
    book = frames.sampled_book(msgs, frames.SAMPLE_EVERY)
    best = lambda s, f: f(F.when(F.col("side") == s, F.col("price")))
    tops = book.groupBy("symbol", "seq").agg(
        best("b", F.max).alias("best_bid"), best("a", F.min).alias("best_ask")
    )
    samples = bk.count_samples(msgs, frames.SAMPLE_EVERY).select("symbol", "seq")
    guarded = bk.spread_guard(samples.join(tops, ["symbol", "seq"], "left"))
    return guarded.withColumn("spread_pct", rnd("spread_pct", 6))


@query(
    "bars_joined",
    f"""WITH {q.joined('5 minutes')}, {q.indexed('joined')} SELECT symbol, bar, close, idx, n,
    {", ".join(f"{R(m, 6)} AS {m}" for m in q.OB_COLUMNS)} FROM ix""",
)
def bars_joined(spark, d):
    return frames.joined_bars(spark, d).select(
        "symbol", "bar", "close", "idx", "n", *[rnd(m, 6).alias(m) for m in q.OB_COLUMNS]
    )


@query(
    "live_bars",
    f"""WITH {q.book_bars('5 minutes', std='stddev_pop')}, {q.TRADES}, {q.bars('5 minutes')}, {FLOW}
    SELECT symbol, bar, b.open, b.close, {R('b.volume')} AS volume,
    {R('coalesce(f.taker_buy_ratio, 0.5)', 6)} AS taker_buy_ratio,
    {R('coalesce(ob_spread_mean, 0)', 6)} AS ob_spread_mean,
    {R('coalesce(ob_imbalance_last, 0)', 6)} AS ob_imbalance_last,
    CASE WHEN ob_spread_mean IS NULL THEN 0 ELSE 1 END AS has_book
    FROM bars b LEFT JOIN flow f USING (symbol, bar) LEFT JOIN book_bars USING (symbol, bar)""",
)
def live_bars(spark, d):
    trades = v.trades(spark, d)
    rows = ob.live_bars(
        ob.time_bars(trades, "5m", order=("seq",)),
        ob.taker_flow(trades, "5m"),
        bk.book_bars_live(frames.book_metrics(spark, d), "5m"),
    )
    return rows.select(
        "symbol", "bar", "open", "close", rnd("volume").alias("volume"),
        rnd("taker_buy_ratio", 6).alias("taker_buy_ratio"),
        rnd("ob_spread_mean", 6).alias("ob_spread_mean"),
        rnd("ob_imbalance_last", 6).alias("ob_imbalance_last"),
        F.when(F.col("ob_update_count") > 0, 1).otherwise(0).alias("has_book"),
    )


@query(
    "sanitize",
    f"""WITH {q.TRADES}, x AS (SELECT symbol, seq, CASE WHEN size = 14 THEN 'null' WHEN size < 10 THEN 'nan'
      WHEN price > 100 THEN 'inf' WHEN price < 1 THEN 'ninf' ELSE 'num' END AS kind, price FROM trades)
    SELECT symbol, seq, CASE WHEN kind = 'num' THEN price ELSE 0 END AS live,
    CASE kind WHEN 'nan' THEN 0 WHEN 'null' THEN 0 WHEN 'inf' THEN 1.7976931348623157e308
      WHEN 'ninf' THEN -1.7976931348623157e308 ELSE price END AS model_input FROM x""",
)
def sanitize(spark, d):
    """Prices with NULL, NaN and infinities put in by size and price."""
    raw = v.trades(spark, d).withColumn(
        "x",
        F.when(F.col("size") == 14, None)
        .when(F.col("size") < 10, float("nan"))
        .when(F.col("price") > 100, float("inf"))
        .when(F.col("price") < 1, float("-inf"))
        .otherwise(F.col("price")),
    )
    return raw.select(
        "symbol", "seq", num.zero_fill_live(F.col("x")).alias("live"),
        num.clamp_model_input(F.col("x")).alias("model_input"),
    )
