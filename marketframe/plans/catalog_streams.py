"""Registered queries: stored tables replayed as streams, equal to their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.storage import new_folder
from ..operators import bars as ob, features as ft
from ..streaming import feeds
from ..streaming.bar_close import BarClose
from ..streaming.replay import arrivals, replayed, run_batches
from . import frames, sqltext as q, views as v
from .catalog_features import DIGITS, TREND_SQL
from .catalog_history import ALERT_SQL
from .registry import query
from .rounding import rnd, sql_rnd as R

PARTS = 4
#: Longer than the delay of a late row, shorter than that of a lost one.
LATENESS = "20 days"


@query(
    "stream_bars",
    f"""WITH {q.TRADES}, {q.bars('1 hour')} SELECT symbol, bar, open, high, low, close, trade_count,
    {R('volume')} AS volume, {R('vwap')} AS vwap FROM bars""",
)
def stream_bars(spark, d):
    """Bars of a feed with late trades, lost trades and one that closes the last bars."""
    trades = v.trades(spark, d)
    feed = arrivals(trades, "ts", PARTS, late=F.col("seq") % 11 == 0)
    last = feed.agg(F.max("arrival").alias("n"), F.max("ts").alias("ts")).first()
    # trades of two months ago that arrive at the end are behind the watermark
    lost = trades.filter(F.col("seq") % 97 == 0).withColumns(
        {"ts": F.col("ts") - F.expr("INTERVAL '60' DAY"), "arrival": F.lit(last["n"])}
    )
    closer = trades.limit(1).withColumns(
        {
            "symbol": F.lit("closer"),
            "ts": F.lit(last["ts"]).cast("timestamp_ntz") + F.expr("INTERVAL '90' DAY"),
            "arrival": F.lit(last["n"] + 1),
        }
    )
    bars = replayed(
        spark,
        feed.unionByName(lost).unionByName(closer),
        lambda stream: feeds.stream_bars(stream, "1h", LATENESS),
    )
    return bars.filter("symbol <> 'closer'").select(
        "symbol", "bar", "open", "high", "low", "close", "trade_count",
        rnd("volume").alias("volume"), rnd("vwap").alias("vwap"),
    )


@query(
    "stream_repeats",
    f"WITH {q.TRADES} SELECT symbol, seq, ts, price, size, side FROM trades",
)
def stream_repeats(spark, d):
    """Trades of which every fifth arrives again with the next arrival."""
    feed = arrivals(v.trades(spark, d), "ts", PARTS, repeated=F.col("seq") % 5 == 0)
    return replayed(
        spark, feed, lambda stream: feeds.drop_repeats(stream, ["symbol", "seq"], LATENESS)
    ).select("symbol", "seq", "ts", "price", "size", "side")


@query("stream_alerts", ALERT_SQL)
def stream_alerts(spark, d):
    """Critical log lines of a feed of which every ninth line comes late."""
    feed = arrivals(v.log_lines(spark, d), "ts", PARTS, late=F.col("line_no") % 9 == 0)
    return replayed(spark, feed, feeds.alert_stream).select("service", "line_no", "text", "pattern")


def closed_bars(spark, d, groups):
    """Bars through the bar-close target, day by day of arrival; the folder it writes.

    Bars without a price are part of the history: they raise alerts and count in windows.
    """
    bars = ob.time_bars(v.trades(spark, d), frames.TIMEFRAME, order=("seq",))
    late = F.pmod(F.unix_micros(F.col("bar").cast("timestamp")) / 300_000_000, F.lit(7))
    bars = bars.withColumns(
        {
            # every seventh bar is processed six seconds after its end, the others one
            "processed_at": F.col("bar") + F.make_dt_interval(secs=300 + F.when(late == 0, 6).otherwise(1)),
            "ob_spread_mean": F.when(F.col("trade_count") % 2 == 0, 0.0).otherwise(0.1),
            "ob_update_count": F.col("trade_count"),
        }
    )
    root = new_folder(spark, "bar-close")
    run_batches(spark, arrivals(bars, "bar", PARTS), BarClose(root, frames.TIMEFRAME, groups=groups))
    return root


@query("bar_close", TREND_SQL)
def bar_close(spark, d):
    root = closed_bars(spark, d, ("trend",))
    return spark.read.parquet(f"{root}/features").select(
        "symbol", "bar", *[rnd(n, DIGITS).alias(n) for n in ft.TREND]
    )


@query(
    "bar_alerts",
    f"""WITH {q.TRADES}, {q.bars()}, p AS (SELECT symbol, bar, trade_count,
      lag(bar) OVER (PARTITION BY symbol ORDER BY bar) AS before FROM bars)
    SELECT symbol, bar, 'gap' AS alert FROM p WHERE bar - before <> INTERVAL '5 minutes'
    UNION ALL SELECT symbol, bar, 'latency' FROM p WHERE (epoch(bar) // 300) % 7 = 0
    UNION ALL SELECT symbol, bar, 'stale_spread' FROM p WHERE trade_count % 2 = 0
    UNION ALL SELECT symbol, bar, 'frozen_book' FROM p WHERE trade_count % 2 = 1 AND trade_count < 5""",
)
def bar_alerts(spark, d):
    return spark.read.parquet(f"{closed_bars(spark, d, ())}/alerts").select("symbol", "bar", "alert")
