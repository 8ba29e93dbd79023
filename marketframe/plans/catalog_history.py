"""Registered queries: bar history and health."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.storage import materialise
from ..operators import health as hl, history as hs
from . import frames, sqltext as q, views as v
from .registry import query
from .rounding import rnd, sql_rnd as R

TF = "1h"
NOW = "2024-01-31 00:30:00"
HOUR = 3_600_000_000

IX = f"{q.TRADES}, {q.bars('1 hour')}, {q.indexed('bars')}"
# Two overlapping histories of the same bars: the later one has moved closes;
# thinly traded bars have no book, bars at fixed hours are missing.
HIST = f"""{IX}, full_h AS (SELECT symbol, bar, idx, n, close, volume, taker_buy_ratio,
    CASE WHEN trade_count > 1 OR hour(bar) > 2 THEN 0.1::DOUBLE ELSE 0.0 END AS ob_spread_mean, trade_count AS ob_update_count
    FROM ix WHERE NOT (hour(bar) = 13 AND day(bar) % 7 = 3)),
  ha AS (SELECT * FROM full_h WHERE idx < n * 0.6::DOUBLE),
  hb AS (SELECT * REPLACE (close + 1 AS close) FROM full_h WHERE idx > n * 0.5::DOUBLE)"""


def full_history(spark, d):
    bars = frames.indexed_bars(spark, d, TF)
    booked = (F.col("trade_count") > 1) | (F.hour("bar") > 2)
    missing = (F.hour("bar") == 13) & (F.dayofmonth("bar") % 7 == 3)
    rows = bars.filter(~missing).select(
        "symbol", "bar", "idx", "n", "close", "volume", "taker_buy_ratio",
        F.when(booked, 0.1).otherwise(0.0).alias("ob_spread_mean"),
        F.col("trade_count").alias("ob_update_count"),
    )
    return materialise(rows, "history")


def halves(spark, d):
    full = full_history(spark, d)
    a = full.filter(F.col("idx") < F.col("n") * 0.6)
    b = full.filter(F.col("idx") > F.col("n") * 0.5).withColumn("close", F.col("close") + 1)
    return a, b


def _now():
    return F.expr(f"timestamp_ntz'{NOW}'")


@query(
    "history_merge",
    f"""WITH {HIST} SELECT symbol, bar, close FROM ha UNION ALL
    SELECT symbol, bar, close FROM hb WHERE (symbol, bar) NOT IN (SELECT (symbol, bar) FROM ha)""",
)
def history_merge(spark, d):
    return hs.merge_history(list(halves(spark, d))).select("symbol", "bar", "close")


def streak_sql(name: str, source: str, cap: int) -> str:
    """Walk from the last bar: count until the first invalid or detached bar."""
    return f"""{name}_o AS (SELECT symbol, bar, ob_spread_mean, lead(bar) OVER w AS nxt,
      max(bar) OVER (PARTITION BY symbol) AS last_bar FROM {source} WINDOW w AS (PARTITION BY symbol ORDER BY bar)),
    {name}_b AS (SELECT symbol, max(bar) AS bad FROM {name}_o
      WHERE ob_spread_mean <= 0 OR (nxt IS NOT NULL AND nxt - bar <> INTERVAL '1 hour') GROUP BY 1),
    {name} AS (SELECT o.symbol, CASE WHEN TIMESTAMP '{NOW}' - max(last_bar) > INTERVAL '2 hours' THEN 0
      ELSE least({cap}, count(*) FILTER (b.bad IS NULL OR o.bar > b.bad)) END AS streak
      FROM {name}_o o LEFT JOIN {name}_b b USING (symbol) GROUP BY 1)"""


@query("warmup", f"WITH {HIST}, {streak_sql('s', 'full_h', 60)} SELECT symbol, CAST(streak AS BIGINT) AS streak FROM s")
def warmup(spark, d):
    return hs.warmup(full_history(spark, d), TF, _now(), 60)


@query(
    "history_rescue",
    f"""WITH {HIST}, {streak_sql('sm', 'ha', 3)}, {streak_sql('sk', 'hb', 3)},
    pick AS (SELECT symbol FROM sk WHERE streak >= 3 AND symbol NOT IN (SELECT symbol FROM sm WHERE streak >= 3))
    SELECT symbol, bar, close FROM ha UNION ALL SELECT symbol, bar, close FROM hb
    WHERE symbol IN (SELECT symbol FROM pick) AND (symbol, bar) NOT IN (SELECT (symbol, bar) FROM ha)""",
)
def history_rescue(spark, d):
    a, b = halves(spark, d)
    return hs.rescue(a, b, TF, _now(), 3).select("symbol", "bar", "close")


@query(
    "cell_update",
    f"""WITH {HIST}, ch AS (SELECT symbol, bar, CASE WHEN volume > 100 THEN close END AS close, volume * 2 AS volume FROM hb)
    SELECT symbol, bar, coalesce(ch.close, f.close) AS close, {R('coalesce(ch.volume, f.volume)')} AS volume
    FROM full_h f LEFT JOIN ch USING (symbol, bar)""",
)
def cell_update(spark, d):
    full = full_history(spark, d)
    b = full.filter(F.col("idx") > F.col("n") * 0.5).withColumns(
        {
            "close": F.when(F.col("volume") > 100, F.col("close") + 1),
            "volume": F.col("volume") * 2,
        }
    )
    return hs.update_cells(full, b, ["close", "volume"]).select(
        "symbol", "bar", "close", rnd("volume").alias("volume")
    )


@query(
    "gaps",
    f"""WITH {HIST}, p AS (SELECT symbol, bar, lag(bar) OVER (PARTITION BY symbol ORDER BY bar) AS pv FROM full_h)
    SELECT symbol, pv AS gap_from, bar AS gap_to, CAST((epoch(bar) - epoch(pv)) / 3600 - 1 AS BIGINT) AS missing
    FROM p WHERE bar - pv > INTERVAL '1 hour'""",
)
def gaps(spark, d):
    return hs.gaps(full_history(spark, d), TF)


@query(
    "backfill",
    f"""WITH {HIST}, l AS (SELECT symbol, max(bar) AS lb FROM ha GROUP BY 1),
    plan AS (SELECT symbol, unnest(generate_series(lb + INTERVAL '1 hour', TIMESTAMP '{NOW}', INTERVAL '1 hour')) AS bar
      FROM l WHERE TIMESTAMP '{NOW}' - lb > INTERVAL '2 hours')
    SELECT symbol, bar, close, ob_spread_mean FROM ha UNION ALL
    SELECT symbol, bar, hb.close, 0.0 FROM plan JOIN hb USING (symbol, bar)""",
)
def backfill(spark, d):
    a, b = halves(spark, d)
    plan = hs.backfill_plan(a, TF, _now())
    return hs.backfill(a, b, plan, ["ob_spread_mean"]).select("symbol", "bar", "close", "ob_spread_mean")


@query(
    "backfill_plan",
    f"""WITH {HIST}, l AS (SELECT symbol, max(bar) AS lb FROM ha GROUP BY 1)
    SELECT symbol, unnest(generate_series(lb + INTERVAL '1 hour', TIMESTAMP '{NOW}', INTERVAL '1 hour')) AS bar
    FROM l WHERE TIMESTAMP '{NOW}' - lb > INTERVAL '2 hours'""",
)
def backfill_plan(spark, d):
    return hs.backfill_plan(halves(spark, d)[0], TF, _now()).drop("request")


@query(
    "quality_report",
    f"""WITH {HIST}, p AS (SELECT *, CASE WHEN volume > 50 THEN volume END AS v2, (idx * 37) % 7000 AS lag_ms,
      lag(bar) OVER (PARTITION BY symbol ORDER BY bar) AS pv FROM full_h),
    c AS (SELECT *, CASE WHEN pv IS NULL THEN 'first' WHEN bar - pv = INTERVAL '1 hour' THEN 'ok' ELSE 'gap' END AS cont FROM p)
    SELECT symbol, count(*) AS bars, count(*) FILTER (cont = 'gap') AS gaps, count(*) FILTER (v2 IS NULL) AS nulls,
    count(*) FILTER (ob_spread_mean <= 0) AS stale_spread, count(*) FILTER (ob_spread_mean > 0 AND ob_update_count < 5) AS frozen_book,
    count(*) FILTER (lag_ms > 5000) AS late, arg_max(cont, bar) AS latest FROM c GROUP BY 1""",
)
def quality_report(spark, d):
    rows = full_history(spark, d).withColumns(
        {
            "lag_ms": (F.col("idx") * 37) % 7000,
            "volume": F.when(F.col("volume") > 50, F.col("volume")),
        }
    )
    return hs.quality_report(rows, TF, ["close", "volume"])


LOGS = """logs AS (SELECT user_id % 10 AS service, event_id AS line_no, ts,
    CASE event_type WHEN 'error' THEN '[ERROR] code ' || user_id WHEN 'signup' THEN 'heartbeat ok'
      WHEN 'view' THEN 'poll done (HIGH LATENCY)' ELSE 'info' END
    || CASE WHEN event_id % 4 = 0 THEN ' Connection reset' ELSE '' END AS text FROM events)"""


ALERT_SQL = f"""WITH {LOGS} SELECT service, line_no, text,
    CASE WHEN contains(text, '(HIGH LATENCY)') THEN '(HIGH LATENCY)' ELSE '[ERROR]' END AS pattern
    FROM logs WHERE (contains(text, '(HIGH LATENCY)') OR contains(text, '[ERROR]')) AND NOT contains(text, 'Connection reset')"""


@query("log_alerts", ALERT_SQL)
def log_alerts(spark, d):
    return hl.alerts(v.log_lines(spark, d)).select("service", "line_no", "text", "pattern")


@query(
    "silence_gaps",
    f"""WITH {LOGS}, hb AS (SELECT DISTINCT service, ts FROM logs WHERE contains(text, 'heartbeat')),
    g AS (SELECT service, lag(ts) OVER (PARTITION BY service ORDER BY ts) AS silent_from, ts AS silent_to FROM hb
      UNION ALL SELECT service, max(ts), TIMESTAMP '{NOW}' FROM hb GROUP BY 1)
    SELECT service, silent_from, silent_to, {R('(epoch_us(silent_to) - epoch_us(silent_from)) / 1000000.0', 3)} AS seconds
    FROM g WHERE epoch_us(silent_to) - epoch_us(silent_from) > 600000000""",
)
def silence_gaps(spark, d):
    beats = hl.heartbeats(v.log_lines(spark, d), "heartbeat")
    return hl.silences(beats, ["service"], hl.SERVICE_SILENCE, _now()).withColumn(
        "seconds", rnd("seconds", 3)
    )


@query(
    "feed_silence",
    f"""WITH t AS (SELECT DISTINCT event_type AS symbol, ts FROM events),
    g AS (SELECT symbol, lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS silent_from, ts AS silent_to FROM t)
    SELECT symbol, silent_from, silent_to, {R('(epoch_us(silent_to) - epoch_us(silent_from)) / 1000000.0', 3)} AS seconds
    FROM g WHERE epoch_us(silent_to) - epoch_us(silent_from) > 60000000""",
)
def feed_silence(spark, d):
    return hl.silences(v.trades(spark, d), ["symbol"], hl.FEED_SILENCE).withColumn(
        "seconds", rnd("seconds", 3)
    )
