"""Registered queries: signals, outcomes, statistics, sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.storage import materialise
from ..operators import bars as ob, models as md, signals as sg, sweeps
from . import frames, sqltext as q, views as v
from .catalog_labels import BARS_ATR
from .registry import query
from .rounding import rnd, sql_rnd as R

ONE = [sg.Strategy()]
# Parameter values of a small sweep around the defaults.
SWEEP = [
    sg.Strategy(offset=o, take_profit=tp, stop_loss=sl, horizon=30, max_hold=60, threshold=th)
    for o, tp, sl, th in [(0.5, 1.0, 1.0, 0.7), (0.88, 2.4, 3.2, 0.62), (1.5, 3.0, 2.5, 0.8), (2.0, 1.2, 1.9, 0.74)]
]


def scored(spark, d):
    """Bars with deterministic scores in [0, 1)."""
    cents = F.round(F.col("close") * 100).cast("long")
    mix = lambda a, b: ((cents * a + F.col("idx") * b) % 100) / 100.0
    return frames.bars_with_atr(spark, d).withColumns(
        {
            "pred_long": mix(37, 11), "pred_short": mix(53, 7),
            "pred_dir_long": mix(29, 13), "pred_dir_short": mix(41, 17),
        }
    )


def _mix(a, b):
    return f"((CAST(round(close * 100) AS BIGINT) * {a} + idx * {b}) % 100) / 100.0::DOUBLE"


SCORED = f"""{BARS_ATR}, sc AS (SELECT *, {_mix(37, 11)} AS pred_long, {_mix(53, 7)} AS pred_short,
  {_mix(29, 13)} AS pred_dir_long, {_mix(41, 17)} AS pred_dir_short FROM fa)"""


def signals_sql(sets=(), rows: str = "") -> str:
    """Signals of listed sets, or of those that a query gives as ``rows``."""
    listed = ", ".join(
        f"({k}, {s.offset}, {s.horizon}, {s.max_hold}, {s.stop_loss}, {s.take_profit}, {s.threshold}, {s.direction}, {s.aggressive})"
        for k, s in enumerate(sets)
    )
    side = lambda n, name, sign: f"""SELECT set_id, symbol, bar, idx, n, close, atr, '{name}' AS side, {sign} AS sgn,
      CASE WHEN pred_dir_{n} > aggr THEN 'market' WHEN pred_{n} > thr AND pred_dir_{n} > dirn THEN 'limit' END AS kind,
      off, hor, hold, slm, tpm FROM sc, params WHERE atr > 0"""
    return f"""{SCORED}, params(set_id, off, hor, hold, slm, tpm, thr, dirn, aggr) AS ({rows or f"VALUES {listed}"}),
    sig0 AS ({side('long', 'Buy', 1)} UNION ALL {side('short', 'Sell', -1)}),
    sig AS (SELECT *, close - sgn * CASE WHEN kind = 'limit' THEN atr * off ELSE 0 END AS price,
      row_number() OVER () AS sid FROM sig0 WHERE kind IS NOT NULL)"""


@query(
    "signals",
    f"""WITH {signals_sql(ONE)} SELECT symbol, bar, side, kind, {R('price')} AS price FROM sig""",
)
def signals(spark, d):
    return sg.signals(scored(spark, d), ONE).select(
        "symbol", "bar", "side", "kind", rnd("price").alias("price")
    )


def outcomes_sql(sets=(), rows: str = "") -> str:
    return f"""{signals_sql(sets, rows)},
    e1 AS (SELECT s.sid, min(b.idx) AS eidx FROM sig s JOIN fa b ON b.symbol = s.symbol
      AND b.idx BETWEEN s.idx + 1 AND s.idx + s.hor AND s.kind = 'limit'
      AND CASE WHEN sgn > 0 THEN b.low <= s.price ELSE b.high >= s.price END GROUP BY 1),
    ent0 AS (SELECT s.*, b.idx AS eidx, b.bar AS ebar,
      CASE WHEN sgn > 0 THEN least(b.open, s.price) ELSE greatest(b.open, s.price) END AS epx
      FROM sig s JOIN e1 USING (sid) JOIN fa b ON b.symbol = s.symbol AND b.idx = e1.eidx
      UNION ALL SELECT s.*, idx, bar, close FROM sig s WHERE kind = 'market'),
    ent AS (SELECT *, epx + sgn * atr * tpm * CASE WHEN kind = 'market' THEN 10.0 ELSE 1.0 END AS tp,
      epx - sgn * atr * slm AS sl FROM ent0),
    {exit_sql('ent')}"""


def exit_sql(ent: str) -> str:
    touch_sl = "CASE WHEN sgn > 0 THEN b.low <= e.sl ELSE b.high >= e.sl END"
    touch_tp = "CASE WHEN sgn > 0 THEN b.high >= e.tp ELSE b.low <= e.tp END"
    return f"""x1 AS (SELECT e.sid, min(b.idx) AS xidx, arg_min({touch_sl}, b.idx) AS stopped
      FROM {ent} e JOIN fa b ON b.symbol = e.symbol AND b.idx BETWEEN e.eidx + 1 AND e.eidx + e.hold
      AND ({touch_sl} OR {touch_tp}) GROUP BY 1)"""


LEDGER_SQL = """dec AS (SELECT e.*, CASE WHEN x.sid IS NOT NULL THEN CASE WHEN x.stopped THEN 'stop' ELSE 'target' END
      WHEN eidx + hold < n THEN 'time' END AS xkind,
      coalesce(x.xidx, CASE WHEN eidx + hold < n THEN eidx + hold END) AS xidx FROM ent e LEFT JOIN x1 x USING (sid)),
    dec2 AS (SELECT d.*, b.bar AS xbar, CASE xkind WHEN 'stop' THEN sl WHEN 'target' THEN tp WHEN 'time' THEN b.close END AS xpx,
      10000.0::DOUBLE * 0.013 / (d.atr * slm) AS sz FROM dec d LEFT JOIN fa b ON b.symbol = d.symbol AND b.idx = d.xidx),
    ledger AS (SELECT set_id, symbol, bar, idx, side, kind, eidx AS entry_idx, ebar AS entry_bar, epx AS entry_price,
      xidx AS exit_idx, xbar AS exit_bar, xkind AS exit_kind, xpx AS exit_price, sz AS size,
      epx * sz * CASE WHEN kind = 'limit' THEN 0.0002 ELSE 0.0006 END AS entry_fee,
      (xpx - epx) * sz * sgn - xpx * sz * CASE WHEN xkind = 'target' THEN 0.0002 ELSE 0.0006 END AS pnl FROM dec2)"""

SHOWN_SQL = f"""SELECT symbol, bar, side, kind, entry_idx, {R('entry_price')} AS entry_price, exit_idx, exit_bar,
  exit_kind, {R('exit_price')} AS exit_price, {R('entry_fee')} AS entry_fee, {R('pnl')} AS pnl FROM ledger"""


def _shown(ledger):
    return ledger.select(
        "symbol", "bar", "side", "kind", "entry_idx", rnd("entry_price").alias("entry_price"),
        "exit_idx", "exit_bar", "exit_kind", rnd("exit_price").alias("exit_price"),
        rnd("entry_fee").alias("entry_fee"), rnd("pnl").alias("pnl"),
    )


def ledger(spark, d, sets):
    bars = materialise(scored(spark, d), "scored")
    if len(sets) > 1:
        return sg.sweep(bars, sweeps.table_of(spark, sets))
    return sg.outcomes(bars, sg.signals(bars, sets), sets[0].reach)


@query("outcomes", f"WITH {outcomes_sql(ONE)}, {LEDGER_SQL} {SHOWN_SQL}")
def outcomes(spark, d):
    return _shown(ledger(spark, d, ONE))


# trades numbered inside their bar decide the order of crossings
TICK_SQL = f"""{signals_sql(ONE)},
  tk AS (SELECT i.symbol, i.idx, t.seq, t.price AS px FROM fa i JOIN trades t
    ON t.symbol = i.symbol AND time_bucket(INTERVAL '5 minutes', t.ts) = i.bar),
  e1 AS (SELECT s.sid, min(b.idx) AS eidx FROM sig s JOIN fa b ON b.symbol = s.symbol
    AND b.idx BETWEEN s.idx + 1 AND s.idx + s.hor AND s.kind = 'limit'
    AND CASE WHEN sgn > 0 THEN b.low <= s.price ELSE b.high >= s.price END GROUP BY 1),
  e2 AS (SELECT s.sid, e1.eidx, min(t.seq) AS eseq, arg_min(t.px, t.seq) AS epx FROM sig s JOIN e1 USING (sid)
    JOIN tk t ON t.symbol = s.symbol AND t.idx = e1.eidx AND s.sgn * (t.px - s.price) <= 0 GROUP BY 1, 2),
  ent0 AS (SELECT s.*, b.idx AS eidx, b.bar AS ebar, e2.epx, e2.eseq FROM sig s JOIN e2 USING (sid)
    JOIN fa b ON b.symbol = s.symbol AND b.idx = e2.eidx
    UNION ALL SELECT s.*, idx, bar, close, NULL FROM sig s WHERE kind = 'market'),
  ent AS (SELECT *, epx + sgn * atr * tpm * CASE WHEN kind = 'market' THEN 10.0 ELSE 1.0 END AS tp,
    epx - sgn * atr * slm AS sl FROM ent0),
  x1 AS (SELECT e.sid, arg_min(t.idx, t.seq) AS xidx, arg_min(e.sgn * (t.px - e.sl) <= 0, t.seq) AS stopped
    FROM ent e JOIN tk t ON t.symbol = e.symbol
     AND (t.idx BETWEEN e.eidx + 1 AND e.eidx + e.hold OR (e.kind = 'limit' AND t.idx = e.eidx AND t.seq > e.eseq))
     AND (e.sgn * (t.px - e.sl) <= 0 OR e.sgn * (t.px - e.tp) >= 0) GROUP BY 1)"""


@query("outcomes_tick", f"WITH {TICK_SQL}, {LEDGER_SQL} {SHOWN_SQL}")
def outcomes_tick(spark, d):
    bars = materialise(scored(spark, d), "scored")
    out = sg.outcomes_tick(
        bars, v.trades(spark, d), sg.signals(bars, ONE), ONE[0].reach, frames.TIMEFRAME, order=("seq",)
    )
    return _shown(out)


# the entry fee is charged at entry, the profit booked at exit
CURVE_SQL = """ev AS (SELECT set_id, symbol, idx, side, entry_bar AS event_bar, 1 AS step, 'entry' AS event,
    -entry_fee AS amount, NULL::DOUBLE AS pnl FROM ledger
    UNION ALL SELECT set_id, symbol, idx, side, exit_bar, 0, 'exit', pnl, pnl FROM ledger WHERE exit_bar IS NOT NULL),
  curve0 AS (SELECT *, 10000.0::DOUBLE + sum(amount) OVER (PARTITION BY set_id, symbol
    ORDER BY event_bar, step, idx, side ROWS UNBOUNDED PRECEDING) AS equity FROM ev),
  curve AS (SELECT *, greatest(10000.0, max(equity) OVER (PARTITION BY set_id, symbol
    ORDER BY event_bar, step, idx, side ROWS UNBOUNDED PRECEDING)) AS peak FROM curve0)"""
ONE_CURVE = f"WITH {outcomes_sql(ONE)}, {LEDGER_SQL}, {CURVE_SQL}"


def curve(spark, d, sets):
    return sg.equity_curve(materialise(ledger(spark, d, sets), "ledger"))


@query(
    "equity_curve",
    f"""{ONE_CURVE} SELECT symbol, event_bar, event, idx, side, {R('amount', 3)} AS amount, {R('equity', 3)} AS equity
    FROM curve""",
)
def equity_curve(spark, d):
    return curve(spark, d, ONE).select(
        "symbol", "event_bar", "event", "idx", "side", rnd("amount", 3).alias("amount"),
        rnd("equity", 3).alias("equity"),
    )


@query(
    "drawdown",
    f"""{ONE_CURVE} SELECT symbol, count(pnl) AS trades, {R('max(peak)')} AS peak,
    {R('min((equity - peak) / peak)', 5)} AS worst FROM curve GROUP BY 1""",
)
def drawdown(spark, d):
    return curve(spark, d, ONE).groupBy("symbol").agg(
        F.count(F.when(F.col("event") == "exit", 1)).alias("trades"), rnd(F.max("peak")).alias("peak"),
        rnd(F.min("drawdown"), 5).alias("worst"),
    )


STATS_SQL = """stats AS (SELECT set_id, symbol, count(pnl) AS trades,
    avg(CASE WHEN pnl > 0 THEN 1.0::DOUBLE WHEN event = 'exit' THEN 0 END) AS win_rate,
    sum(amount) / 10000.0::DOUBLE AS total_return, 10000.0::DOUBLE + sum(amount) AS final_equity, abs(min((equity - peak) / peak)) AS max_drawdown,
    CASE WHEN count(CASE WHEN pnl < 0 THEN 1 END) = 0 THEN CASE WHEN avg(pnl) > 0 THEN 10.0::DOUBLE ELSE -10.0 END
      ELSE coalesce(avg(pnl) / nullif(sqrt(avg(CASE WHEN pnl < 0 THEN pnl * pnl END)), 0), 0) END AS sortino
    FROM curve GROUP BY 1, 2 HAVING count(pnl) > 0)"""
STAT_COLS = ["win_rate", "total_return", "final_equity", "max_drawdown", "sortino"]


@query(
    "trade_stats",
    f"""{ONE_CURVE}, {STATS_SQL} SELECT symbol, trades,
    {", ".join(f"{R(c, 3 if c == 'final_equity' else 5)} AS {c}" for c in STAT_COLS)} FROM stats""",
)
def trade_stats(spark, d):
    stats = sg.trade_stats(curve(spark, d, ONE))
    return stats.select(
        "symbol", "trades",
        *[rnd(c, 3 if c == "final_equity" else 5).alias(c) for c in STAT_COLS],
    )


SWEEP_SQL = f"WITH {outcomes_sql(SWEEP)}, {LEDGER_SQL}, {CURVE_SQL}, {STATS_SQL}"


@query(
    "sweep",
    f"""{SWEEP_SQL} SELECT CAST(set_id AS INTEGER) AS set_id, symbol, trades, {R('total_return', 5)} AS total_return,
    {R('max_drawdown', 5)} AS max_drawdown, {R('sortino', 5)} AS sortino FROM stats""",
)
def sweep(spark, d):
    return sg.trade_stats(curve(spark, d, SWEEP)).select(
        "set_id", "symbol", "trades", rnd("total_return", 5).alias("total_return"),
        rnd("max_drawdown", 5).alias("max_drawdown"), rnd("sortino", 5).alias("sortino"),
    )


# A search of drawn sets: every one trades hourly bars that look at most eight bars ahead.
DRAWN, DRAWN_REACH = 200, 8


def drawn_values(spark):
    """Drawn parameters under the names of the strategy."""
    drawn = md.sweep_values(spark, DRAWN, md.SEARCH_RANGES)
    return sweeps.renamed(drawn, md.STRATEGY_NAMES).withColumns(
        {"horizon": F.lit(DRAWN_REACH), "max_hold": F.lit(DRAWN_REACH)}
    )


def _drawn_sql() -> str:
    names = list(md.SEARCH_RANGES)

    def value(name):
        lo, hi, _ = md.SEARCH_RANGES[name]
        step, start = md.sequence_step(names.index(name), 42)
        return f"{float(lo)!r}::DOUBLE + (({start!r}::DOUBLE + k * {step!r}::DOUBLE) % 1.0::DOUBLE) * {hi - lo!r}::DOUBLE"

    order = ["stop_loss_atr", "take_profit_atr", "model_threshold", "direction_threshold", "aggressive_threshold"]
    return f"""SELECT k, {value("limit_offset_atr")}, {DRAWN_REACH}, {DRAWN_REACH},
      {", ".join(map(value, order))} FROM range({DRAWN}) r(k)"""


@query(
    "sweep_drawn",
    f"""WITH {outcomes_sql(rows=_drawn_sql())}, {LEDGER_SQL} SELECT CAST(set_id AS INTEGER) AS set_id, symbol,
    count(*) AS trades, count_if(pnl > 0) AS wins, count_if(exit_kind = 'stop') AS stops,
    {R('sum(pnl)', 2)} AS pnl FROM ledger WHERE exit_kind IS NOT NULL GROUP BY 1, 2""",
)
def sweep_drawn(spark, d):
    bars = materialise(scored(spark, d), "scored")
    done = sg.sweep(bars, drawn_values(spark)).filter(F.col("exit_kind").isNotNull())
    return done.groupBy("set_id", "symbol").agg(
        F.count("*").alias("trades"),
        F.count_if(F.col("pnl") > 0).alias("wins"),
        F.count_if(F.col("exit_kind") == "stop").alias("stops"),
        rnd(F.sum("pnl"), 2).alias("pnl"),
    )


SCORE_SQL = """sco AS (SELECT set_id, count(*) AS folds, avg(score) - 0.5 * stddev_pop(score) AS score FROM
    (SELECT set_id, (CASE WHEN trades >= 3 THEN sortino * ln(trades) ELSE -0.1 END) / (1 + max_drawdown * 5) AS score
     FROM stats) GROUP BY 1)"""


@query(
    "trial_score",
    f"""{SWEEP_SQL}, {SCORE_SQL} SELECT CAST(set_id AS INTEGER) AS set_id, folds, {R('score', 5)} AS score FROM sco""",
)
def trial_score(spark, d):
    return sg.trial_score(sg.trade_stats(curve(spark, d, SWEEP))).withColumn("score", rnd("score", 5))


@query(
    "best_trial",
    f"""{SWEEP_SQL}, {SCORE_SQL} SELECT CAST(set_id AS INTEGER) AS set_id, folds, {R('score', 5)} AS score FROM sco
    ORDER BY sco.score DESC, sco.set_id LIMIT 2""",
)
def best_trial(spark, d):
    scores = sg.trial_score(sg.trade_stats(curve(spark, d, SWEEP)))
    return sg.best(scores, 2).withColumn("score", rnd("score", 5))


@query(
    "sizing",
    f"""WITH {signals_sql(ONE)}, k AS (SELECT *, CASE WHEN idx % 11 = 0 THEN 0.0::DOUBLE ELSE 50.0 + idx % 400 END AS wallet,
      0.01::DOUBLE AS tick, 0.05::DOUBLE AS step, 0.1::DOUBLE AS minq, 5.0::DOUBLE AS minn FROM sig),
    q1 AS (SELECT *, CASE WHEN atr * slm = 0 THEN price * 0.01 ELSE atr * slm END AS dist FROM k),
    q2 AS (SELECT *, wallet * 0.013 / nullif(dist, 0) AS raw FROM q1),
    q3 AS (SELECT *, CASE WHEN raw < minq THEN 0.0::DOUBLE ELSE round(round_even(raw / step, 0) * step, 8) END AS qty,
      round(round_even(price / tick, 0) * tick, 8) AS order_price FROM q2)
    SELECT symbol, bar, side, kind, qty, {R('order_price')} AS order_price,
     {R("round(round_even((order_price - sgn * dist) / tick, 0) * tick, 8)")} AS stop_price,
     {R("round(round_even((order_price + sgn * atr * tpm * CASE WHEN kind = 'market' THEN 10.0 ELSE 1.0 END) / tick, 0) * tick, 8)")} AS target_price,
     CASE WHEN wallet <= 0 THEN 'no_balance' WHEN qty <= 0 THEN 'too_small'
       WHEN qty * price < minn THEN 'min_notional' END AS reject FROM q3""",
)
def sizing(spark, d):
    wallet = F.when(F.col("idx") % 11 == 0, 0.0).otherwise(50.0 + F.col("idx") % 400)
    ready = sg.signals(scored(spark, d), ONE).withColumns(
        {"wallet": wallet, "tick_size": F.lit(0.01), "qty_step": F.lit(0.05),
         "min_qty": F.lit(0.1), "min_notional": F.lit(5.0)}
    )
    return sg.size_orders(ready).select(
        "symbol", "bar", "side", "kind", "qty",
        *[rnd(c).alias(c) for c in ("order_price", "stop_price", "target_price")], "reject",
    )


@query(
    "blend",
    f"""WITH {SCORED} SELECT symbol, bar,
    {R('CASE WHEN idx >= 59 THEN pred_dir_long * pred_long + (1 - pred_dir_long) * pred_short ELSE pred_long END', 6)} AS pred_long,
    {R('CASE WHEN idx >= 59 THEN pred_dir_long * pred_short + (1 - pred_dir_long) * pred_long ELSE pred_short END', 6)} AS pred_short,
    {R('CASE WHEN idx >= 59 THEN pred_dir_long ELSE 1 END', 6)} AS gate_weight,
    {R('CASE WHEN idx >= 59 THEN pred_short ELSE 0 END', 6)} AS lstm_long FROM sc""",
)
def blend(spark, d):
    rows = materialise(scored(spark, d), "scored")
    primary = rows.select(
        "symbol", "bar", "idx", F.col("pred_long").alias("base_long"), F.col("pred_short").alias("base_short")
    )
    second = rows.filter(F.col("idx") >= 59).select(
        "symbol", "idx", F.col("pred_short").alias("seq_long"), F.col("pred_long").alias("seq_short"),
        F.col("pred_dir_long").alias("gate"),
    )
    out = sg.blend(primary, second)
    return out.select(
        "symbol", "bar",
        *[rnd(c, 6).alias(c) for c in ("pred_long", "pred_short", "gate_weight", "lstm_long")],
    )


@query(
    "auc",
    f"""WITH {SCORED}, lb AS (SELECT symbol, pred_long AS s,
      CASE WHEN close > open THEN 1 ELSE 0 END AS y FROM sc),
    g AS (SELECT symbol, s, sum(y) AS p, count(*) - sum(y) AS m FROM lb GROUP BY 1, 2),
    w AS (SELECT a.symbol, sum(a.p * CASE WHEN b.s < a.s THEN b.m WHEN b.s = a.s THEN b.m / 2.0 ELSE 0 END) AS wins
      FROM g a JOIN g b USING (symbol) GROUP BY 1)
    SELECT symbol, {R('wins / nullif(p * m, 0)', 6)} AS auc FROM w
    JOIN (SELECT symbol, sum(p) AS p, sum(m) AS m FROM g GROUP BY 1) USING (symbol)""",
)
def auc(spark, d):
    rows = scored(spark, d).withColumn("y", F.when(F.col("close") > F.col("open"), 1).otherwise(0))
    out = sg.auc(materialise(rows.select("symbol", "pred_long", "y"), "auc"), ["symbol"], "pred_long", "y")
    return out.withColumn("auc", rnd("auc", 6))
