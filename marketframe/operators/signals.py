"""Signals from scores, their outcomes, ledger statistics and sweeps.

Every signal is evaluated on its own with a fixed stake; nothing couples one
signal to the equity left by another, so outcomes are relational.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.joins import small_side_join
from ..functions.num import ratio_or_null, to_step, to_tick
from ..functions.scan import Running, running, running_peak
from ..functions.storage import materialise
from ..functions.timeutil import bar_of
from .sweeps import Sets, as_sets, beside
from .touch import first_touch

START_EQUITY = 10_000.0


@dataclass(frozen=True)
class Strategy:
    """Defaults are fixed values of the strategy configuration."""

    offset: float = 0.88
    horizon: int = 60
    max_hold: int = 180
    stop_loss: float = 3.9
    take_profit: float = 1.2
    maker_fee: float = 0.0002
    taker_fee: float = 0.0006
    risk: float = 0.013
    threshold: float = 0.60
    direction: float = 0.5
    aggressive: float = 0.8
    # Fixed value: market entries aim ten times further.
    market_target: float = 10.0

    @property
    def reach(self) -> int:
        return max(self.horizon, self.max_hold) + 1


def signals(
    scored: DataFrame, sets: Sequence[Strategy] | DataFrame | Sets = (Strategy(),)
) -> DataFrame:
    """Market and limit signals of both sides for each parameter set.

    ``sets`` is a list, a table with ``set_id`` and any of the fields of ``Strategy``, or
    such a table in blocks; ``set_block`` is the block a signal's set belongs to.
    A direction score above ``aggressive`` enters at market; else a score above
    ``threshold`` with direction above ``direction`` places a limit away from
    the close.  Missing direction scores count as 1.  A ``threshold`` over 1
    leaves market entries only.
    """
    one = F.lit(1.0)
    dirs = {
        s: F.coalesce(F.col(f"pred_dir_{s}"), one) if f"pred_dir_{s}" in scored.columns else one
        for s in ("long", "short")
    }
    p = F.col("p")

    def side(name: str, sign: int) -> Column:
        kind = F.when(dirs[name] > p["aggressive"], "market").when(
            (F.col(f"pred_{name}") > p["threshold"]) & (dirs[name] > p["direction"]), "limit"
        )
        away = F.when(kind == "limit", F.col("atr") * p["offset"]).otherwise(0.0)
        return F.struct(
            F.lit("Buy" if sign > 0 else "Sell").alias("side"),
            F.lit(sign).alias("sign"),
            kind.alias("kind"),
            (F.col("close") - sign * away).alias("price"),
        )

    rows, _ = beside(scored.filter(F.col("atr") > 0), sets, Strategy)
    return (
        rows.withColumn("p", F.explode("sets"))
        .withColumn("s", F.explode(F.array(side("long", 1), side("short", -1))))
        .filter(F.col("s.kind").isNotNull())
        .select("p.*", "set_block", "symbol", "bar", "idx", "close", "atr", "s.*")
    )


def _barriers(df: DataFrame) -> DataFrame:
    goal = F.col("take_profit") * F.when(
        F.col("kind") == "market", F.col("market_target")
    ).otherwise(1.0)
    return df.withColumns(
        {
            "tp": F.col("entry_price") + F.col("sign") * F.col("atr") * goal,
            "sl": F.col("entry_price") - F.col("sign") * F.col("atr") * F.col("stop_loss"),
        }
    )


_HITS = ["hit_idx", "hit_bar", "hit_open", "hit_high", "hit_low", "hit_close",
         "end_idx", "end_bar", "end_close"]
_INF = float("inf")


def fills(bars: DataFrame, sigs: DataFrame, width: int, blocks: int = 1) -> DataFrame:
    """Entry bar and price: market at the close, limits at the first touching bar.

    Limits are live for ``horizon`` bars after the signal and fill at the open
    where the bar gaps through them.  Unfilled limits have NULL entries.
    """
    long = F.col("sign") > 0
    asked = sigs.withColumns(
        {
            "start": F.col("idx") + 1,
            "stop": F.when(F.col("kind") == "limit", F.col("idx") + F.col("horizon") + 1)
            .otherwise(F.col("idx") + 1).cast("long"),
            "floor": F.when(long, F.col("price")).otherwise(-_INF),
            "ceiling": F.when(long, _INF).otherwise(F.col("price")),
        }
    )
    found = first_touch(bars, asked, width, blocks=blocks)
    gap = F.when(long, F.least("hit_open", "price")).otherwise(F.greatest("hit_open", "price"))
    market = F.col("kind") == "market"
    return found.withColumns(
        {
            "entry_idx": F.when(market, F.col("idx")).otherwise(F.col("hit_idx")),
            "entry_bar": F.when(market, F.col("bar")).otherwise(F.col("hit_bar")),
            "entry_price": F.when(market, F.col("close")).when(F.col("hit_idx").isNotNull(), gap),
        }
    ).drop("start", "stop", "floor", "ceiling", *_HITS)


def exits(bars: DataFrame, entered: DataFrame, width: int, blocks: int = 1) -> DataFrame:
    """First bar after entry that touches a barrier, else the last bar of the hold."""
    long = F.col("sign") > 0
    asked = entered.withColumns(
        {
            "start": F.col("entry_idx") + 1,
            "stop": F.col("entry_idx") + F.col("max_hold") + 1,
            "floor": F.when(long, F.col("sl")).otherwise(F.col("tp")),
            "ceiling": F.when(long, F.col("tp")).otherwise(F.col("sl")),
        }
    )
    return first_touch(bars, asked, width, blocks=blocks).drop("start", "stop", "floor", "ceiling")


def _booked(df: DataFrame) -> DataFrame:
    """Fees and profit of decided exits; the entry fee is kept apart."""
    maker, taker = F.col("maker_fee"), F.col("taker_fee")
    size = START_EQUITY * F.col("risk") / (F.col("atr") * F.col("stop_loss"))
    fee_rate = F.when(F.col("exit_kind") == "target", maker).otherwise(taker)
    entry_rate = F.when(F.col("kind") == "limit", maker).otherwise(taker)
    return df.withColumn("size", size).withColumns(
        {
            "entry_fee": F.col("entry_price") * F.col("size") * entry_rate,
            "pnl": (F.col("exit_price") - F.col("entry_price")) * F.col("size") * F.col("sign")
            - F.col("exit_price") * F.col("size") * fee_rate,
        }
    )


_LEDGER = [
    "set_id", "symbol", "bar", "idx", "side", "kind", "entry_idx", "entry_bar", "entry_price",
    "exit_idx", "exit_bar", "exit_kind", "exit_price", "size", "entry_fee", "pnl",
]


def outcomes(bars: DataFrame, sigs: DataFrame, reach: int, blocks: int = 1) -> DataFrame:
    """Ledger row per filled signal; a stop wins inside the touching bar.

    ``reach`` covers the longest horizon and hold of all sets, ``blocks`` is their number
    of blocks.  ``exit_kind`` is stop, target or time, NULL while the series ends first.
    """
    filled = fills(bars, sigs, reach, blocks).filter(F.col("entry_idx").isNotNull())
    done = exits(bars, _barriers(filled), reach, blocks)
    stopped = F.when(F.col("sign") > 0, F.col("hit_low") <= F.col("sl")).otherwise(
        F.col("hit_high") >= F.col("sl")
    )
    touched = F.col("hit_idx").isNotNull()
    kind = (
        F.when(touched & stopped, "stop")
        .when(touched, "target")
        .when(F.col("end_idx").isNotNull(), "time")
    )
    return _booked(_decide(done, kind)).select(*_LEDGER)


def sweep(bars: DataFrame, sets: Sequence[Strategy] | DataFrame | Sets) -> DataFrame:
    """Ledger of all parameter sets of a table; ``bars`` carry scores and are read twice."""
    held = as_sets(bars.sparkSession, sets, Strategy)
    p = F.col("p")
    reach = held.largest(F.greatest(p["horizon"], p["max_hold"])) + 1
    return outcomes(bars, signals(bars, held), reach, held.blocks)


def _decide(done: DataFrame, kind: Column) -> DataFrame:
    touched = F.col("exit_kind").isin("stop", "target")
    timed = F.col("exit_kind") == "time"
    return done.withColumn("exit_kind", kind).withColumns(
        {
            "exit_idx": F.when(touched, F.col("hit_idx")).when(timed, F.col("end_idx")),
            "exit_bar": F.when(touched, F.col("hit_bar")).when(timed, F.col("end_bar")),
            "exit_price": F.when(F.col("exit_kind") == "stop", F.col("sl"))
            .when(F.col("exit_kind") == "target", F.col("tp"))
            .when(timed, F.col("end_close")),
        }
    )


#: What tells signals apart.
SIGNAL_KEY = ["set_id", "symbol", "idx", "side"]


def _first_tick(ticks: DataFrame, asked: DataFrame, crossed: Column, found: Column) -> DataFrame:
    """Per signal of ``asked``: the first tick of its ``bar`` that fulfils ``crossed``.

    ``asked`` is the side measured for a broadcast: trades stay where they are, only those
    of asked bars go on, and the first crossing is a minimum, combined before the shuffle.
    ``found`` is what is kept of a tick; it starts with the tick's place.
    """
    met = small_side_join(ticks, asked, ["symbol", "bar"]).filter(crossed)
    return met.groupBy(*SIGNAL_KEY).agg(F.min(found).alias("_tick"))


def outcomes_tick(
    bars: DataFrame,
    trades: DataFrame,
    sigs: DataFrame,
    reach: int,
    timeframe: str,
    order: Sequence[str] = ("ts", "seq"),
    blocks: int = 1,
) -> DataFrame:
    """Outcomes decided by the trades inside bars.

    ``trades``: ``symbol, ts, price`` and the columns of ``order``, which must be unique
    per symbol.  Only trades of entry bars and touching bars are looked at.  A limit fills
    at the first trade at or through it; later trades of the same bar may already close
    the position; in a touching bar the first trade beyond a barrier decides.
    """
    sign, price = F.col("sign"), F.col("price")
    tick = F.col("tick_price")
    ticks = trades.filter(price.isNotNull()).select(
        "symbol", bar_of(F.col("ts"), timeframe).alias("bar"),
        F.struct(*order).alias("at"), price.cast("double").alias("tick_price"),
    )
    stopped = sign * (tick - F.col("sl")) <= 0
    either = stopped | (sign * (tick - F.col("tp")) >= 0)
    ends = F.struct("at", F.when(stopped, "stop").otherwise("target").alias("kind"))

    touched = materialise(
        fills(bars, sigs, reach, blocks).filter(F.col("entry_idx").isNotNull()), "touched"
    )
    limits = touched.filter(F.col("kind") == "limit").select(
        *SIGNAL_KEY, F.col("entry_bar").alias("bar"), "sign", "price"
    )
    filled = _first_tick(ticks, limits, sign * (tick - price) <= 0, F.struct("at", "tick_price"))
    entered = materialise(
        _barriers(
            touched.join(filled, SIGNAL_KEY, "left").withColumns(
                {
                    "_at": F.col("_tick.at"),
                    "entry_price": F.coalesce("_tick.tick_price", "entry_price"),
                }
            )
        ).drop("_tick"),
        "entered",
    )
    open_ = entered.filter(F.col("_at").isNotNull()).select(
        *SIGNAL_KEY, F.col("entry_bar").alias("bar"), "sign", "sl", "tp", "_at"
    )
    early = _first_tick(ticks, open_, (F.col("at") > F.col("_at")) & either, ends)
    done = materialise(
        exits(
            bars,
            entered.drop("_at")
            .join(early, SIGNAL_KEY, "left")
            .withColumn("_early", F.col("_tick.kind"))
            .drop("_tick"),
            reach,
            blocks,
        ),
        "exits",
    )
    held = done.filter(F.col("_early").isNull() & F.col("hit_idx").isNotNull()).select(
        *SIGNAL_KEY, F.col("hit_bar").alias("bar"), "sign", "sl", "tp"
    )
    later = _first_tick(ticks, held, either, ends)
    done = done.join(later, SIGNAL_KEY, "left").withColumn("_later", F.col("_tick.kind"))
    timed = F.when(F.col("end_idx").isNotNull(), F.lit("time"))
    is_early = F.col("_early").isNotNull()
    decided = _decide(done, F.coalesce("_early", "_later", timed)).withColumns(
        {
            "exit_idx": F.when(is_early, F.col("entry_idx")).otherwise(F.col("exit_idx")),
            "exit_bar": F.when(is_early, F.col("entry_bar")).otherwise(F.col("exit_bar")),
        }
    )
    return _booked(decided).select(*_LEDGER)


# --- ledger statistics ----------------------------------------------------


def equity_events(ledger: DataFrame) -> DataFrame:
    """What moves the equity: the entry fee at entry, the profit at exit.

    Ledger rows with ``event_bar``, ``event`` (entry or exit), ``step`` and ``amount``.  Exits
    of a bar come before its entries.  Positions still open have paid their fee.
    """
    entry = F.struct(
        F.col("entry_bar").alias("event_bar"), F.lit(1).alias("step"), F.lit("entry").alias("event"),
        (-F.col("entry_fee")).alias("amount"),
    )
    exit_ = F.struct(
        F.col("exit_bar").alias("event_bar"), F.lit(0).alias("step"), F.lit("exit").alias("event"),
        F.col("pnl").alias("amount"),
    )
    rows = ledger.withColumn("_e", F.explode(F.array(entry, exit_)))
    return rows.filter(F.col("_e.event_bar").isNotNull()).select(*ledger.columns, "_e.*")


def equity_curve(ledger: DataFrame, keys: Sequence[str] = ("set_id", "symbol")) -> DataFrame:
    """Equity after each entry and exit in order, and drawdown from its peak.

    The peak starts at the initial equity.  Chunks are days.
    """
    day = F.col("event_bar").cast("date")
    sums = running_peak(
        equity_events(ledger), keys, day, ["event_bar", "step", "idx", "side"],
        {"_gain": F.col("amount")}, "_gain",
    )
    equity = START_EQUITY + F.col("_gain")
    peak = START_EQUITY + F.greatest("peak", F.lit(0.0))
    return (
        sums.withColumns({"equity": equity, "peak": peak})
        .withColumn("drawdown", (F.col("equity") - F.col("peak")) / F.col("peak"))
        .drop("_gain", "peak_before")
    )


def drawdown(curve: DataFrame, keys: Sequence[str], chunk: Column, order: Sequence[str]) -> DataFrame:
    """Distance of ``equity`` from its running maximum, as a share of it."""
    peaked = running(curve, keys, chunk, order, [Running("peak", "max", F.col("equity"))])
    return peaked.withColumn("drawdown", (F.col("equity") - F.col("peak")) / F.col("peak"))


def trade_stats(curve: DataFrame, keys: Sequence[str] = ("set_id", "symbol")) -> DataFrame:
    """Count, win rate, return, worst drawdown and Sortino ratio per key.

    ``curve`` has entries and exits; trades are exits, return and drawdown include the
    entry fees.  Keys without a closed trade have no row.
    """
    closed = F.col("event") == "exit"
    pnl = F.when(closed, F.col("pnl"))
    lost = F.sqrt(F.avg(F.when(pnl < 0, pnl * pnl)))
    mean = F.avg(pnl)
    sortino = F.when(lost.isNull(), F.when(mean > 0, 10.0).otherwise(-10.0)).otherwise(
        F.coalesce(ratio_or_null(mean, lost), F.lit(0.0))
    )
    return curve.groupBy(*keys).agg(
        F.count(F.when(closed, 1)).alias("trades"),
        F.avg(F.when(pnl > 0, 1.0).when(closed, 0.0)).alias("win_rate"),
        (F.sum("amount") / START_EQUITY).alias("total_return"),
        (F.lit(START_EQUITY) + F.sum("amount")).alias("final_equity"),
        F.abs(F.min("drawdown")).alias("max_drawdown"),
        sortino.alias("sortino"),
    ).filter("trades > 0")


def complete_stats(stats: DataFrame, runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stats for every run; runs without trades get zeros and the start equity."""
    zeros = {"trades": 0, "win_rate": 0.0, "total_return": 0.0, "final_equity": START_EQUITY,
             "max_drawdown": 0.0, "sortino": 0.0}
    return runs.join(stats, list(keys), "left").fillna(zeros)


def fold_score(trades: Column, sortino: Column, max_drawdown: Column) -> Column:
    """Sortino times log of trades (few trades: -0.1), damped by drawdown."""
    base = F.when(trades >= 3, sortino * F.ln(trades)).otherwise(-0.1)
    return base / (1 + max_drawdown * 5)


def holdout_score(trades: Column, sortino: Column) -> Column:
    return F.when(trades >= 2, sortino * F.ln(trades)).otherwise(-1.0)


def trial_score(stats: DataFrame, trial: Sequence[str] = ("set_id",)) -> DataFrame:
    """Mean fold score less half its population deviation, per trial."""
    scored = stats.withColumn(
        "score", fold_score(F.col("trades"), F.col("sortino"), F.col("max_drawdown"))
    )
    return scored.groupBy(*trial).agg(
        F.count(F.lit(1)).alias("folds"),
        (F.avg("score") - 0.5 * F.stddev_pop("score")).alias("score"),
    )


def best(scores: DataFrame, n: int = 1) -> DataFrame:
    """Top ``n`` trials by score (ties: lower set first)."""
    return scores.orderBy(F.desc("score"), F.asc("set_id")).limit(n)


# --- sizing ---------------------------------------------------------------


def size_orders(sigs: DataFrame) -> DataFrame:
    """Order quantity and protective prices per signal.

    Needs ``wallet, risk, atr, stop_loss, take_profit, price, side, kind`` and
    the instrument's ``tick_size, qty_step, min_qty, min_notional``.
    ``reject`` names the guard that stops an order.
    """
    c = F.col
    distance = c("atr") * c("stop_loss")
    distance = F.when(distance == 0, c("price") * 0.01).otherwise(distance)
    sign = F.when(c("side") == "Buy", 1).otherwise(-1)
    mult = F.when(c("kind") == "market", 10.0).otherwise(1.0)
    qty = to_step(ratio_or_null(c("wallet") * c("risk"), c("_dist")), c("qty_step"), c("min_qty"))
    sized = sigs.withColumn("_dist", distance).withColumns(
        {"qty": qty, "order_price": to_tick(c("price"), c("tick_size"))}
    )
    reject = (
        F.when(c("wallet") <= 0, "no_balance")
        .when(c("qty") <= 0, "too_small")
        .when(c("qty") * c("price") < c("min_notional"), "min_notional")
    )
    return sized.withColumns(
        {
            "stop_price": to_tick(c("order_price") - sign * c("_dist"), c("tick_size")),
            "target_price": to_tick(
                c("order_price") + sign * c("atr") * c("take_profit") * mult, c("tick_size")
            ),
            "reject": reject,
        }
    ).drop("_dist")


# --- scores ---------------------------------------------------------------


def blend(
    primary: DataFrame, second: DataFrame, keys: Sequence[str] = ("symbol", "idx")
) -> DataFrame:
    """Gate-weighted mixture of two score tables.

    ``second`` has rows only where the sequence model has history, with
    ``seq_long, seq_short, gate``; elsewhere the primary score stands alone.
    """
    rows = primary.join(second, list(keys), "left")
    gate = F.coalesce("gate", F.lit(1.0))
    mix = lambda s: gate * F.col(f"base_{s}") + (1 - gate) * F.coalesce(f"seq_{s}", F.lit(0.0))
    return rows.withColumns(
        {
            "pred_long": mix("long"),
            "pred_short": mix("short"),
            "gate_weight": gate,
            "lstm_long": F.coalesce("seq_long", F.lit(0.0)),
        }
    ).drop("gate", "seq_long", "seq_short", "base_long", "base_short")


def auc(
    scored: DataFrame, keys: Sequence[str], score: str, label: str, buckets: int = 4096
) -> DataFrame:
    """Area under the ROC curve per key, ties counted half.

    Equal scores are merged first, so the ordered pass runs over distinct
    scores, and it is split by score bucket.
    """
    pos = F.sum(F.when(F.col(label) == 1, 1).otherwise(0))
    levels = scored.groupBy(*keys, score).agg(
        pos.alias("_p"), (F.count(F.lit(1)) - pos).alias("_n")
    )
    ranked = running(
        levels, keys, F.floor(F.col(score) * buckets), [score],
        [Running("_below", "sum", F.col("_n"), inclusive=False)],
    )
    wins = F.sum(F.col("_p") * (F.col("_below") + F.col("_n") / 2))
    return ranked.groupBy(*keys).agg(
        (wins / F.nullif(F.sum("_p") * F.sum("_n"), F.lit(0))).alias("auc")
    )


def last_rows(df: DataFrame, n: int, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """The last ``n`` rows of each row-numbered series."""
    return df.filter(F.col("idx") >= F.col("n") - n)
