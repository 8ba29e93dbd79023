"""Position ledgers: exits, FIFO lots, reconciliation, protective orders."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.joins import small_side_join, spread
from ..functions.num import to_step
from ..functions.scan import Running, running, running_peak
from ..functions.storage import materialise
from ..functions.timeutil import ntz_micros

# Order-matching tolerances and fallback protection distances.
QTY_TOLERANCE = 0.001
PRICE_TOLERANCE = 0.0005
FALLBACK_STOP = 0.01
FALLBACK_TARGET = 0.02
NET_TOLERANCE = 1e-4
MAX_OPEN = 3
DEBOUNCE_SECONDS = 60


def is_buy() -> Column:
    return F.col("side") == "Buy"


def age_seconds(ts: Column, now: Column) -> Column:
    return (ntz_micros(now) - ntz_micros(ts)) / 1_000_000


def net_position(trades: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Signed open size per key."""
    signed = F.when(is_buy(), F.col("size")).otherwise(-F.col("size"))
    return trades.groupBy(*keys).agg(F.sum(signed).alias("net"))


def active_stops(trades: DataFrame) -> DataFrame:
    """Protective orders each open trade needs: opposite side, prices above 0."""
    leg = lambda kind, price: F.struct(F.lit(kind).alias("type"), F.col(price).alias("trigger_price"))
    carried = [c for c in ("account", "symbol", "entry_time") if c in trades.columns]
    return (
        trades.withColumn("leg", F.explode(F.array(leg("sl", "stop_loss"), leg("tp", "take_profit"))))
        .filter(F.col("leg.trigger_price") > 0)
        .select(
            *carried,
            "trade_id",
            F.when(is_buy(), "Sell").otherwise("Buy").alias("side"),
            F.col("size").alias("qty"),
            "leg.type",
            "leg.trigger_price",
        )
    )


def price_exits(trades: DataFrame, prices: DataFrame) -> DataFrame:
    """Open trades whose stop or target the latest price has reached.

    ``prices`` has one row per symbol; prices not above 0 are ignored.
    """
    p = F.col("price")
    hit_stop = F.when(is_buy(), p <= F.col("stop_loss")).otherwise(p >= F.col("stop_loss"))
    hit_goal = F.when(is_buy(), p >= F.col("take_profit")).otherwise(p <= F.col("take_profit"))
    return (
        small_side_join(trades, prices.filter(p > 0), ["symbol"])
        .withColumn("reason", F.when(hit_stop, "stop").when(hit_goal, "target"))
        .filter(F.col("reason").isNotNull())
    )


def time_exits(trades: DataFrame, now: Column, max_seconds: float) -> DataFrame:
    return trades.filter(age_seconds(F.col("entry_time"), now) >= max_seconds)


def expired_orders(pending: DataFrame, now: Column, limit_seconds: float) -> DataFrame:
    """Pending limits older than their life."""
    return pending.filter(age_seconds(F.col("entry_time"), now) > limit_seconds)


def merge_fills(fills: DataFrame) -> DataFrame:
    """Partial fills of an order and side as one trade at the weighted price."""
    value = F.sum(F.col("qty") * F.col("price"))
    return fills.groupBy("order_id", "side").agg(
        F.count(F.lit(1)).alias("fills"),
        F.sum("qty").alias("size"),
        (value / F.nullif(F.sum("qty"), F.lit(0.0))).alias("entry_price"),
    )


def check_protection(trades: DataFrame) -> DataFrame:
    """Whether stop and target lie on the right sides of the entry."""
    e, sl, tp = F.col("entry_price"), F.col("stop_loss"), F.col("take_profit")
    reason = (
        F.when(~F.col("side").isin("Buy", "Sell"), "unknown_side")
        .when(F.when(is_buy(), sl >= e).otherwise(sl <= e), "stop_side")
        .when(F.when(is_buy(), tp <= e).otherwise(tp >= e), "target_side")
    )
    return trades.withColumn("reason", reason)


# --- FIFO -----------------------------------------------------------------


def _steps(size: Column, step: float) -> Column:
    """Size in whole steps; a size that ``step`` does not divide stops the job."""
    units = F.round(size.cast("double") / step)
    exact = F.abs(units * step - size.cast("double")) <= 1e-9 * F.greatest(F.abs(size.cast("double")), F.lit(step))
    wrong = F.raise_error(F.concat(F.lit(f"size is no multiple of step {step}: "), size.cast("string")))
    return F.when(exact | size.isNull(), units.cast("long")).otherwise(wrong.cast("long"))


def fifo_reduce(
    trades: DataFrame,
    executions: DataFrame,
    step: float = 1.0,
    chunk: Column | None = None,
    chunk_rows: int = 50_000,
) -> DataFrame:
    """Lots closed first-in-first-out: one row per trade and execution that meet.

    ``trades``: ``symbol, side, trade_id, size, entry_time``; ``executions``:
    ``symbol, side, exec_id, qty, ts``; sizes are multiples of ``step``, such as the
    instrument's quantity step.  An execution closes opposite-side trades that are
    already open; what it cannot close is dropped.

    With running opened ``A`` and executed ``E`` quantity, the part of ``E`` that
    found nothing to close is the running maximum of ``E - A``; the rest is
    consumption.  Opened and consumed quantity each cut the same axis into
    intervals, and a lot lies between two neighbouring cuts: it belongs to the first
    trade and the first execution that end above it.  ``chunk`` splits the time order
    (``ts, kind, id``) of a symbol and side; the default is the hour.  The quantity
    axis is split into ranges with about ``chunk_rows`` cuts.
    """
    opens = trades.select(
        "symbol", "side", F.lit(0).alias("kind"), F.col("trade_id").alias("id"),
        _steps(F.col("size"), step).alias("q"), F.col("entry_time").alias("ts"),
    )
    closes = executions.select(
        "symbol", F.when(is_buy(), "Sell").otherwise("Buy").alias("side"), F.lit(1).alias("kind"),
        F.col("exec_id").alias("id"), _steps(F.col("qty"), step).alias("q"), "ts",
    )
    keys, order = ["symbol", "side"], ["ts", "kind", "id"]
    if chunk is None:
        chunk = F.window("ts", "1 hour").getField("start")
    # read for the sums and for the rows: written once, and dealt by its count
    events = materialise(opens.unionByName(closes).withColumn("chunk", chunk), "fifo-events")
    rows = events.count()
    events = spread(events, [*keys, "chunk"], rows)
    opened = F.when(F.col("kind") == 0, F.col("q")).otherwise(0)
    executed = F.when(F.col("kind") == 1, F.col("q")).otherwise(0)
    sums = running_peak(
        events, keys, F.col("chunk"), order,
        {"A": opened, "E": executed, "excess": executed - opened}, "excess",
    )
    wasted = lambda c: F.greatest(F.col(c), F.lit(0))
    is_open = F.col("kind") == 0
    lo = F.when(is_open, F.col("A") - F.col("q")).otherwise(
        F.col("E") - F.col("q") - wasted("peak_before")
    )
    hi = F.when(is_open, F.col("A")).otherwise(F.col("E") - wasted("peak"))
    spans = sums.withColumns({"lo": lo, "hi": hi}).filter(F.col("hi") > F.col("lo"))
    # every interval end is a cut, and the first trade's start, zero, opens the axis
    trade, execution = F.struct("id"), F.struct("id", "ts")
    none = lambda value: F.when(F.lit(False), value)
    end = F.struct(
        F.col("hi").alias("cut"), F.when(is_open, trade).alias("trade"),
        F.when(~is_open, execution).alias("execution"),
    )
    zero = F.struct(
        F.lit(0).cast("long").alias("cut"), none(trade).alias("trade"),
        none(execution).alias("execution"),
    )
    opens_axis = is_open & (F.col("lo") == 0)
    ends = spans.select(*keys, F.inline(F.when(opens_axis, F.array(end, zero)).otherwise(F.array(end))))
    cuts = materialise(
        spread(ends, [*keys, "cut"], rows)
        .groupBy(*keys, "cut")
        .agg(F.max("trade").alias("trade"), F.max("execution").alias("execution")),
        "fifo-cuts",
    )
    widths = cuts.groupBy(*keys).agg(
        F.greatest(F.max("cut") / F.ceil(F.count(F.lit(1)) / chunk_rows), F.lit(1.0)).alias("width")
    )
    widths = widths.toDF(*[f"_{k}" for k in keys], "width")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    ranged = cuts.join(F.broadcast(widths), same).select(
        *keys, (-F.col("cut")).alias("down"), "cut", "trade", "execution",
        (-F.floor(F.col("cut") / F.col("width"))).alias("range"),
    )
    ranged = spread(ranged, [*keys, "range"], cuts.count())
    # from the top down, what ended last above a cut is the lot that starts at it
    lots = running(
        ranged, keys, F.col("range"), ["down"],
        [
            Running("upper", "last", F.col("cut"), inclusive=False),
            Running("lot_trade", "last", F.col("trade"), inclusive=False),
            Running("lot_execution", "last", F.col("execution"), inclusive=False),
        ],
        few=True,
    ).filter(F.col("lot_trade").isNotNull() & F.col("lot_execution").isNotNull())
    units = F.col("upper") - F.col("cut")
    closed = units if step == 1 else F.round(units * step, 12)
    return lots.select(
        *keys, F.col("lot_trade.id").alias("trade_id"), F.col("lot_execution.id").alias("exec_id"),
        F.col("lot_execution.ts").alias("exec_ts"), closed.alias("closed_qty"),
    )


def apply_reductions(trades: DataFrame, lots: DataFrame) -> DataFrame:
    """Trades with their remaining size; fully closed ones become ``closed``."""
    rows = trades.count()
    trades, lots = spread(trades, ["trade_id"], rows), spread(lots, ["trade_id"], rows)
    closed = lots.groupBy("trade_id").agg(F.sum("closed_qty").alias("_closed"))
    left = F.col("size") - F.coalesce("_closed", F.lit(0))
    # sums of fractions are compared on a grid finer than any quantity step
    if dict(trades.dtypes)["size"] in ("double", "float"):
        left = F.round(left, 9)
    return (
        trades.join(closed, "trade_id", "left")
        .withColumn("size", left)
        .withColumn("status", F.when(F.col("size") <= 0, "closed").otherwise(F.col("status")))
        .drop("_closed")
    )


# --- admission ------------------------------------------------------------


def admit_trades(
    requests: DataFrame,
    keys: Sequence[str],
    open_counts: DataFrame | None = None,
    max_open: int = MAX_OPEN,
    debounce: int = DEBOUNCE_SECONDS,
) -> DataFrame:
    """Requests that open a trade: at least ``debounce`` seconds after the last
    admitted one and while a slot is free.

    ``requests``: keys, ``id`` and ``ts``.  At most ``max_open`` requests of a key can
    be admitted, so that many rounds find them: each takes the first second at least
    ``debounce`` after the one before.  Rounds aggregate map-side and hand on one row
    per key.
    """
    keys = list(keys)
    second = F.floor(ntz_micros(F.col("ts")) / 1_000_000)
    seconds = materialise(
        requests.groupBy(*keys, second.alias("sec")).agg(F.min("id").alias("id")), "requests"
    )
    first = lambda df: df.groupBy(*keys).agg(
        F.min("sec").alias("sec"), F.min_by("id", "sec").alias("id")
    )
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    admitted = None
    last = materialise(first(seconds).withColumn("slot", F.lit(1)), "admitted")
    for slot in range(1, max_open + 1):
        admitted = last if admitted is None else admitted.unionByName(last)
        if slot == max_open:
            break
        before = last.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("sec").alias("_sec"))
        later = seconds.join(before, same & (F.col("sec") >= F.col("_sec") + debounce))
        last = materialise(first(later).withColumn("slot", F.lit(slot + 1)), "admitted")
    slots = F.lit(max_open)
    if open_counts is not None:
        counts = open_counts.select(*[F.col(k).alias(f"_{k}") for k in keys], "open_count")
        admitted = admitted.join(counts, same, "left")
        slots = F.lit(max_open) - F.coalesce("open_count", F.lit(0))
    return admitted.filter(F.col("slot") <= slots).select(*keys, "id", "sec", "slot")


# --- reconciliation -------------------------------------------------------


def venue_sides(positions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Long and short size: index 1 long, 2 short, 0 by its side."""
    idx = F.col("position_idx")
    long = (idx == 1) | ((idx == 0) & is_buy())
    short = (idx == 2) | ((idx == 0) & (F.col("side") == "Sell"))
    total = lambda cond: F.sum(F.when(cond, F.col("size")).otherwise(0.0))
    return positions.groupBy(*keys).agg(
        total(long).alias("actual_long"), total(short).alias("actual_short")
    )


def reconcile(
    trades: DataFrame,
    positions: DataFrame,
    keys: Sequence[str] = ("account", "symbol"),
    step: float = 0.001,
    min_qty: float = 0.001,
) -> DataFrame:
    """Orders that move venue positions to the ledger's open sizes.

    Opening orders carry stop and target of the latest trade on their side.
    """
    keys = list(keys)
    latest = F.struct("entry_time", "trade_id")
    last = lambda s: F.max_by(
        F.struct("stop_loss", "take_profit"), F.when(F.col("side") == s, latest)
    )
    size = lambda s: F.sum(F.when(F.col("side") == s, F.col("size").cast("double")).otherwise(0.0))
    want = trades.groupBy(*keys).agg(
        size("Buy").alias("target_long"), size("Sell").alias("target_short"),
        last("Buy").alias("p_long"), last("Sell").alias("p_short"),
    )
    both = want.join(venue_sides(positions, keys), keys, "full_outer")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))

    def leg(name: str, opener: str, closer: str) -> Column:
        diff = zero(f"target_{name}") - zero(f"actual_{name}")
        opening = diff > 0
        keep = F.col(f"p_{name}")
        return F.struct(
            F.lit(name).alias("leg"),
            zero(f"target_{name}").alias("target"),
            zero(f"actual_{name}").alias("actual"),
            to_step(F.abs(diff), F.lit(step), F.lit(min_qty)).alias("qty"),
            F.when(opening, "open").otherwise("reduce").alias("action"),
            F.when(opening, opener).otherwise(closer).alias("order_side"),
            F.when(opening, keep["stop_loss"]).alias("stop_loss"),
            F.when(opening, keep["take_profit"]).alias("take_profit"),
        )

    legs = F.array(leg("long", "Buy", "Sell"), leg("short", "Sell", "Buy"))
    return (
        both.withColumn("l", F.explode(legs)).select(*keys, "l.*").filter(F.col("qty") > 0)
    )


def net_consistency(trades: DataFrame, positions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ledger net against venue net per key, flagged beyond the tolerance."""
    keys = list(keys)
    venue = venue_sides(positions, keys).select(
        *keys, (F.col("actual_long") - F.col("actual_short")).alias("venue_net")
    )
    ours = net_position(trades, keys)
    both = ours.join(venue, keys, "full_outer").fillna(0, subset=["net", "venue_net"])
    return both.withColumn(
        "consistent", F.abs(F.col("net") - F.col("venue_net")) <= NET_TOLERANCE
    )


# --- protective orders ----------------------------------------------------


def placeable_stops(stops: DataFrame, positions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stops whose position exists; the others can be neither matched nor placed."""
    keys = list(keys)
    held = stops.join(venue_sides(positions, keys), keys, "left")
    size = F.when(F.col("side") == "Sell", F.col("actual_long")).otherwise(F.col("actual_short"))
    return held.filter(F.coalesce(size, F.lit(0.0)) > 0).drop("actual_long", "actual_short")


def conditional_orders(orders: DataFrame, pending: DataFrame) -> DataFrame:
    """Open orders with a trigger that are not pending limit entries."""
    return orders.join(pending.select("order_id"), "order_id", "left_anti").filter(
        F.coalesce("trigger_price", F.lit(0.0)) > 0
    )


def _take_first(stops: list[tuple], orders: list[tuple]) -> list[tuple]:
    """``(stop, order)`` for each own stop of a chunk that can be decided; order None if not yet.

    ``stops``: ``(rank, no, price, qty, own)``; ``orders``: ``(price, no, qty, order_id)``.
    Stops come in ledger order.  A stop of another chunk is not decided here, and neither is
    one that waits for it: whatever it might take is blocked for later stops.
    """
    orders = sorted(orders, key=lambda o: o[:2])
    prices = [o[0] for o in orders]
    used, blocked = [False] * len(orders), [False] * len(orders)
    out = []
    for _, no, price, qty, own in sorted(stops):
        lo = bisect_left(prices, price * (1 - 2 * PRICE_TOLERANCE))
        hi = bisect_right(prices, price * (1 + 2 * PRICE_TOLERANCE))
        fits = [
            i
            for i in range(lo, hi)
            if not used[i]
            and abs(orders[i][2] - qty) < QTY_TOLERANCE
            and abs(prices[i] - price) < price * PRICE_TOLERANCE
        ]
        if not fits:
            continue
        first = min(fits, key=lambda i: orders[i][3])
        if own and not blocked[first]:
            used[first] = True
            out.append((no, orders[first][1]))
            continue
        for i in fits:
            blocked[i] = True
        if own:
            out.append((no, None))
    return out


def _decide(pdf: pd.DataFrame) -> pd.DataFrame:
    """All chunks of a bucket, one after the other."""
    chunks: dict[int, tuple[list, list]] = {}
    for r in pdf.itertuples(index=False):
        stops, orders = chunks.setdefault(r.group, ([], []))
        if r.src == 0:
            stops.append(((r.entered, r.trade_id, r.type), r.no, r.price, r.qty, r.own))
        else:
            orders.append((r.price, r.no, r.qty, r.order_id))
    out = [pair for stops, orders in chunks.values() if orders for pair in _take_first(stops, orders)]
    found = pd.DataFrame(out, columns=["stop", "order"], dtype=object)
    return found.astype({"stop": "Int64", "order": "Int64"})


def _price_chunks(rows: DataFrame, k: Sequence[str], chunk_rows: int) -> DataFrame:
    """Rows once for each price chunk that sees them: its ``group``, and whether it owns them."""
    placed = materialise(
        running(
            rows, k, F.floor(F.ln("price") * 100), ["price", "no"],
            [Running("at", "count", F.lit(1), inclusive=False)],
        ).withColumn("chunk", F.floor(F.col("at") / chunk_rows)),
        "stop-chunks",
    )
    reach = 1 + 4 * PRICE_TOLERANCE
    borders = placed.groupBy(*k, "chunk").agg(
        (F.min("price") / reach).alias("lo"), (F.max("price") * reach).alias("hi")
    ).groupBy(*k).agg(F.collect_list(F.struct("chunk", "lo", "hi")).alias("chunks"))
    borders = borders.select(*[F.col(c).alias(f"_{c}") for c in k], "chunks")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in k]
    price = F.col("price")
    seen_by = F.filter("chunks", lambda c: (c["lo"] <= price) & (price <= c["hi"]))
    return (
        placed.join(borders, same)
        .withColumn("seen", F.explode(F.transform(seen_by, lambda c: c["chunk"])))
        .select(
            "*", F.xxhash64(*k, "seen").alias("group"), (F.col("seen") == F.col("chunk")).alias("own"),
        )
    )


def match_stops(
    stops: DataFrame,
    orders: DataFrame,
    keys: Sequence[str] = ("account", "symbol"),
    chunk_rows: int = 20_000,
) -> DataFrame:
    """Greedy one-to-one cover of required stops by existing orders.

    Stops take, in ledger order, the first unused order of their side within the quantity
    and price tolerances.  A key and side of at most ``chunk_rows`` rows is one chunk; the
    rows of a larger one are cut by price into chunks of that size, and a chunk also sees the
    rows of others within reach of its prices.  Rounds decide in each chunk all stops that do not depend on undecided stops of another one, so
    their number is that of the chunk borders that a chain of dependent stops crosses, most
    often one.  Rows with a null price or quantity match nothing.  Rows at one price lie in
    reach of each other and meet in one task: a venue bounds the open stops of an account
    at a price.
    """
    k = [*keys, "side"]
    order_type = orders.schema["order_id"].dataType
    type_type = stops.schema["type"].dataType
    id_type = stops.schema["trade_id"].dataType
    # rows of the other source get values that are never read; nulls would turn ids to doubles
    none = lambda kind: F.lit(0).cast(kind)
    # an unknown entry time comes first
    entered = F.coalesce(F.unix_micros(F.col("entry_time").cast("timestamp")), F.lit(-(1 << 52)))
    a = stops.select(
        *k, F.lit(0).alias("src"), F.col("trigger_price").cast("double").alias("price"),
        F.col("qty").cast("double").alias("qty"), entered.alias("entered"), "trade_id", "type",
        none(order_type).alias("order_id"),
    )
    b = orders.select(
        *k, F.lit(1).alias("src"), F.col("trigger_price").cast("double").alias("price"),
        F.col("qty").cast("double").alias("qty"), none("long").alias("entered"),
        none(id_type).alias("trade_id"), none(type_type).alias("type"), "order_id",
    )
    rows = materialise(
        a.unionByName(b)
        .filter((F.col("price") > 0) & F.col("qty").isNotNull())
        .withColumn("no", F.monotonically_increasing_id()),
        "stop-rows",
    )
    # there are few large keys: at most one for ``chunk_rows`` rows
    large = rows.groupBy(*k).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > chunk_rows)
    large = materialise(large.select(*[F.col(c).alias(f"_{c}") for c in k]), "stop-large")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in k]
    fields = ["src", "price", "qty", "entered", "trade_id", "type", "order_id", "no"]
    seen = rows.join(F.broadcast(large), same, "left_anti").select(
        *fields, F.xxhash64(*k, F.lit(0).cast("long")).alias("group"), F.lit(True).alias("own")
    )
    if not large.isEmpty():
        cut = _price_chunks(rows.join(F.broadcast(large), same, "left_semi"), k, chunk_rows)
        seen = seen.unionByName(cut.select(*fields, "group", "own"))
    seen = materialise(seen, "stop-reach")

    # small chunks share a task: a bucket holds about ``chunk_rows`` rows, or one chunk
    buckets = seen.count() // chunk_rows + 1
    bucket = F.pmod("group", F.lit(buckets))
    pairs = None
    while True:
        found = materialise(
            seen.groupBy(bucket.alias("bucket")).applyInPandas(_decide, "stop long, order long"),
            "stop-round",
        )
        taken = found.filter(F.col("order").isNotNull())
        pairs = taken if pairs is None else pairs.unionByName(taken)
        if found.filter(F.col("order").isNull()).isEmpty():
            break
        gone = taken.select(F.explode(F.array("stop", "order")).alias("no"))
        seen = materialise(seen.join(gone, "no", "left_anti"), "stop-reach")
    return (
        pairs.join(rows.select(*k, "trade_id", "type", F.col("no").alias("stop")), "stop")
        .join(rows.select("order_id", F.col("no").alias("order")), "order")
        .select(*k, "trade_id", "type", "order_id")
    )


def stop_actions(
    stops: DataFrame, orders: DataFrame, matches: DataFrame, prices: DataFrame
) -> DataFrame:
    """Cancel unmatched orders, place unmatched stops.

    ``trigger_direction`` is 1 when the trigger lies above the last price, else
    2; nothing is placed for symbols without a positive price.
    """
    base = ["account", "symbol", "side"]
    order_type, trade_type = (
        df.schema[c].dataType for df, c in ((orders, "order_id"), (stops, "trade_id"))
    )
    stale = orders.join(matches.select("order_id"), "order_id", "left_anti").select(
        *base, F.lit("cancel").alias("action"), "order_id",
        F.lit(None).cast(trade_type).alias("trade_id"), F.lit(None).cast("string").alias("type"),
        F.col("qty").cast("double").alias("qty"), "trigger_price",
        F.lit(None).cast("int").alias("trigger_direction"),
    )
    missing = (
        stops.join(matches.select("trade_id", "type"), ["trade_id", "type"], "left_anti")
        .join(prices.filter(F.col("price") > 0), "symbol")
        .select(
            *base, F.lit("place").alias("action"), F.lit(None).cast(order_type).alias("order_id"),
            "trade_id", "type",
            F.col("qty").cast("double").alias("qty"), "trigger_price",
            F.when(F.col("trigger_price") > F.col("price"), 1).otherwise(2).alias("trigger_direction"),
        )
    )
    return stale.unionByName(missing)


def enrich_executions(executions: DataFrame, pending: DataFrame) -> DataFrame:
    """Executions with their class and, for entries, stop and target.

    Entries take the prices stored with the pending order; if either is
    missing or 0 both fall back to fixed distances from the fill.
    """
    link = F.coalesce("link_id", F.lit(""))
    kind = (
        F.when(link.startswith("LIMIT-"), "entry")
        .when(link.startswith("AUTO-"), "own")
        .when(F.col("qty") > 0, "close")
        .otherwise("ignored")
    )
    rows = executions.withColumn("class", kind).join(
        pending.select("order_id", F.col("sl").alias("_sl"), F.col("tp").alias("_tp")),
        "order_id", "left",
    )
    absent = (F.coalesce("_sl", F.lit(0.0)) == 0) | (F.coalesce("_tp", F.lit(0.0)) == 0)
    sign = F.when(is_buy(), 1).otherwise(-1)
    entry = F.col("class") == "entry"
    pick = lambda stored, away: F.when(
        entry, F.when(absent, F.col("price") * (1 + away)).otherwise(F.col(stored))
    )
    return rows.withColumns(
        {
            "fallback": entry & absent,
            "stop_loss": pick("_sl", -sign * FALLBACK_STOP),
            "take_profit": pick("_tp", sign * FALLBACK_TARGET),
        }
    ).drop("_sl", "_tp")


def prune_orphans(trades: DataFrame, pending: DataFrame, positions: DataFrame) -> DataFrame:
    """Trades whose order is neither pending nor backed by a position.

    Trades without an order id are left alone.
    """
    held = positions.filter(F.col("size") > 0).select("account", "symbol", "side").distinct()
    return (
        trades.filter(F.col("order_id").isNotNull())
        .join(pending.select("order_id"), "order_id", "left_anti")
        .join(held, ["account", "symbol", "side"], "left_anti")
    )
