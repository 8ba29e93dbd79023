"""Registered queries: raw feeds and payloads.

Raw text is built from the tables first, so parsing runs over all rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import num
from ..functions.schema import select_features
from ..functions.storage import shared_dir
from ..functions.timeutil import epoch_number_to_ntz, ntz_micros
from ..operators import bars as ob
from ..sources import book as sb, state as st, trades as tr, venue as vn
from ..streaming import feeds
from . import frames, sqltext as q, views as v
from .registry import query
from .rounding import rnd, sql_rnd as R

def _ms():
    return F.floor(ntz_micros(F.col("ts")) / 1000)


@query(
    "trades_scan",
    f"""WITH {q.TRADES} SELECT symbol, ts, seq, price, size, CASE WHEN symbol = 'view' THEN 'Buy' ELSE side END AS side
    FROM trades WHERE size <> 14""",
)
def trades_scan(spark, d):
    """CSV lines under two headers: one without side and in milliseconds."""
    t = v.trades(spark, d)
    us = ntz_micros(F.col("ts"))
    price = F.when(F.col("size") == 14, "bad").otherwise(F.col("price").cast("string"))
    full = t.filter(F.col("symbol") != "view").select(
        F.concat_ws(
            ",", us / 1_000_000, "symbol", "side", "size", price, F.lit("ZeroPlusTick"), "seq",
            F.lit("0"), F.lit("0"), F.lit("0"), F.lit("0"),
        ).alias("value")
    )
    short_columns = ["timestamp", "symbol", "size", "price", "trdMatchID"]
    short = t.filter(F.col("symbol") == "view").select(
        F.concat_ws(",", us / 1000, "symbol", "size", price, "seq").alias("value")
    )
    return tr.parse_trade_lines(full, tr.TRADE_COLUMNS).unionByName(
        tr.parse_trade_lines(short, short_columns)
    )


@query(
    "ts_units",
    "SELECT event_id, ts FROM events",
)
def ts_units(spark, d):
    us = ntz_micros(F.col("ts"))
    raw = F.when(F.col("event_id") % 2 == 0, us / 1_000_000).otherwise(us / 1000)
    return v.table(spark, d, "events").select("event_id", epoch_number_to_ntz(raw).alias("ts"))


def book_text():
    """A book message as JSON text; some lines are cut off, some hold no data."""
    data = F.struct(F.col("symbol").alias("s"), "b", "a")
    text = F.to_json(
        F.struct(
            F.lit("orderbook.200").alias("topic"), "type", _ms().alias("ts"),
            F.when(F.col("seq") % 7 != 3, data).alias("data"),
            F.col("seq").alias("u"), "seq", _ms().alias("cts"),
        )
    )
    return F.when(F.col("seq") % 11 == 5, F.substring(text, 1, 40)).otherwise(text)


def book_lines(spark, d):
    return v.book_msgs(spark, d).select(F.col("seq").alias("line"), book_text().alias("value"))


@query(
    "book_scan",
    f"""WITH {q.LEVELS} SELECT l.symbol, l.seq AS line, CASE WHEN m.snap THEN 'snapshot' ELSE 'delta' END AS type,
      epoch_us(m.ts) // 1000 AS ts_ms, count(*) FILTER (side = 'b') AS bids, count(*) FILTER (side = 'a') AS asks
    FROM levels l JOIN msgs m USING (symbol, seq) WHERE seq % 7 <> 3 AND seq % 11 <> 5 GROUP BY 1, 2, 3, 4""",
)
def book_scan(spark, d):
    return sb.parse_book_lines(book_lines(spark, d)).select(
        "symbol", "line", "type", "ts_ms",
        F.size("b").cast("long").alias("bids"), F.size("a").cast("long").alias("asks"),
    )


def raw_trades(spark, d):
    t = v.trades(spark, d)
    text = F.to_json(
        F.struct(
            F.lit("aggTrade").alias("e"), F.col("symbol").alias("s"),
            F.col("price").cast("string").alias("p"), F.col("size").cast("string").alias("q"),
            _ms().alias("T"), F.col("seq").alias("a"), (F.col("side") != "Buy").alias("m"),
        )
    )
    return t.select(F.when(F.col("size") == 14, F.substring(text, 1, 30)).otherwise(text).alias("value"))


@query(
    "norm_trades",
    f"""WITH {q.TRADES} SELECT (epoch_us(ts) // 1000) / 1000.0::DOUBLE AS timestamp, symbol, CASE WHEN side = 'Buy' THEN 'Buy' ELSE 'Sell' END AS side,
    size, price, 'ZeroPlusTick' AS "tickDirection", seq AS "trdMatchID", price * size AS "grossValue", size AS "homeNotional",
    price * size AS "foreignNotional", CAST(0 AS INTEGER) AS "RPI" FROM trades WHERE size <> 14""",
)
def norm_trades(spark, d):
    return tr.normalise_agg_trades(raw_trades(spark, d))


def _flat(msgs):
    return msgs.select(
        "topic", "type", "ts", "u", "seq", "cts", F.col("data.s").alias("symbol"),
        F.size("data.b").cast("long").alias("bids"), F.size("data.a").cast("long").alias("asks"),
    )


PER_MSG = f"""{q.LEVELS}, pm AS (SELECT symbol, seq, epoch_us(max(ts)) // 1000 AS t,
    count(*) FILTER (side = 'b') AS bids, count(*) FILTER (side = 'a') AS asks FROM levels GROUP BY 1, 2)"""


@query(
    "norm_depth",
    f"""WITH {PER_MSG} SELECT 'orderbook.200.' || symbol AS topic, 'delta' AS type, t AS ts, seq + 1 AS u, seq, t + 5 AS cts,
    symbol, bids, asks FROM pm""",
)
def norm_depth(spark, d):
    some = lambda c: F.when(F.size(c) > 0, F.col(c))
    raw = v.book_msgs(spark, d).select(
        F.to_json(
            F.struct(
                F.lit("depthUpdate").alias("e"), F.col("symbol").alias("s"), _ms().alias("T"),
                (_ms() + 5).alias("E"), F.col("seq").alias("U"), (F.col("seq") + 1).alias("u"),
                some("b").alias("b"), some("a").alias("a"),
            )
        ).alias("value")
    )
    return _flat(sb.normalise_depth(raw))


@query(
    "norm_snapshots",
    f"""WITH {PER_MSG}, x AS (SELECT *, CASE WHEN seq % 3 = 0 THEN 1000 + seq ELSE t END AS ts0 FROM pm)
    SELECT 'orderbook.200.' || symbol AS topic, 'snapshot' AS type, ts0 AS ts, seq AS u, seq,
    CASE WHEN seq % 2 = 0 THEN ts0 ELSE t + 5 END AS cts, symbol, bids, asks FROM x""",
)
def norm_snapshots(spark, d):
    raw = v.book_msgs(spark, d).select(
        (F.col("seq") + 1000).alias("now"),
        F.to_json(
            F.struct(
                F.col("symbol").alias("s"), F.when(F.col("seq") % 3 != 0, _ms()).alias("T"),
                F.when(F.col("seq") % 2 != 0, _ms() + 5).alias("E"),
                F.col("seq").alias("lastUpdateId"), F.col("b").alias("bids"), F.col("a").alias("asks"),
            )
        ).alias("value"),
    )
    return _flat(sb.normalise_snapshots(raw, F.col("now")))


@query(
    "route_events",
    """SELECT event_id AS id, CASE event_type WHEN 'click' THEN 'trade' WHEN 'purchase' THEN 'trade' WHEN 'view' THEN 'depth'
      WHEN 'signup' THEN 'ignored' ELSE 'bad' END AS route, CASE WHEN event_type = 'error' THEN NULL ELSE 'S' || user_id END AS symbol FROM events""",
)
def route_events(spark, d):
    kind = F.col("event_type")
    name = (
        F.when(kind.isin("click", "purchase"), "aggTrade").when(kind == "view", "depthUpdate").otherwise("kline")
    )
    text = F.to_json(F.struct(name.alias("e"), F.concat(F.lit("S"), F.col("user_id")).alias("s")))
    raw = v.table(spark, d, "events").select(
        F.col("event_id").alias("id"), F.when(kind == "error", "{bad").otherwise(text).alias("value")
    )
    return tr.route_events(raw).select("id", "route", "symbol")


@query(
    "norm_klines",
    f"""WITH {q.TRADES}, {q.bars('1 hour')} SELECT symbol, epoch_ms(bar) AS timestamp, bar, open, high, low, close, volume FROM bars""",
)
def norm_klines(spark, d):
    """Two overlapping kline payloads per symbol and day, newest bar first."""
    bars = ob.time_bars(v.trades(spark, d), "1h", order=("seq",))
    ms = F.floor(ntz_micros(F.col("bar")) / 1000)
    text = lambda c: F.col(c).cast("string")
    first = bars.groupBy("symbol", F.col("bar").cast("date").alias("day")).agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    ms.alias("ms"),
                    F.array(ms.cast("string"), *[text(c) for c in ("open", "high", "low", "close", "volume")], F.lit("0")).alias("k"),
                )
            ),
            asc=False,
        ).alias("l")
    )
    lists = first.select("symbol", F.transform("l", lambda x: x["k"]).alias("list"))
    again = F.transform("list", lambda k: F.transform(k, lambda x, i: F.when(i == 5, "-1").otherwise(x)))
    payloads = lists.withColumn("batch", F.lit(0)).unionByName(
        lists.withColumns({"list": again, "batch": F.lit(1)})
    )
    return vn.normalise_klines(payloads)


@query(
    "norm_positions",
    f"""SELECT o_custkey AS account, o_orderpriority AS symbol, CASE o_orderstatus WHEN 'F' THEN 'Buy' ELSE 'Sell' END AS side,
    CAST(o_orderkey % 3 AS DOUBLE) AS size, o_totalprice AS entry_price, 0.5::DOUBLE AS unrealized_pnl, CAST(o_custkey % 3 AS INTEGER) AS position_idx
    FROM orders WHERE o_orderkey % 3 > 0""",
)
def norm_positions(spark, d):
    item = F.struct(
        F.col("o_orderpriority").alias("symbol"),
        F.when(F.col("o_orderstatus") == "F", "Buy").otherwise("Sell").alias("side"),
        (F.col("o_orderkey") % 3).cast("string").alias("size"),
        F.col("o_totalprice").cast("string").alias("avgPrice"),
        F.lit("0.5").alias("unrealisedPnl"),
        (F.col("o_custkey") % 3).cast("int").alias("positionIdx"),
    )
    result = F.struct(F.collect_list(item).alias("list"))
    payloads = v.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("account")).agg(
        F.to_json(F.struct(result.alias("result"))).alias("value")
    )
    return vn.normalise_positions(payloads)


def _json(**fields):
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()])).alias("value")


@query(
    "norm_instruments",
    """SELECT 'P' || p_partkey AS symbol, CAST((p_partkey % 9 + 1) / 100.0 AS DOUBLE) AS tick_size,
    CASE WHEN p_partkey % 5 > 0 THEN CAST(p_size / 1000.0 AS DOUBLE) END AS qty_step, CAST(p_size AS DOUBLE) AS min_qty,
    CASE WHEN p_partkey % 4 = 0 THEN 0.0::DOUBLE ELSE CAST(p_partkey % 7 AS DOUBLE) END AS min_notional FROM part""",
)
def norm_instruments(spark, d):
    """Instruments with text numbers; some steps are no number, some minimums are missing."""
    key, size = F.col("p_partkey"), F.col("p_size")
    lot = F.struct(
        F.when(key % 5 > 0, (size / 1000.0).cast("string")).otherwise("n/a").alias("qtyStep"),
        size.cast("string").alias("minOrderQty"),
        F.when(key % 4 != 0, (key % 7).cast("string")).alias("minNotionalValue"),
    )
    tick = F.struct(((key % 9 + 1) / 100.0).cast("string").alias("tickSize"))
    payloads = v.table(spark, d, "part").select(
        _json(symbol=F.concat(F.lit("P"), key), priceFilter=tick, lotSizeFilter=lot)
    )
    return vn.normalise_instruments(payloads)


@query(
    "norm_book_payload",
    f"""WITH {q.LEVELS} SELECT symbol, epoch_us(max(ts)) // 1000 AS timestamp, count(*) FILTER (side = 'b') AS bids,
    count(*) FILTER (side = 'a') AS asks, CAST(coalesce(sum(price) FILTER (side = 'b'), 0) AS DOUBLE) AS bid_prices,
    {R("coalesce(sum(size) FILTER (side = 'a'), 0)", 3)} AS ask_sizes FROM levels GROUP BY symbol, seq""",
)
def norm_book_payload(spark, d):
    """Full books as text numbers."""
    ms = F.floor(ntz_micros(F.col("ts")) / 1000)
    payloads = v.book_msgs(spark, d).select(_json(s=F.col("symbol"), ts=ms, b=F.col("b"), a=F.col("a")))
    books = vn.normalise_book_payload(payloads)
    total = lambda c, i: F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x[i])
    return books.select(
        "symbol", "timestamp", F.size("bids").cast("long").alias("bids"), F.size("asks").cast("long").alias("asks"),
        total("bids", 0).alias("bid_prices"), rnd(total("asks", 1), 3).alias("ask_sizes"),
    )


@query(
    "norm_prices",
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 IN (0, 1) THEN 0.0::DOUBLE ELSE o_totalprice END AS price FROM orders""",
)
def norm_prices(spark, d):
    """Tickers; some lists are empty and some prices are no number."""
    key = F.col("o_orderkey")
    price = F.when(key % 6 == 1, "-").otherwise(F.col("o_totalprice").cast("string"))
    item = F.struct(F.col("o_orderpriority").alias("symbol"), price.alias("lastPrice"))
    listed = F.when(key % 6 == 0, F.slice(F.array(item), 1, 0)).otherwise(F.array(item, item))
    return vn.last_prices(v.table(spark, d, "orders").select(key.alias("id"), _json(list=listed)))


@query(
    "norm_balance",
    """SELECT c_custkey AS account, CASE c_custkey % 3 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN c_acctbal ELSE c_acctbal + 1 END AS balance
    FROM customer""",
)
def norm_balance(spark, d):
    """Balances by account type: of those that hold the coin the first counts."""
    key, amount = F.col("c_custkey"), F.col("c_acctbal")
    coin = lambda name, value: F.struct(F.lit(name).alias("coin"), value.cast("string").alias("walletBalance"))
    other = F.array(coin("BTC", amount * 2))
    held = lambda value: F.array(coin("BTC", amount * 2), coin("USDT", value))
    ranks = F.array(
        F.struct(F.lit(2).alias("rank"), F.when(key % 3 == 0, other).otherwise(held(amount + 1)).alias("coin")),
        F.struct(F.lit(1).alias("rank"), F.when(key % 3 == 1, held(amount)).otherwise(other).alias("coin")),
    )
    rows = v.table(spark, d, "customer").select(key.alias("account"), F.inline(ranks))
    return vn.wallet_balance(rows.select("account", "rank", _json(coin=F.col("coin"))))


@query(
    "norm_open_orders",
    """SELECT o_orderkey AS order_id, o_orderpriority AS symbol, o_totalprice AS price,
    CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 2 END AS trigger_price FROM orders""",
)
def norm_open_orders(spark, d):
    """Active orders have no trigger, conditional ones do."""
    rows = v.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_orderpriority").alias("symbol"),
        F.col("o_totalprice").alias("price"), "o_orderstatus",
    )
    stop = F.col("o_orderstatus") == "F"
    active = rows.filter(~stop).drop("o_orderstatus")
    conditional = rows.filter(stop).drop("o_orderstatus").withColumn("trigger_price", F.col("price") * 2)
    return vn.open_orders(active, conditional)


P = st.PARAM_DEFAULTS


@query(
    "param_sets",
    f"""SELECT c_name AS symbol, '5m' AS timeframe,
    CASE WHEN c_acctbal > 0 THEN {R('c_acctbal / 5000')} ELSE {P['base_limit_offset_atr']}::DOUBLE END AS base_limit_offset_atr,
    {P['take_profit_atr']}::DOUBLE AS take_profit_atr,
    CASE WHEN c_mktsegment = 'BUILDING' THEN 2.5::DOUBLE ELSE {P['stop_loss_atr']} END AS stop_loss_atr,
    {P['learning_rate']}::DOUBLE AS learning_rate, CASE WHEN c_nationkey > 10 THEN c_nationkey ELSE {P['max_depth']} END AS max_depth,
    CAST({P['num_leaves']} AS INTEGER) AS num_leaves, {P['model_threshold']}::DOUBLE AS model_threshold,
    {P['direction_threshold']}::DOUBLE AS direction_threshold, {P['aggressive_threshold']}::DOUBLE AS aggressive_threshold,
    CASE WHEN c_custkey % 2 = 0 THEN CAST(150 AS INTEGER) ELSE CAST({P['ob_levels']} AS INTEGER) END AS ob_levels FROM customer""",
)
def param_sets(spark, d):
    c = F.col
    text = F.to_json(
        F.struct(
            c("c_name").alias("symbol"), F.lit("5m").alias("timeframe"),
            F.when(c("c_acctbal") > 0, rnd(c("c_acctbal") / 5000)).alias("limit_offset_atr"),
            F.when(c("c_mktsegment") == "BUILDING", 2.5).alias("stop_loss_atr"),
            F.when(c("c_nationkey") > 10, c("c_nationkey")).alias("max_depth"),
            F.when(c("c_custkey") % 2 == 0, 150).alias("ob_levels"),
        )
    )
    return st.parse_params(v.table(spark, d, "customer").select(text.alias("value")))


@query(
    "tick_round",
    f"""WITH p AS (SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice / l_quantity AS px, l_quantity / 3 AS q FROM lineitem)
    SELECT l_orderkey, l_partkey, l_linenumber, round(round_even(px / 0.05::DOUBLE, 0) * 0.05::DOUBLE, 8) AS price,
    CASE WHEN q < 3 THEN 0 ELSE round(round_even(q / 0.5::DOUBLE, 0) * 0.5::DOUBLE, 8) END AS qty FROM p""",
)
def tick_round(spark, d):
    px = F.col("l_extendedprice") / F.col("l_quantity")
    return v.table(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber",
        num.to_tick(px, F.lit(0.05)).alias("price"),
        num.to_step(F.col("l_quantity") / 3, F.lit(0.5), F.lit(3.0)).alias("qty"),
    )


NOW_MS = 1705708800000  # 2024-01-20


@query(
    "bar_admission",
    f"""WITH k AS (SELECT event_type AS symbol, event_id AS arrival, epoch_ms(time_bucket(INTERVAL '5 minutes', ts)) AS start,
      value, {q.K} AS kk, user_id % 2 = 0 AS confirm FROM events),
    last AS (SELECT symbol, min(start) + 86400000 AS last_start FROM k GROUP BY 1)
    SELECT symbol, start, arrival, value AS close FROM k JOIN last USING (symbol)
    WHERE kk > 0 AND confirm AND start <= {NOW_MS} + 3600000 AND start > last_start
    QUALIFY row_number() OVER (PARTITION BY symbol, start ORDER BY arrival) = 1""",
)
def bar_admission(spark, d):
    start = F.floor(ntz_micros(F.window("ts", "5 minutes").getField("start")) / 1000)
    rows = v.table(spark, d, "events").select(
        F.col("event_type").alias("symbol"), F.col("event_id").alias("arrival"), start.alias("start"),
        F.col("value").alias("open"), F.col("value").alias("high"), F.col("value").alias("low"),
        F.when(v.prop_k() > 0, F.col("value")).alias("close"), F.lit(1.0).alias("volume"),
        (F.col("user_id") % 2 == 0).alias("confirm"),
    )
    last = rows.groupBy("symbol").agg((F.min("start") + 86_400_000).alias("last_start"))
    return vn.admit_bars(rows, F.lit(NOW_MS), last).select("symbol", "start", "arrival", "close")


@query(
    "book_sanitize",
    f"""WITH e AS (SELECT event_type AS symbol, event_id // 25 AS seq, event_id, value,
      CASE WHEN user_id % 7 = 0 THEN -value ELSE value END AS price, {q.K} - 10 AS size FROM events)
    SELECT symbol, seq,
    coalesce(string_agg(value || ':' || size, '|' ORDER BY event_id) FILTER (price > 0 AND size > 0), '') AS strict,
    coalesce(string_agg(value || ':' || size, '|' ORDER BY event_id) FILTER (price > 0 AND size >= 0), '') AS loose
    FROM e GROUP BY 1, 2""",
)
def book_sanitize(spark, d):
    price = F.concat(F.when(F.col("user_id") % 7 == 0, "-").otherwise(""), F.col("value").cast("string"))
    level = F.array(price, (v.prop_k() - 10).cast("string"))
    msgs = v.table(spark, d, "events").groupBy(
        F.col("event_type").alias("symbol"), F.floor(F.col("event_id") / 25).alias("seq")
    ).agg(F.array_sort(F.collect_list(F.struct("event_id", level.alias("lv")))).alias("l"))
    levels = F.transform("l", lambda x: x["lv"])
    text = lambda zero: F.array_join(
        F.transform(sb.sanitise_levels(levels, zero), lambda x: F.concat_ws(":", x)), "|"
    )
    return msgs.select("symbol", "seq", text(False).alias("strict"), text(True).alias("loose"))


@query(
    "feature_select",
    f"""WITH {q.joined('5 minutes')} SELECT u.feature, count(*) AS rows FROM joined, (VALUES ('close'), ('taker_buy_ratio'),
    ('ob_bid_integrity_mean'), ('ob_ask_integrity_mean')) AS u(feature) GROUP BY 1""",
)
def feature_select(spark, d):
    """Model inputs among the joined bar columns, with their filled row counts."""
    bars = frames.joined_bars(spark, d).drop("vol_buy")
    chosen = select_features(bars.columns)
    counts = bars.agg(*[F.count(c).alias(c) for c in chosen])
    return counts.unpivot([], chosen, "feature", "rows")


@query(
    "rotate_sink",
    f"""WITH {q.TRADES} SELECT symbol, 'trade' AS kind, CAST(CAST(ts AS DATE) AS VARCHAR) AS dt, count(*) AS rows,
    {R('sum(price)')} AS total FROM trades GROUP BY 1, 2, 3""",
)
def rotate_sink(spark, d):
    """A stream of all trades through the day-rotated sink, read back."""
    schema = v.table(spark, d, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    out = f"{shared_dir(spark)}/marketframe/rotate-{uuid.uuid4().hex}"
    rows = feeds.rotated(v.trades_of(source), "trade", F.col("ts"))
    job = feeds.rotate_sink(rows, f"{out}/data", f"{out}/checkpoint")
    job.trigger(availableNow=True).start().awaitTermination()
    back = spark.read.parquet(f"{out}/data")
    return back.groupBy("symbol", "kind", F.col("dt").cast("string").alias("dt")).agg(
        F.count(F.lit(1)).alias("rows"), rnd(F.sum("price")).alias("total")
    )
