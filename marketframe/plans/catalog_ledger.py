"""Registered queries: positions, executions, protective orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.storage import materialise
from ..operators import ledger as lg
from ..sources import state as st
from . import views as v
from .registry import query
from .rounding import rnd, sql_rnd as R

NOW = "2001-06-01 00:00:00"
KEYS = ["account", "symbol"]
#: Rows of a day, of all symbols and sides, that share a FIFO chunk.
PART_ROWS = 500_000

POSITIONS = f"""positions AS (
  SELECT o_orderkey AS trade_id, o_custkey AS account, o_orderpriority AS symbol,
    CASE WHEN o_orderstatus = 'F' THEN 'Buy' ELSE 'Sell' END AS side, 1 + o_custkey % 50 AS size,
    o_totalprice AS entry_price,
    {R("CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 0.99::DOUBLE ELSE o_totalprice * 1.01::DOUBLE END", 2)} AS stop_loss,
    {R("CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 1.02::DOUBLE ELSE o_totalprice * 0.98::DOUBLE END", 2)} AS take_profit,
    o_orderdate AS entry_time, CASE WHEN o_orderstatus = 'P' THEN 'closed' ELSE 'open' END AS status FROM orders),
  open_pos AS (SELECT * FROM positions WHERE status = 'open'),
  prices AS (SELECT o_orderpriority AS symbol, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS price FROM orders GROUP BY 1)"""

EXECUTIONS = """executions AS (
  SELECT l_orderkey AS order_id, l_partkey AS part, l_suppkey AS supp, l_linenumber AS line,
    CASE l_returnflag WHEN 'N' THEN 'LIMIT-' WHEN 'A' THEN 'AUTO-' ELSE 'EXT-' END || l_orderkey AS link_id,
    o_custkey AS account, o_orderpriority AS symbol,
    CASE WHEN l_linestatus = 'F' THEN 'Buy' ELSE 'Sell' END AS side, l_quantity AS qty,
    l_extendedprice / l_quantity AS price, l_shipdate AS ts
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
  venue AS (SELECT account, symbol, side, CAST(account % 3 AS INTEGER) AS position_idx, sum(qty) AS size
    FROM executions WHERE link_id LIKE 'EXT-%' GROUP BY 1, 2, 3, 4),
  sides AS (SELECT account, symbol,
    sum(CASE WHEN position_idx = 1 OR (position_idx = 0 AND side = 'Buy') THEN size ELSE 0 END) AS actual_long,
    sum(CASE WHEN position_idx = 2 OR (position_idx = 0 AND side = 'Sell') THEN size ELSE 0 END) AS actual_short
    FROM venue GROUP BY 1, 2)"""


def open_positions(spark, d):
    return v.positions(spark, d).filter(F.col("status") == "open")


def latest_prices(spark, d):
    return v.trades_with_ties(spark, d).groupBy("symbol").agg(
        F.max_by("price", F.struct("ts", "seq")).alias("price")
    )


def venue_positions(spark, d):
    """Position payload rows: externally opened size per account and symbol."""
    ext = v.executions(spark, d).filter(F.col("link_id").startswith("EXT-"))
    return ext.groupBy("account", "symbol", "side").agg(F.sum("qty").alias("size")).withColumn(
        "position_idx", (F.col("account") % 3).cast("int")
    )


@query(
    "net_position",
    f"""WITH {POSITIONS} SELECT symbol, CAST(sum(CASE WHEN side = 'Buy' THEN size ELSE -size END) AS BIGINT) AS net
    FROM open_pos GROUP BY 1""",
)
def net_position(spark, d):
    return lg.net_position(open_positions(spark, d))


STOPS = """stops AS (
  SELECT account, symbol, entry_time, trade_id, CASE side WHEN 'Buy' THEN 'Sell' ELSE 'Buy' END AS side, size AS qty,
    'sl' AS type, stop_loss AS trigger_price FROM open_pos WHERE stop_loss > 0
  UNION ALL SELECT account, symbol, entry_time, trade_id, CASE side WHEN 'Buy' THEN 'Sell' ELSE 'Buy' END, size,
    'tp', take_profit FROM open_pos WHERE take_profit > 0)"""


@query("active_stops", f"WITH {POSITIONS}, {STOPS} SELECT * FROM stops")
def active_stops(spark, d):
    return lg.active_stops(open_positions(spark, d))


@query(
    "price_exits",
    f"""WITH {POSITIONS}, x AS (SELECT trade_id, p.symbol, side, price,
    CASE WHEN CASE WHEN side = 'Buy' THEN price <= stop_loss ELSE price >= stop_loss END THEN 'stop'
         WHEN CASE WHEN side = 'Buy' THEN price >= take_profit ELSE price <= take_profit END THEN 'target' END AS reason
    FROM open_pos p JOIN prices USING (symbol) WHERE price > 0) SELECT * FROM x WHERE reason IS NOT NULL""",
)
def price_exits(spark, d):
    return lg.price_exits(open_positions(spark, d), latest_prices(spark, d)).select(
        "trade_id", "symbol", "side", "price", "reason"
    )


def _now():
    return F.expr(f"timestamp_ntz'{NOW}'")


@query(
    "time_exits",
    f"""WITH {POSITIONS} SELECT trade_id, symbol, entry_time FROM open_pos
    WHERE epoch(TIMESTAMP '{NOW}') - epoch(entry_time) >= 180 * 86400""",
)
def time_exits(spark, d):
    return lg.time_exits(open_positions(spark, d), _now(), 180 * 86400).select(
        "trade_id", "symbol", "entry_time"
    )


@query(
    "order_expiry",
    f"""SELECT o_orderkey AS order_id, o_orderdate AS entry_time FROM orders
    WHERE o_orderstatus = 'P' AND epoch(TIMESTAMP '{NOW}') - epoch(o_orderdate) > 60 * 86400""",
)
def order_expiry(spark, d):
    pending = v.table(spark, d, "orders").filter(F.col("o_orderstatus") == "P").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_orderdate").alias("entry_time")
    )
    return lg.expired_orders(pending, _now(), 60 * 86400)


@query(
    "fill_merge",
    f"""WITH {EXECUTIONS} SELECT order_id, side, count(*) AS fills, sum(qty) AS size,
    {R('sum(qty * price) / nullif(sum(qty), 0)')} AS entry_price FROM executions GROUP BY 1, 2""",
)
def fill_merge(spark, d):
    return lg.merge_fills(v.executions(spark, d)).withColumn("entry_price", rnd("entry_price"))


@query(
    "tpsl_check",
    f"""WITH {POSITIONS}, s AS (SELECT trade_id, side, entry_price,
      CASE WHEN account % 4 = 0 THEN take_profit ELSE stop_loss END AS sl, take_profit AS tp FROM positions)
    SELECT trade_id, CASE WHEN CASE WHEN side = 'Buy' THEN sl >= entry_price ELSE sl <= entry_price END THEN 'stop_side'
      WHEN CASE WHEN side = 'Buy' THEN tp <= entry_price ELSE tp >= entry_price END THEN 'target_side' END AS reason FROM s""",
)
def tpsl_check(spark, d):
    swapped = F.when(F.col("account") % 4 == 0, F.col("take_profit")).otherwise(F.col("stop_loss"))
    rows = v.positions(spark, d).withColumn("stop_loss", swapped)
    return lg.check_protection(rows).select("trade_id", "reason")


def fifo_executions(spark, d):
    """Fills of an order and side on a day as one execution."""
    return v.executions(spark, d).groupBy(
        F.col("order_id").alias("exec_id"), "symbol", "side", "ts"
    ).agg(F.sum("qty").cast("long").alias("qty"))


def _ids_a_part(spark, d):
    """Ids that hold about ``PART_ROWS`` of the busiest day's rows."""
    opened = v.table(spark, d, "orders").select(F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("id"))
    filled = v.table(spark, d, "lineitem").select(F.col("l_shipdate").alias("ts"), F.col("l_orderkey").alias("id"))
    days = opened.unionByName(filled).groupBy("ts").agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi")
    )
    of = days.agg(F.max("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).first()
    return max(1, (of["hi"] - of["lo"] + 1) * PART_ROWS // of["n"]) if of["hi"] is not None else 1


def _lots(spark, d):
    # times are whole days here, so a day is split further by id
    part = F.floor(F.col("id") / _ids_a_part(spark, d)).alias("part")
    chunk = F.struct("ts", "kind", part)
    return lg.fifo_reduce(open_positions(spark, d), fifo_executions(spark, d), chunk=chunk)


FIFO_SQL = f"""WITH {POSITIONS}, {EXECUTIONS}, ex AS (SELECT order_id AS exec_id, symbol,
    CASE side WHEN 'Buy' THEN 'Sell' ELSE 'Buy' END AS side, ts, CAST(sum(qty) AS BIGINT) AS q FROM executions GROUP BY 1, 2, 3, 4),
  ev AS (SELECT symbol, side, 0 AS kind, trade_id AS id, size AS q, entry_time AS ts FROM open_pos
    UNION ALL SELECT symbol, side, 1, exec_id, q, ts FROM ex),
  s1 AS (SELECT *, sum(CASE kind WHEN 0 THEN q ELSE 0 END) OVER w AS a, sum(CASE kind WHEN 1 THEN q ELSE 0 END) OVER w AS e
    FROM ev WINDOW w AS (PARTITION BY symbol, side ORDER BY ts, kind, id ROWS UNBOUNDED PRECEDING)),
  s2 AS (SELECT *, e - greatest(0, max(e - a) OVER (PARTITION BY symbol, side ORDER BY ts, kind, id ROWS UNBOUNDED PRECEDING)) AS c FROM s1),
  s3 AS (SELECT *, coalesce(lag(c) OVER (PARTITION BY symbol, side ORDER BY ts, kind, id), 0) AS c0 FROM s2),
  t AS (SELECT symbol, side, id AS trade_id, a - q AS lo, a AS hi FROM s3 WHERE kind = 0),
  x AS (SELECT symbol, side, id AS exec_id, ts AS exec_ts, c0 AS lo, c AS hi FROM s3 WHERE kind = 1 AND c > c0),
  cuts AS (SELECT symbol, side, cut, max(trade_id) AS trade_id, max(ex) AS ex FROM (
      SELECT symbol, side, hi AS cut, trade_id, NULL AS ex FROM t WHERE hi > lo
      UNION ALL SELECT symbol, side, hi, NULL, {{'id': exec_id, 'ts': exec_ts}} FROM x
      UNION ALL SELECT DISTINCT symbol, side, 0, NULL, NULL FROM ev) GROUP BY 1, 2, 3),
  above AS (SELECT symbol, side, cut, lag(cut) OVER w AS upper,
    last_value(trade_id IGNORE NULLS) OVER u AS trade_id, last_value(ex IGNORE NULLS) OVER u AS ex FROM cuts
    WINDOW w AS (PARTITION BY symbol, side ORDER BY cut DESC),
      u AS (PARTITION BY symbol, side ORDER BY cut DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  lots AS (SELECT symbol, side, trade_id, ex.id AS exec_id, ex.ts AS exec_ts,
    CAST(upper - cut AS BIGINT) AS closed_qty FROM above WHERE trade_id IS NOT NULL AND ex IS NOT NULL)"""


@query("fifo_reduce", f"{FIFO_SQL} SELECT * FROM lots")
def fifo_reduce(spark, d):
    return _lots(spark, d)


@query(
    "fifo_remaining",
    f"""{FIFO_SQL}, z AS (SELECT trade_id, sum(closed_qty) AS c FROM lots GROUP BY 1)
    SELECT p.trade_id, CAST(size - coalesce(c, 0) AS BIGINT) AS size,
    CASE WHEN size - coalesce(c, 0) <= 0 THEN 'closed' ELSE status END AS status
    FROM open_pos p LEFT JOIN z USING (trade_id)""",
)
def fifo_remaining(spark, d):
    lots = _lots(spark, d)
    return lg.apply_reductions(open_positions(spark, d), lots).select("trade_id", "size", "status")


@query(
    "admission",
    """WITH RECURSIVE ev AS (SELECT event_type AS symbol, CAST(ts AS DATE) AS batch, event_id AS id,
      CAST(floor(epoch(ts)) AS BIGINT) AS sec, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k FROM events),
    secs AS (SELECT symbol, batch, sec, min(id) AS id FROM ev GROUP BY 1, 2, 3),
    busy AS (SELECT symbol, batch, count(*) AS open_count FROM ev WHERE k >= 95 GROUP BY 1, 2),
    r AS (SELECT symbol, batch, min(sec) AS sec FROM secs GROUP BY 1, 2
      UNION ALL SELECT r.symbol, r.batch, min(s.sec) FROM r JOIN secs s
        ON s.symbol = r.symbol AND s.batch = r.batch AND s.sec >= r.sec + 3600 GROUP BY r.symbol, r.batch, r.sec),
    ranked AS (SELECT symbol, batch, sec, row_number() OVER (PARTITION BY symbol, batch ORDER BY sec) AS slot FROM r)
    SELECT symbol, batch, id, sec, CAST(slot AS INTEGER) AS slot FROM ranked JOIN secs USING (symbol, batch, sec)
    LEFT JOIN busy USING (symbol, batch) WHERE slot <= 5 - coalesce(open_count, 0)""",
)
def admission(spark, d):
    requests = v.table(spark, d, "events").select(
        F.col("event_type").alias("symbol"), F.col("ts").cast("date").alias("batch"),
        F.col("event_id").alias("id"), "ts", v.prop_k().alias("k"),
    )
    busy = requests.filter(F.col("k") >= 95).groupBy("symbol", "batch").agg(
        F.count(F.lit(1)).alias("open_count")
    )
    return lg.admit_trades(requests, ["symbol", "batch"], busy, max_open=5, debounce=3600)


@query(
    "reconcile",
    f"""WITH {POSITIONS}, {EXECUTIONS}, want AS (SELECT account, symbol,
      sum(CASE WHEN side = 'Buy' THEN size ELSE 0 END)::DOUBLE AS tl, sum(CASE WHEN side = 'Sell' THEN size ELSE 0 END)::DOUBLE AS ts,
      arg_max(stop_loss, (entry_time, trade_id)) FILTER (side = 'Buy') AS sl_l, arg_max(take_profit, (entry_time, trade_id)) FILTER (side = 'Buy') AS tp_l,
      arg_max(stop_loss, (entry_time, trade_id)) FILTER (side = 'Sell') AS sl_s, arg_max(take_profit, (entry_time, trade_id)) FILTER (side = 'Sell') AS tp_s
      FROM open_pos GROUP BY 1, 2),
    b AS (SELECT account, symbol, coalesce(tl, 0) AS tl, coalesce(ts, 0) AS ts, coalesce(actual_long, 0) AS al,
      coalesce(actual_short, 0) AS ash, sl_l, tp_l, sl_s, tp_s FROM want FULL JOIN sides USING (account, symbol)),
    legs AS (SELECT account, symbol, 'long' AS leg, tl AS target, al AS actual, sl_l AS sl, tp_l AS tp, 'Buy' AS opener, 'Sell' AS closer FROM b
      UNION ALL SELECT account, symbol, 'short', ts, ash, sl_s, tp_s, 'Sell', 'Buy' FROM b)
    SELECT account, symbol, leg, target, actual, abs(target - actual) AS qty,
      CASE WHEN target > actual THEN 'open' ELSE 'reduce' END AS action, CASE WHEN target > actual THEN opener ELSE closer END AS order_side,
      CASE WHEN target > actual THEN sl END AS stop_loss, CASE WHEN target > actual THEN tp END AS take_profit
    FROM legs WHERE abs(target - actual) >= 0.001""",
)
def reconcile(spark, d):
    return lg.reconcile(open_positions(spark, d), venue_positions(spark, d), KEYS)


@query(
    "net_consistency",
    f"""WITH {POSITIONS}, {EXECUTIONS}, o AS (SELECT account, symbol, sum(CASE WHEN side = 'Buy' THEN size ELSE -size END)::DOUBLE AS net FROM open_pos GROUP BY 1, 2)
    SELECT account, symbol, coalesce(net, 0) AS net, coalesce(actual_long - actual_short, 0) AS venue_net,
    abs(coalesce(net, 0) - coalesce(actual_long - actual_short, 0)) <= 1e-4 AS consistent FROM o FULL JOIN sides USING (account, symbol)""",
)
def net_consistency(spark, d):
    trades = open_positions(spark, d).withColumn("size", F.col("size").cast("double"))
    return lg.net_consistency(trades, venue_positions(spark, d), KEYS)


def open_orders(spark, d):
    """Protective orders on the venue: stops slightly off, targets exact, some too large."""
    pos = open_positions(spark, d)
    off = 1 + (F.col("trade_id") % 7 - 3) * 0.0002
    leg = lambda i, price: F.struct(
        (F.col("trade_id") * 2 + i).alias("order_id"), price.alias("trigger_price")
    )
    legs = F.array(leg(0, F.col("stop_loss") * off), leg(1, F.col("take_profit")))
    return pos.withColumn("o", F.explode(legs)).select(
        "account", "symbol", F.when(lg.is_buy(), "Sell").otherwise("Buy").alias("side"),
        (F.col("size") + F.when(F.col("trade_id") % 3 == 0, 5).otherwise(0)).cast("double").alias("qty"),
        "o.order_id", "o.trigger_price",
    )


MATCH = f"""WITH RECURSIVE {POSITIONS}, {EXECUTIONS}, {STOPS},
  can AS (SELECT s.*, row_number() OVER (PARTITION BY s.account, s.symbol, s.side ORDER BY entry_time, trade_id, type) AS k
    FROM stops s JOIN sides v ON v.account = s.account AND v.symbol = s.symbol
    AND CASE WHEN s.side = 'Sell' THEN actual_long ELSE actual_short END > 0),
  ords AS (SELECT account, symbol, CASE side WHEN 'Buy' THEN 'Sell' ELSE 'Buy' END AS side,
      (size + CASE WHEN trade_id % 3 = 0 THEN 5 ELSE 0 END)::DOUBLE AS qty, trade_id * 2 AS order_id,
      stop_loss * (1 + (trade_id % 7 - 3) * 0.0002::DOUBLE) AS trigger_price FROM open_pos
    UNION ALL SELECT account, symbol, CASE side WHEN 'Buy' THEN 'Sell' ELSE 'Buy' END,
      (size + CASE WHEN trade_id % 3 = 0 THEN 5 ELSE 0 END)::DOUBLE, trade_id * 2 + 1, take_profit FROM open_pos),
  pairs AS (SELECT c.account, c.symbol, c.side, c.k, list(o.order_id ORDER BY o.order_id) AS fits FROM can c JOIN ords o
    ON o.account = c.account AND o.symbol = c.symbol AND o.side = c.side AND abs(o.qty - c.qty) < 0.001
    AND abs(o.trigger_price - c.trigger_price) < c.trigger_price * 0.0005 GROUP BY 1, 2, 3, 4),
  r AS (SELECT DISTINCT account, symbol, side, 0::BIGINT AS k, []::BIGINT[] AS used, NULL::BIGINT AS oid FROM can
    UNION ALL SELECT q.account, q.symbol, q.side, q.k, CASE WHEN q.m IS NULL THEN q.used ELSE list_append(q.used, q.m) END, q.m
    FROM (SELECT c.account, c.symbol, c.side, c.k, r.used, list_filter(p.fits, lambda x: NOT list_contains(r.used, x))[1] AS m
      FROM r JOIN can c ON c.account = r.account AND c.symbol = r.symbol AND c.side = r.side AND c.k = r.k + 1
      LEFT JOIN pairs p ON p.account = c.account AND p.symbol = c.symbol AND p.side = c.side AND p.k = c.k) q),
  matches AS (SELECT c.account, c.symbol, c.side, c.trade_id, c.type, r.oid AS order_id FROM r JOIN can c
    ON c.account = r.account AND c.symbol = r.symbol AND c.side = r.side AND c.k = r.k WHERE r.oid IS NOT NULL)"""


def _stops(spark, d):
    stops = lg.active_stops(open_positions(spark, d))
    return lg.placeable_stops(stops, venue_positions(spark, d), KEYS)


@query("stop_match", f"{MATCH} SELECT * FROM matches")
def stop_match(spark, d):
    return lg.match_stops(_stops(spark, d), open_orders(spark, d), KEYS)


@query(
    "stop_diff",
    f"""{MATCH} SELECT account, symbol, side, 'cancel' AS action, order_id, NULL::BIGINT AS trade_id, NULL AS type, qty,
    {R('trigger_price')} AS trigger_price, NULL::INTEGER AS trigger_direction FROM ords WHERE order_id NOT IN (SELECT order_id FROM matches)
    UNION ALL SELECT c.account, c.symbol, c.side, 'place', NULL, c.trade_id, c.type, c.qty, {R('c.trigger_price')},
    CASE WHEN c.trigger_price > p.price THEN 1 ELSE 2 END
    FROM can c JOIN prices p ON p.symbol = c.symbol AND p.price > 0
    WHERE NOT EXISTS (SELECT 1 FROM matches m WHERE m.trade_id = c.trade_id AND m.type = c.type)""",
)
def stop_diff(spark, d):
    # matched and compared: the join behind them runs once
    stops, orders = materialise(_stops(spark, d), "stops"), open_orders(spark, d)
    matches = lg.match_stops(stops, orders, KEYS)
    return lg.stop_actions(stops, orders, matches, latest_prices(spark, d)).withColumn(
        "trigger_price", rnd("trigger_price")
    )


@query(
    "exec_enrich",
    f"""WITH {POSITIONS}, {EXECUTIONS}, pend AS (SELECT trade_id AS order_id, CASE WHEN account % 10 = 0 THEN 0 ELSE stop_loss END AS sl, take_profit AS tp FROM open_pos),
    j AS (SELECT e.*, coalesce(sl, 0) AS sl, coalesce(tp, 0) AS tp, CASE side WHEN 'Buy' THEN 1 ELSE -1 END AS g,
      CASE WHEN link_id LIKE 'LIMIT-%' THEN 'entry' WHEN link_id LIKE 'AUTO-%' THEN 'own' WHEN qty > 0 THEN 'close' ELSE 'ignored' END AS class
      FROM executions e LEFT JOIN pend USING (order_id))
    SELECT order_id, part, supp, line, class, class = 'entry' AND (sl = 0 OR tp = 0) AS fallback,
    CASE WHEN class = 'entry' THEN {R('CASE WHEN sl = 0 OR tp = 0 THEN price * (1 - g * 0.01::DOUBLE) ELSE sl END')} END AS stop_loss,
    CASE WHEN class = 'entry' THEN {R('CASE WHEN sl = 0 OR tp = 0 THEN price * (1 + g * 0.02::DOUBLE) ELSE tp END')} END AS take_profit FROM j""",
)
def exec_enrich(spark, d):
    pending = open_positions(spark, d).select(
        F.col("trade_id").alias("order_id"),
        F.when(F.col("account") % 10 == 0, 0.0).otherwise(F.col("stop_loss")).alias("sl"),
        F.col("take_profit").alias("tp"),
    )
    return lg.enrich_executions(v.executions(spark, d), pending).select(
        "order_id", "part", "supp", "line", "class", "fallback",
        rnd("stop_loss").alias("stop_loss"), rnd("take_profit").alias("take_profit"),
    )


@query(
    "prune_orphans",
    f"""WITH {POSITIONS}, {EXECUTIONS}, tr AS (SELECT *, CASE WHEN account % 9 = 0 THEN NULL ELSE trade_id END AS order_id FROM open_pos)
    SELECT trade_id, account, symbol, side FROM tr WHERE order_id IS NOT NULL
    AND order_id NOT IN (SELECT o_orderkey + CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1000000000 END FROM orders)
    AND NOT EXISTS (SELECT 1 FROM venue v WHERE v.account = tr.account AND v.symbol = tr.symbol AND v.side = tr.side AND v.size > 0)""",
)
def prune_orphans(spark, d):
    linked = F.when(F.col("account") % 9 != 0, F.col("trade_id"))
    trades = open_positions(spark, d).withColumn("order_id", linked)
    # pending entries of a third of the trades, the others belong to trades not in the ledger
    other = F.when(F.col("o_orderkey") % 3 == 0, 0).otherwise(1_000_000_000)
    pending = v.table(spark, d, "orders").select((F.col("o_orderkey") + other).alias("order_id"))
    return lg.prune_orphans(trades, pending, venue_positions(spark, d)).select(
        "trade_id", "account", "symbol", "side"
    )


@query(
    "positions_merge",
    f"""WITH {POSITIONS}, cur AS (SELECT * REPLACE (size + 1 AS size) FROM open_pos
      WHERE symbol IN ('1-URGENT', '2-HIGH') AND trade_id % 3 > 0)
    SELECT trade_id, symbol, status, size FROM positions p
    WHERE NOT (status = 'open' AND symbol IN ('1-URGENT', '2-HIGH', '5-LOW'))
    UNION ALL SELECT trade_id, symbol, status, size FROM cur""",
)
def positions_merge(spark, d):
    """Three managed symbols: two with changed rows and closed ones, one closed altogether."""
    pos = v.positions(spark, d).select("trade_id", "symbol", "status", "size")
    mine = F.col("symbol").isin("1-URGENT", "2-HIGH") & (F.col("trade_id") % 3 > 0)
    current = pos.filter((F.col("status") == "open") & mine).withColumn("size", F.col("size") + 1)
    managed = pos.filter(F.col("symbol").isin("1-URGENT", "2-HIGH", "5-LOW")).select("symbol")
    return st.save_positions(pos, current, managed)
