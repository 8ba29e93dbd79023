"""Ledger operators against loops and the small cases of a live book."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketframe.operators import ledger as lg

T0 = datetime(2024, 1, 1)
TRADE = ("trade_id long, account long, symbol string, side string, size double, entry_price double,"
         " stop_loss double, take_profit double, entry_time timestamp_ntz")


def trade(i, side="Buy", size=1.0, price=100.0, sl=90.0, tp=110.0, minutes=0, account=1):
    return (i, account, "X", side, float(size), price, sl, tp, T0 + timedelta(minutes=minutes))


@pytest.mark.parametrize("seed", range(4))
def test_fifo_equals_loop(spark, seed):
    rng = np.random.default_rng(seed)
    opens = [(i, ["X", "Y"][rng.integers(2)], ["Buy", "Sell"][rng.integers(2)], int(rng.integers(1, 30)),
              T0 + timedelta(hours=int(rng.integers(0, 400)))) for i in range(60)]
    execs = [(i, ["X", "Y"][rng.integers(2)], ["Buy", "Sell"][rng.integers(2)], int(rng.integers(1, 40)),
              T0 + timedelta(hours=int(rng.integers(0, 400)))) for i in range(60)]
    events = sorted([(o[4], 0, o[0], o) for o in opens] + [(e[4], 1, e[0], e) for e in execs])
    queue, want = [], []
    for _, kind, i, r in events:
        if kind == 0:
            queue.append([i, r[1], r[2], r[3]])
            continue
        left, target = r[3], "Buy" if r[2] == "Sell" else "Sell"
        for q in [q for q in queue if q[1] == r[1] and q[2] == target and q[3] > 0]:
            take = min(left, q[3])
            if take:
                want.append((q[0], i, take))
                q[3] -= take
                left -= take
    t = spark.createDataFrame(opens, "trade_id long, symbol string, side string, size long, entry_time timestamp_ntz")
    e = spark.createDataFrame(execs, "exec_id long, symbol string, side string, qty long, ts timestamp_ntz")
    lots = lg.fifo_reduce(t, e, chunk_rows=8)
    got = sorted((r["trade_id"], r["exec_id"], r["closed_qty"]) for r in lots.collect())
    assert got == sorted(want)
    after = lg.apply_reductions(t.withColumn("status", F.lit("open")), lots).collect()
    left = {q[0]: q[3] for q in queue}
    assert all(r["size"] == left[r["trade_id"]] and (r["status"] == "closed") == (r["size"] == 0) for r in after)


def fifo_loop(opens, execs):
    """Open lots reduced one execution after the other."""
    events = sorted([(o[4], 0, o[0], o) for o in opens] + [(e[4], 1, e[0], e) for e in execs])
    queue, want = [], []
    for _, kind, i, r in events:
        if kind == 0:
            queue.append([i, r[1], r[2], r[3]])
            continue
        left, target = r[3], "Buy" if r[2] == "Sell" else "Sell"
        for q in queue:
            take = min(left, q[3])
            if (q[1], q[2]) == (r[1], target) and take > 1e-9:
                want.append((q[0], i, round(take, 6)))
                q[3], left = q[3] - take, left - take
    return sorted(want)


@pytest.mark.parametrize("seed", range(3))
def test_fifo_of_fractional_sizes_equals_loop(spark, seed):
    rng = np.random.default_rng(seed)
    row = lambda i: (i, ["X", None][rng.integers(2)], ["Buy", "Sell"][rng.integers(2)],
                     int(rng.integers(1, 4000)) / 1000, T0 + timedelta(hours=int(rng.integers(0, 90))))
    opens, execs = [row(i) for i in range(50)], [row(i) for i in range(50)]
    t = spark.createDataFrame(opens, "trade_id long, symbol string, side string, size double, entry_time timestamp_ntz")
    e = spark.createDataFrame(execs, "exec_id long, symbol string, side string, qty double, ts timestamp_ntz")
    lots = lg.fifo_reduce(t, e, step=0.001, chunk_rows=7)
    got = sorted((r["trade_id"], r["exec_id"], round(r["closed_qty"], 6)) for r in lots.collect())
    assert got == fifo_loop(opens, execs)


def test_fifo_closes_half_lots_and_refuses_a_wrong_step(spark):
    t = spark.createDataFrame(
        [("a-1", "X", "Buy", 0.5, T0), ("b-2", "X", "Buy", 1.7, T0 + timedelta(hours=1))],
        "trade_id string, symbol string, side string, size double, entry_time timestamp_ntz",
    ).withColumn("status", F.lit("open"))
    e = spark.createDataFrame(
        [("e", "X", "Sell", 2.2, T0 + timedelta(hours=2))],
        "exec_id string, symbol string, side string, qty double, ts timestamp_ntz",
    )
    lots = lg.fifo_reduce(t, e, step=0.1)
    assert sorted((r.trade_id, r.closed_qty) for r in lots.collect()) == [("a-1", 0.5), ("b-2", 1.7)]
    assert {r.status for r in lg.apply_reductions(t, lots).collect()} == {"closed"}
    with pytest.raises(Exception, match="no multiple of step"):
        lg.fifo_reduce(t, e, step=1.0).collect()


def test_protection_with_string_ids(spark):
    stops = spark.createDataFrame(
        [("t-1", 1, "X", "Sell", 2.0, "sl", 90.0, T0), ("t-2", 1, "X", "Sell", 3.0, "sl", 80.0, T0)],
        "trade_id string, account long, symbol string, side string, qty double, type string,"
        " trigger_price double, entry_time timestamp_ntz",
    )
    orders = spark.createDataFrame(
        [("a1b2-uuid", 1, "X", "Sell", 2.0, 90.01), ("c3d4-uuid", 1, "X", "Sell", 9.0, 70.0)],
        "order_id string, account long, symbol string, side string, qty double, trigger_price double",
    )
    prices = spark.createDataFrame([("X", 100.0)], "symbol string, price double")
    matches = lg.match_stops(stops, orders)
    assert [(r.trade_id, r.order_id) for r in matches.collect()] == [("t-1", "a1b2-uuid")]
    actions = lg.stop_actions(stops, orders, matches, prices).collect()
    assert sorted((r.action, r.order_id or r.trade_id) for r in actions) == [
        ("cancel", "c3d4-uuid"), ("place", "t-2")
    ]


def greedy(stops, orders):
    used, out = set(), []
    for s in stops:
        for o in orders:
            if o[0] not in used and abs(o[1] - s[2]) < 0.001 and abs(o[2] - s[3]) < s[3] * 0.0005:
                used.add(o[0])
                out.append((s[0], s[1], o[0]))
                break
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_stop_matching_equals_greedy(spark, seed):
    rng = np.random.default_rng(seed)
    price = lambda: float(np.round(100 + rng.integers(0, 12) * 0.02, 4))
    stops = [(i, "sl", float(rng.integers(1, 3)), price()) for i in range(25)]
    orders = [(100 + i, float(rng.integers(1, 3)), price()) for i in range(25)]
    s = spark.createDataFrame(
        [(1, "X", "Sell", i, t, q, p, T0) for i, t, q, p in stops],
        "account long, symbol string, side string, trade_id long, type string, qty double, trigger_price double, entry_time timestamp_ntz",
    )
    o = spark.createDataFrame(
        [(1, "X", "Sell", i, q, p) for i, q, p in orders],
        "account long, symbol string, side string, order_id long, qty double, trigger_price double",
    )
    got = sorted((r["trade_id"], r["type"], r["order_id"]) for r in lg.match_stops(s, o).collect())
    assert got == greedy(stops, orders) and got


STOPS = "account long, symbol string, side string, trade_id long, type string, qty double, trigger_price double, entry_time timestamp_ntz"
ORDERS = "account long, symbol string, side string, order_id long, qty double, trigger_price double"


@pytest.mark.parametrize("chunk", [3, 7, 1000])
def test_stop_matching_over_chunk_borders(spark, chunk):
    """A chain of prices in which every stop reaches its neighbours' orders."""
    rng = np.random.default_rng(chunk)
    ladder = [100.0 * (1 + 0.0004) ** i for i in range(40)]
    stops = [(i, "sl", 1.0, p) for i, p in enumerate(ladder)]
    orders = [(int(100 + j), 1.0, ladder[i] * 1.00005) for j, i in enumerate(rng.permutation(40))]
    orders += [(200 + i, 1.0, ladder[20]) for i in range(6)]
    extra = [(1, "X", "Sell", 900, "sl", None, 100.0, T0), (1, None, "Sell", 901, "sl", 1.0, 100.0, T0)]
    s = spark.createDataFrame([(1, "X", "Sell", i, t, q, p, T0) for i, t, q, p in stops] + extra, STOPS)
    o = spark.createDataFrame(
        [(1, "X", "Sell", i, q, p) for i, q, p in orders] + [(1, None, "Sell", 950, 1.0, 100.0)], ORDERS
    )
    got = sorted((r["trade_id"], r["type"], r["order_id"]) for r in lg.match_stops(s, o, chunk_rows=chunk).collect())
    assert got == sorted([*greedy(stops, orders), (901, "sl", 950)])
    assert lg.match_stops(s.filter("false"), o).count() == 0
    assert lg.match_stops(s, o.filter("false")).count() == 0


def test_long_ladder_of_chained_prices(spark):
    """100,000 prices of which each is within reach of the next, one order for each."""
    n = 100_000
    rows = spark.range(n).withColumn("p", 100.0 * F.pow(F.lit(1.0002), F.col("id") % 50_000))
    side = F.when(F.col("id") < 50_000, "Sell").otherwise("Buy")
    s = rows.select(
        F.lit(1).alias("account"), F.lit("X").alias("symbol"), side.alias("side"), F.col("id").alias("trade_id"),
        F.lit("sl").alias("type"), F.lit(1.0).alias("qty"), F.col("p").alias("trigger_price"),
        F.lit(T0).alias("entry_time"),
    )
    o = s.select("account", "symbol", "side", F.col("trade_id").alias("order_id"), "qty", "trigger_price")
    got = lg.match_stops(s, o, chunk_rows=10_000)
    assert got.count() == n and got.filter("trade_id <> order_id").count() == 0
    assert "collect_list" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_stop_sync_keeps_one_cancels_one_places_one(spark):
    trades = spark.createDataFrame([trade(1, sl=90.0, tp=110.0)], TRADE)
    venue = spark.createDataFrame([(1, "X", "Buy", 1.0, 1)], "account long, symbol string, side string, size double, position_idx int")
    stops = lg.placeable_stops(lg.active_stops(trades), venue, ["account", "symbol"])
    orders = spark.createDataFrame(
        [(1, "X", "Sell", 7, 1.0, 90.0), (1, "X", "Sell", 8, 1.0, 50.0)],
        "account long, symbol string, side string, order_id long, qty double, trigger_price double",
    )
    price = spark.createDataFrame([("X", 100.0)], "symbol string, price double")
    acts = lg.stop_actions(stops, orders, lg.match_stops(stops, orders), price).collect()
    assert sorted((a["action"], a["order_id"], a["type"], a["trigger_direction"]) for a in acts) == [
        ("cancel", 8, None, None), ("place", None, "tp", 1)]
    flat = venue.withColumn("size", F.lit(0.0))
    assert lg.placeable_stops(lg.active_stops(trades), flat, ["account", "symbol"]).count() == 0


def test_conditional_orders(spark):
    o = spark.createDataFrame([(1, 5.0), (2, 0.0), (3, None), (4, 6.0)], "order_id long, trigger_price double")
    pending = spark.createDataFrame([(4,)], "order_id long")
    assert [r["order_id"] for r in lg.conditional_orders(o, pending).collect()] == [1]


def test_admission_limits_and_debounce(spark):
    secs = [0, 30, 59, 61, 119, 122, 300, 301, 400]
    df = spark.createDataFrame(
        [("X", i, T0 + timedelta(seconds=s)) for i, s in enumerate(secs)], "symbol string, id long, ts timestamp_ntz"
    )
    got = lambda **k: sorted(r["id"] for r in lg.admit_trades(df, ["symbol"], **k).collect())
    assert got(max_open=99) == [0, 3, 5, 6, 8]
    assert got() == [0, 3, 5]
    busy = spark.createDataFrame([("X", 2)], "symbol string, open_count long")
    assert got(open_counts=busy) == [0]


def test_reconcile_hedged(spark):
    trades = spark.createDataFrame(
        [trade(1, size=0.01), trade(2, size=0.02, sl=80.0, minutes=5), trade(3, "Sell", 0.01), trade(4, "Sell", 0.02)], TRADE
    )
    venue = spark.createDataFrame(
        [(1, "X", "Buy", 0.01, 1), (1, "X", "Sell", 0.05, 2)], "account long, symbol string, side string, size double, position_idx int"
    )
    got = {r["leg"]: r for r in lg.reconcile(trades, venue).collect()}
    assert (got["long"]["action"], got["long"]["qty"], got["long"]["stop_loss"]) == ("open", 0.02, 80.0)
    assert (got["short"]["action"], got["short"]["order_side"], got["short"]["qty"]) == ("reduce", "Buy", 0.02)
    assert got["short"]["stop_loss"] is None
    net = lg.net_consistency(trades, venue, ["account", "symbol"]).first()
    assert net["consistent"] is False and net["venue_net"] == pytest.approx(-0.04)


def test_exits_and_expiry(spark):
    trades = spark.createDataFrame([trade(1), trade(2, "Sell", sl=105.0, tp=95.0, minutes=60), trade(3, sl=1.0, tp=999.0)], TRADE)
    at = lambda p: {r["trade_id"]: r["reason"] for r in lg.price_exits(trades, spark.createDataFrame([("X", p)], "symbol string, price double")).collect()}
    assert at(90.0) == {1: "stop", 2: "target"} and at(105.0) == {2: "stop"} and at(0.0) == {}
    now = F.expr("timestamp_ntz'2024-01-01 02:00:00'")
    assert sorted(r["trade_id"] for r in lg.time_exits(trades, now, 7200).collect()) == [1, 3]
    pend = trades.select(F.col("trade_id").alias("order_id"), "entry_time")
    assert lg.expired_orders(pend, now, 7200).count() == 0


def test_executions(spark):
    e = spark.createDataFrame(
        [(1, "LIMIT-1", "Buy", 5.0, 100.0), (2, "LIMIT-2", "Sell", 5.0, 100.0), (3, "AUTO-3", "Buy", 1.0, 9.0), (4, None, "Sell", 1.0, 9.0)],
        "order_id long, link_id string, side string, qty double, price double",
    )
    p = spark.createDataFrame([(1, 95.0, 120.0)], "order_id long, sl double, tp double")
    got = {r["order_id"]: r for r in lg.enrich_executions(e, p).collect()}
    assert (got[1]["stop_loss"], got[1]["take_profit"], got[1]["fallback"]) == (95.0, 120.0, False)
    assert (got[2]["stop_loss"], got[2]["take_profit"]) == (101.0, 98.0) and got[2]["fallback"]
    assert [got[i]["class"] for i in (3, 4)] == ["own", "close"]
    fills = spark.createDataFrame([(1, "Buy", 5.0, 100.0), (1, "Buy", 5.0, 110.0)], "order_id long, side string, qty double, price double")
    m = lg.merge_fills(fills).first()
    assert (m["size"], m["entry_price"], m["fills"]) == (10.0, 105.0, 2)


def test_protection_sides(spark):
    rows = [trade(1), trade(2, sl=110.0), trade(3, tp=90.0), trade(4, "Sell", sl=110.0, tp=90.0), trade(5, "Hold")]
    got = [r["reason"] for r in lg.check_protection(spark.createDataFrame(rows, TRADE)).orderBy("trade_id").collect()]
    assert got == [None, "stop_side", "target_side", None, "unknown_side"]


def test_orphans(spark):
    t = spark.createDataFrame([(1, 1, "X", "Buy", 11), (2, 1, "X", "Sell", 12), (3, 1, "X", "Sell", None), (4, 1, "X", "Sell", 14)],
                              "trade_id long, account long, symbol string, side string, order_id long")
    pending = spark.createDataFrame([(14,)], "order_id long")
    held = spark.createDataFrame([(1, "X", "Buy", 2.0), (1, "X", "Sell", 0.0)], "account long, symbol string, side string, size double")
    assert [r["trade_id"] for r in lg.prune_orphans(t, pending, held).collect()] == [2]
