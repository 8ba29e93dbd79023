"""Outcomes against a plain per-signal loop; statistics by hand."""

import math
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketframe.operators import signals as sg
from marketframe.operators.touch import first_touch
from tests.test_features import frame, walk

S = sg.Strategy(offset=0.6, horizon=8, max_hold=15, stop_loss=1.5, take_profit=1.0)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(9)
    pdf = walk(400, seed=8)[["symbol", "bar", "open", "high", "low", "close", "idx", "n"]]
    paths = []
    for r in pdf.itertuples():
        inner = list(rng.uniform(r.low, r.high, rng.integers(0, 4)))
        path = [r.open, *rng.permutation([r.low, r.high, *inner]), r.close]
        paths.append([float(x) for x in path])
    pdf["atr"] = (pdf["high"] - pdf["low"]).rolling(10, min_periods=1).mean()
    for k in ("long", "short"):
        pdf[f"pred_{k}"], pdf[f"pred_dir_{k}"] = rng.random(400), rng.random(400)
    return pdf, paths


def loop(pdf, paths, ticks):
    n, out = len(pdf), []
    rec = pdf.to_dict("records")
    for i, r in enumerate(rec):
        for side, sign, key in (("Buy", 1, "long"), ("Sell", -1, "short")):
            d, p = r[f"pred_dir_{key}"], r[f"pred_{key}"]
            kind = "market" if d > S.aggressive else "limit" if p > S.threshold and d > S.direction else None
            if kind is None:
                continue
            entry, early, j = None, None, i
            if kind == "market":
                entry = r["close"]
            else:
                limit = r["close"] - sign * r["atr"] * S.offset
                for j in range(i + 1, min(i + S.horizon, n - 1) + 1):
                    b = rec[j]
                    if b["low"] <= limit if sign > 0 else b["high"] >= limit:
                        if ticks:
                            at = next(t for t, x in enumerate(paths[j]) if sign * (x - limit) <= 0)
                            entry, rest = paths[j][at], paths[j][at + 1:]
                        else:
                            entry = min(b["open"], limit) if sign > 0 else max(b["open"], limit)
                        break
            if entry is None:
                continue
            goal = S.take_profit * (10 if kind == "market" else 1)
            tp, sl = entry + sign * r["atr"] * goal, entry - sign * r["atr"] * S.stop_loss

            def cross(xs):
                for x in xs:
                    if sign * (x - sl) <= 0:
                        return "stop"
                    if sign * (x - tp) >= 0:
                        return "target"

            exit_kind, at = None, None
            if ticks and kind == "limit" and cross(rest):
                exit_kind, at = cross(rest), j
            for k in range(j + 1, min(j + S.max_hold, n - 1) + 1):
                if exit_kind:
                    break
                b = rec[k]
                bad = b["low"] <= sl if sign > 0 else b["high"] >= sl
                good = b["high"] >= tp if sign > 0 else b["low"] <= tp
                if bad or good:
                    exit_kind, at = (cross(paths[k]) if ticks else "stop" if bad else "target"), k
            if not exit_kind and j + S.max_hold < n:
                exit_kind, at = "time", j + S.max_hold
            price = {"stop": sl, "target": tp, None: None}.get(exit_kind, rec[at]["close"] if at is not None else None)
            out.append((i, side, kind, j, round(entry, 9), at, exit_kind, None if price is None else round(price, 9)))
    return sorted(out, key=repr)


def rounded(df):
    cols = ["idx", "side", "kind", "entry_idx", "entry_price", "exit_idx", "exit_kind", "exit_price"]
    rnd = lambda x: None if x is None else round(x, 9)
    return sorted(
        [tuple(r[:4]) + (rnd(r[4]), r[5], r[6], rnd(r[7])) for r in df.select(*cols).collect()], key=repr
    )


def test_bar_outcomes(spark, data):
    pdf, paths = data
    bars = frame(spark, pdf)
    got = sg.outcomes(bars, sg.signals(bars, [S]), S.reach)
    assert rounded(got) == loop(pdf, paths, False)


def test_tick_outcomes(spark, data):
    pdf, paths = data
    bars = frame(spark, pdf)
    trades = spark.createDataFrame(
        [
            ("A", r.bar.to_pydatetime() + timedelta(seconds=k), 1000 * i + k, p)
            for i, r in enumerate(pdf.itertuples())
            for k, p in enumerate(paths[i])
        ],
        "symbol string, ts timestamp_ntz, seq long, price double",
    )
    got = sg.outcomes_tick(bars, trades, sg.signals(bars, [S]), S.reach, "5m")
    text = got._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in text
    assert rounded(got) == loop(pdf, paths, True)


def test_touch_across_chunks(spark, data):
    bars = frame(spark, data[0])
    sigs = sg.signals(bars, [S])
    asked = sigs.select(
        "symbol", "idx", "side", (F.col("idx") + 1).alias("start"), (F.col("idx") + 9).alias("stop"),
        (F.col("close") * 0.998).alias("floor"), (F.col("close") * 1.002).alias("ceiling"),
    )
    a = first_touch(bars, asked, 20, chunk=32).select("idx", "side", "hit_idx", "end_idx", "end_close")
    b = first_touch(bars, asked, 20).select("idx", "side", "hit_idx", "end_idx", "end_close")
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


def test_aggressive_only(spark, data):
    from dataclasses import replace

    bars = frame(spark, data[0])
    kinds = {r["kind"] for r in sg.signals(bars, [replace(S, threshold=2.0)]).select("kind").distinct().collect()}
    assert kinds == {"market"}
    plain = bars.drop("pred_dir_long", "pred_dir_short")
    kinds = {r["kind"] for r in sg.signals(plain, [S]).select("kind").distinct().collect()}
    assert kinds == {"market"}  # missing direction counts as 1


LEDGER = ("set_id int, symbol string, idx long, side string, entry_bar timestamp_ntz,"
          " entry_fee double, exit_bar timestamp_ntz, pnl double")


def at(hours):
    return datetime(2024, 1, 1) + timedelta(hours=int(hours))


def test_entry_fee_is_charged_once(spark):
    led = spark.createDataFrame([(0, "A", 0, "Buy", at(0), 2.0, at(5), 5.0)], LEDGER)
    curve = sg.equity_curve(led).orderBy("event_bar").collect()
    assert [(r.event, r.equity) for r in curve] == [("entry", 9998.0), ("exit", 10003.0)]
    s = sg.trade_stats(sg.equity_curve(led)).first()
    assert (s.trades, s.final_equity) == (1, 10003.0)
    assert s.max_drawdown == pytest.approx(2 / 10000) and s.total_return == pytest.approx(0.0003)


@pytest.mark.parametrize("seed", range(3))
def test_equity_with_fees_equals_loop(spark, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(80):
        start = int(rng.integers(0, 500))
        done = rng.random() < 0.9
        rows.append((0, "A", i, ["Buy", "Sell"][i % 2], at(start), float(rng.random() * 3),
                     at(start + rng.integers(0, 60)) if done else None,
                     float(rng.normal() * 20) if done else None))
    events = sorted(
        [(r[4], 1, r[2], r[3], -r[5]) for r in rows] + [(r[6], 0, r[2], r[3], r[7]) for r in rows if r[6]]
    )
    equity = peak = 10_000.0
    want, worst = [], 0.0
    for *_, amount in events:
        equity += amount
        peak = max(peak, equity)
        worst = min(worst, (equity - peak) / peak)
        want.append(equity)
    led = spark.createDataFrame(rows, LEDGER)
    curve = sg.equity_curve(led)
    got = [r.equity for r in curve.orderBy("event_bar", "step", "idx", "side").collect()]
    assert got == pytest.approx(want)
    s = sg.trade_stats(curve).first()
    assert s.final_equity == pytest.approx(equity) and s.max_drawdown == pytest.approx(-worst)
    assert s.total_return == pytest.approx((equity - 10_000) / 10_000)
    assert s.trades == sum(r[6] is not None for r in rows)


def test_stats_by_hand(spark):
    pnl = [100.0, -50.0, 30.0, -80.0]
    led = spark.createDataFrame(
        [(0, "A", i, "Buy", at(20 * i), 0.0, at(20 * i), p) for i, p in enumerate(pnl)], LEDGER
    )
    s = sg.trade_stats(sg.equity_curve(led)).first()
    assert (s["trades"], s["win_rate"], s["final_equity"]) == (4, 0.5, 10000.0)
    assert s["max_drawdown"] == pytest.approx(100 / 10100)
    assert s["sortino"] == pytest.approx(0.0)
    wins = sg.trade_stats(sg.equity_curve(led.filter("pnl > 0"))).first()
    assert wins["sortino"] == 10.0 and wins["max_drawdown"] == 0.0
    none = sg.complete_stats(
        sg.trade_stats(sg.equity_curve(led.filter("pnl > 1e9"))), led.select("set_id", "symbol").distinct(), ["set_id", "symbol"]
    ).first()
    assert none["trades"] == 0 and none["final_equity"] == 10000.0


def test_scores(spark):
    df = spark.createDataFrame([(0, 2, 5.0, 0.1), (0, 10, 1.5, 0.2)], "set_id int, trades long, sortino double, max_drawdown double")
    got = sg.trial_score(df).first()["score"]
    s = [-0.1 / 1.5, 1.5 * math.log(10) / 2.0]
    assert got == pytest.approx(np.mean(s) - 0.5 * np.std(s))


def test_sizing_guards(spark):
    base = {"wallet": 1000.0, "risk": 0.01, "atr": 2.0, "stop_loss": 1.0, "take_profit": 2.0, "price": 100.0, "side": "Buy",
            "kind": "limit", "tick_size": 0.5, "qty_step": 0.1, "min_qty": 0.1, "min_notional": 5.0}
    cases = [base, base | {"wallet": 0.0}, base | {"wallet": 10.0}, base | {"min_notional": 1e6}, base | {"atr": 0.0}, base | {"kind": "market", "side": "Sell"}]
    df = spark.createDataFrame(pd.DataFrame(cases))
    out = sg.size_orders(df).collect()
    assert [r["reject"] for r in out] == [None, "no_balance", "too_small", "min_notional", None, None]
    assert (out[0]["qty"], out[0]["stop_price"], out[0]["target_price"]) == (5.0, 98.0, 104.0)
    assert out[4]["qty"] == 10.0 and out[4]["stop_price"] == 99.0
    assert (out[5]["stop_price"], out[5]["target_price"]) == (102.0, 60.0)


def test_auc_with_ties(spark):
    rng = np.random.default_rng(0)
    s, y = np.round(rng.random(300), 1), rng.integers(0, 2, 300)
    df = spark.createDataFrame(pd.DataFrame({"symbol": "A", "s": s, "y": y}))
    pos, neg = s[y == 1], s[y == 0]
    want = np.mean((pos[:, None] > neg[None]) + 0.5 * (pos[:, None] == neg[None]))
    assert sg.auc(df, ["symbol"], "s", "y", 8).first()["auc"] == pytest.approx(want)


def test_drawdown_across_days(spark):
    eq = [100.0, 120.0, 90.0, 130.0, 104.0]
    rows = [("A", datetime(2024, 1, 1) + timedelta(hours=20 * i), e) for i, e in enumerate(eq)]
    df = spark.createDataFrame(rows, "run string, at timestamp_ntz, equity double")
    out = sg.drawdown(df, ["run"], F.col("at").cast("date"), ["at"]).orderBy("at").collect()
    assert [r["peak"] for r in out] == [100.0, 120.0, 120.0, 130.0, 130.0]
    assert out[2]["drawdown"] == -0.25 and out[4]["drawdown"] == pytest.approx(-0.2)
