"""Exponential and rolling windows against pandas, across chunk borders."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketframe.functions import windows as w
from marketframe.functions.scan import chunk_with_past
from marketframe.functions.schema import context_columns, select_features
from marketframe.operators.features import add_features


def walk(n, seed=1, symbol="A"):
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.002, n)))
    open_ = np.r_[close[0], close[:-1]]
    high = np.maximum(open_, close) * (1 + rng.random(n) * 0.002)
    low = np.minimum(open_, close) * (1 - rng.random(n) * 0.002)
    cols = {"open": open_, "high": high, "low": low, "close": close, "volume": rng.random(n) * 50 + 1,
            "taker_buy_ratio": rng.random(n)}
    for c in ("spread_mean", "micro_dev_mean", "micro_dev_std", "micro_dev_last", "imbalance_mean",
              "imbalance_last", "bid_depth_mean", "ask_depth_mean", "bid_slope_mean", "ask_slope_mean",
              "bid_integrity_mean", "ask_integrity_mean"):
        cols[f"ob_{c}"] = rng.random(n) + 0.1
    pdf = pd.DataFrame(cols)
    pdf.insert(0, "symbol", symbol)
    pdf.insert(1, "bar", pd.Timestamp("2023-01-01") + pd.to_timedelta(np.arange(n) * 5, "min"))
    pdf["idx"], pdf["n"] = np.arange(n), n
    return pdf


def frame(spark, pdf):
    return spark.createDataFrame(pdf).withColumn("bar", F.col("bar").cast("timestamp_ntz"))


def test_ewm_across_chunks(spark):
    pdf = walk(9000)[["symbol", "idx", "n", "close"]]
    df = chunk_with_past(spark.createDataFrame(pdf), 4096, 1024)
    specs = [
        w.Ewm("t9", "close", w.span(9), True), w.Ewm("t50", "close", w.span(50), True, min_periods=30),
        w.Ewm("r14", "close", 1 / 14, False),
    ]
    out = w.add_ewm(df, specs, 1024).filter("_own").toPandas().sort_values("idx")
    assert len(out) == len(pdf)
    np.testing.assert_allclose(out["t9"], pdf["close"].ewm(span=9).mean(), rtol=1e-11)
    np.testing.assert_allclose(out["t50"], pdf["close"].ewm(span=50, min_periods=30).mean(), rtol=1e-11)
    np.testing.assert_allclose(out["r14"], pdf["close"].ewm(alpha=1 / 14, adjust=False).mean(), rtol=1e-11)


def test_long_rolling_across_chunks(spark):
    pdf = walk(9000)[["symbol", "idx", "n", "close"]]
    df = chunk_with_past(spark.createDataFrame(pdf), 2048, 1024)
    specs = [w.Long("m", "mean", "close", 900, 100), w.Long("s", "sum", "close", 48, 12)]
    out = w.add_long_rolling(df, specs).filter("_own").toPandas().sort_values("idx")
    np.testing.assert_allclose(out["m"].astype(float), pdf["close"].rolling(900, min_periods=100).mean(), rtol=1e-10)
    np.testing.assert_allclose(out["s"].astype(float), pdf["close"].rolling(48, min_periods=12).sum(), rtol=1e-10)


@pytest.fixture(scope="module")
def long_walk():
    return walk(2 * w.SLOW_BLOCK + 3000)


def test_features_do_not_depend_on_chunks(spark, long_walk):
    df = frame(spark, long_walk)
    small = add_features(df, chunk=w.SLOW_BLOCK, halo=w.SLOW_BLOCK).toPandas().sort_values("idx")
    whole = add_features(df, chunk=4 * w.SLOW_BLOCK).toPandas().sort_values("idx")
    names = [c for c in small.columns if small[c].dtype == float]
    for c in names:
        np.testing.assert_allclose(small[c], whole[c], rtol=1e-7, atol=1e-7, err_msg=c)


def test_slow_means_match_pandas(spark, long_walk):
    out = add_features(frame(spark, long_walk), ("regime",), chunk=w.SLOW_BLOCK, halo=w.SLOW_BLOCK)
    out = out.toPandas().sort_values("idx").reset_index(drop=True)
    c = long_walk["close"]
    atr = out["atr"].where(out["atr"] != 0, 1)
    for span, need, name in ((864, 100, "macro_dist_3d"), (288, 50, "macro_dist_1d")):
        want = ((c - c.ewm(span=span, min_periods=need).mean()) / atr).fillna(0)
        np.testing.assert_allclose(out[name], want, rtol=1e-6, atol=1e-8)
    natr = out["natr"].where(out["idx"] > 0)
    want = natr.rolling(288).mean() / natr.rolling(8640, min_periods=288).mean()
    np.testing.assert_allclose(out["atr_macro"], want.fillna(0), rtol=1e-8)


def test_forty_two_finite_inputs(spark):
    pdf = walk(700)
    out = add_features(frame(spark, pdf)).toPandas().sort_values("idx")
    names = select_features(out.columns)
    assert len(names) == 42, names
    tail = out[names].tail(100).to_numpy(float)
    assert np.isfinite(tail).all()
    assert out["rsi"].between(0, 100).all()
    assert (out["atr"].tail(100) > 0).all()
    assert "natr" in context_columns(names)
    micro = select_features(out.columns, microstructure_only=True)
    assert "rsi" not in micro and "vol_z" in micro


def test_flat_market_and_crash(spark):
    flat = walk(120)
    for c in ("open", "high", "low", "close"):
        flat[c] = 100.0
    out = add_features(frame(spark, flat)).toPandas().sort_values("idx")
    assert (out["atr"] == 0).all() and (out["rsi"] == 0).all()
    crash = walk(600)
    crash.loc[500:, ["open", "high", "low", "close"]] = 50.0
    out = add_features(frame(spark, crash)).toPandas().sort_values("idx").reset_index(drop=True)
    assert out.loc[500, "rsi"] < 30
    assert out.loc[500, "atr"] > 5 * out.loc[499, "atr"]


def test_depth_log_ratio(spark):
    pdf = walk(30)
    pdf["ob_bid_depth_mean"], pdf["ob_ask_depth_mean"] = 1000.0, 3000.0
    out = add_features(frame(spark, pdf)).toPandas()
    np.testing.assert_allclose(out["ob_depth_log_ratio"], np.log(1 / 3))


def test_no_look_ahead(spark):
    pdf = walk(200)
    short = add_features(frame(spark, pdf.head(100).assign(n=100))).toPandas().set_index("idx").loc[99]
    full = add_features(frame(spark, pdf)).toPandas().set_index("idx").loc[99]
    for c in short.index:
        if c not in ("symbol", "bar", "n"):
            assert short[c] == pytest.approx(full[c], rel=1e-9, abs=1e-12), c


def test_row_numbers_stay_dense_after_drops(spark):
    from marketframe.functions.scan import with_row_index

    pdf = walk(200).drop(columns=["idx", "n"])
    pdf.loc[[5, 90, 199], "close"] = 0.0
    rows = with_row_index(frame(spark, pdf), "bar", valid=F.col("close") > 0)
    out = add_features(rows, ("trend",)).toPandas().sort_values("bar")
    assert list(out["idx"]) == list(range(197)) and set(out["n"]) == {197}


def test_optional_groups(spark):
    pdf = walk(60)[["symbol", "bar", "open", "high", "low", "close", "volume", "idx", "n"]]
    out = add_features(frame(spark, pdf))
    assert "rsi" in out.columns and "taker_buy_z" not in out.columns and "spread_z" not in out.columns


def test_one_exchange_serves_all_windows(spark):
    df = frame(spark, walk(50))
    plan = add_features(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
