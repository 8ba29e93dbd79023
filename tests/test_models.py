"""Model round trips on a small separable series."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketframe.operators import models as md, signals as sg, splits as sp
from tests.test_features import frame, walk

P = md.ModelParams(trees=4, depth=2, subsample=1.0, columns=1.0, learning_rate=0.3)


@pytest.fixture(scope="module")
def pdf():
    rng = np.random.default_rng(2)
    d = walk(500, seed=4)[["symbol", "bar", "open", "high", "low", "close", "idx", "n"]]
    d["atr"] = (d["high"] - d["low"]).rolling(10, min_periods=1).mean()
    d["vol_z"], d["noise"] = rng.normal(size=500), rng.normal(size=500)
    for i, t in enumerate(md.SCORES):
        d[t] = ((d["vol_z"] + 0.3 * rng.normal(size=500)) * (1 if i % 2 == 0 else -1) > 0.2).astype(int)
    return d


def test_fit_score_save_load(spark, pdf, tmp_path):
    rows = sp.split_chrono(frame(spark, pdf), [("train", 0.7), ("val", 0.85), ("test", 1.0)])
    bundle = md.fit_scores(rows, ["close", "vol_z", "noise"], P)
    out = md.score(rows.filter("split = 'test'"), bundle).toPandas()
    for target, name in md.SCORES.items():
        assert out[name].between(0, 1).all()
        assert out.loc[out[target] == 1, name].mean() > out.loc[out[target] == 0, name].mean() + 0.2
    top = md.importances(bundle).collect()
    assert top[0]["feature"] == "vol_z" and "close" not in [r["feature"] for r in top]
    assert bundle.context == ["vol_z"]
    md.save_bundle(bundle, str(tmp_path))
    again = md.load_bundle(spark, str(tmp_path))
    assert again.features == bundle.features
    same = md.score(rows.filter("split = 'test'"), again).toPandas()
    np.testing.assert_allclose(same["pred_long"], out["pred_long"])


def test_gate_prefers_the_better_score(spark):
    rng = np.random.default_rng(1)
    y, regime = rng.integers(0, 2, 400), rng.normal(size=400)
    good, bad = np.where(y == 1, 0.9, 0.1), np.where(y == 1, 0.2, 0.8)
    df = spark.createDataFrame(pd.DataFrame({
        "symbol": "A", "idx": np.arange(400), "y": y, "natr": regime,
        "base_long": np.where(regime > 0, good, bad), "seq_long": np.where(regime > 0, bad, good),
    })).withColumns({"base_short": F.lit(0.5), "seq_short": F.lit(0.5)})
    gated = md.apply_gate(df, md.fit_gate(df, ["natr"], "base_long", "seq_long", "y"))
    second = gated.filter("idx >= 59").select("symbol", "idx", "gate", "seq_long", "seq_short")
    out = sg.blend(df.drop("seq_long", "seq_short"), second).toPandas()
    assert (out.loc[out.idx < 59, "gate_weight"] == 1).all()
    assert ((out["pred_long"] > 0.5) == (out["y"] == 1))[out.idx >= 59].mean() > 0.9


def test_fold_evaluation(spark, pdf):
    bars = frame(spark, pdf)
    folds = sp.cpcv(bars, 3, 1, 20)
    s = sg.Strategy(offset=0.3, horizon=5, max_hold=10, stop_loss=1.0, take_profit=1.0, aggressive=2.0)
    out = md.evaluate_folds(folds, bars, ["vol_z", "noise"], P, s).collect()
    assert len(out) == 3 and all(r["score"] is not None for r in out)
    assert sum(r["trades"] for r in out) > 0


def test_sweep_values(spark):
    a = md.sweep_values(spark, 200, md.SEARCH_RANGES).toPandas()
    b = md.sweep_values(spark, 100, md.SEARCH_RANGES).toPandas()
    pd.testing.assert_frame_equal(a.head(100), b)
    for name, (lo, hi, _) in md.SEARCH_RANGES.items():
        assert a[name].between(lo, hi).all() and a[name].nunique() > 3
    assert a["max_depth"].isin([3, 4, 5, 6]).all()
