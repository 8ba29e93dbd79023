"""Labels and splits against plain loops and hand-made cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketframe.operators import labels as lb, splits as sp
from tests.test_features import frame, walk


def loop_labels(o, h, l, c, atr, p):
    n, out = len(c), []
    for i in range(n):
        if i >= n - p.max_hold - 1 or atr[i] <= 0:
            out.append((0, 0, 0, 0))
            continue
        ahead = c[min(i + p.horizon, n - 1)]
        res = []
        for sign in (1, -1):
            limit = c[i] - sign * atr[i] * p.offset
            win, j = 0, i + 1
            while j <= min(i + p.horizon, n - 1) and not (l[j] <= limit if sign > 0 else h[j] >= limit):
                j += 1
            if j <= min(i + p.horizon, n - 1):
                price = min(o[j], limit) if sign > 0 else max(o[j], limit)
                for k in range(j, min(j + p.max_hold, n)):
                    stop = l[k] <= price - atr[i] * p.stop_loss if sign > 0 else h[k] >= price + atr[i] * p.stop_loss
                    goal = h[k] >= price + atr[i] * p.take_profit if sign > 0 else l[k] <= price - atr[i] * p.take_profit
                    if stop or goal:
                        win = int(not stop)
                        break
            res.append(win)
        out.append((*res, int(ahead > c[i] + atr[i] * 0.5), int(ahead < c[i] - atr[i] * 0.5)))
    return out


@pytest.fixture(scope="module")
def bars():
    pdf = walk(900, seed=5)[["symbol", "bar", "open", "high", "low", "close", "idx", "n"]]
    atr = (pdf["high"] - pdf["low"]).rolling(14, min_periods=1).mean()
    pdf["atr"] = atr.where(pdf["idx"] % 50 != 7, 0.0)
    return pdf


@pytest.mark.parametrize("chunk", [97, 4096])
def test_labels_equal_loop(spark, bars, chunk):
    sets = [
        lb.LabelParams(0.5, 1.2, 1.0, 20, 40),
        lb.LabelParams(0.88, 2.0, 3.0, 10, 30),
    ]
    got = lb.label_sweep(frame(spark, bars), sets, chunk).toPandas()
    cols = [bars[x].to_numpy() for x in ("open", "high", "low", "close", "atr")]
    names = ["target_long", "target_short", "target_dir_long", "target_dir_short"]
    for k, p in enumerate(sets):
        mine = got[got.set_id == k].sort_values("idx")[names].to_numpy()
        want = np.array(loop_labels(*cols, p))
        assert want.sum() > 0
        np.testing.assert_array_equal(mine, want)


def test_counts_gate(spark, bars):
    out = lb.label_counts(lb.labels(frame(spark, bars)), ["symbol"], 10_000).first()
    assert out["rows"] == 900 and out["usable"] is False


def rows(spark, n):
    return spark.range(n).select(
        F.lit("A").alias("symbol"), F.col("id").alias("idx"), F.lit(n).cast("long").alias("n"), F.col("id").cast("double").alias("x")
    )


def test_purged_folds(spark):
    n, groups, k, purge = 1003, 5, 2, 50
    out = sp.cpcv(rows(spark, n), groups, k, purge).toPandas()
    assert out["fold"].nunique() == 10
    from itertools import combinations

    size = n // groups
    edges = [range(g * size, (g + 1) * size if g < groups - 1 else n) for g in range(groups)]
    for f, chosen in enumerate(combinations(range(groups), k)):
        part = out[out.fold == f]
        test = sorted(i for g in chosen for i in edges[g])
        train = []
        for g in range(groups):
            if g not in chosen:
                keep = list(edges[g])
                train += keep[:-purge] if g + 1 in chosen else keep
        assert sorted(part[part.role == "test"].idx) == test
        assert sorted(part[part.role == "train"].idx) == train


def test_chrono_split(spark):
    out = sp.split_chrono(rows(spark, 1001), [("train", 0.7), ("val", 0.85), ("test", 1.0)])
    got = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    assert got == {"train": 700, "val": 150, "test": 151}


def test_scaler_and_sequences(spark):
    df = rows(spark, 100).withColumn("flat", F.lit(3.0))
    fit = sp.fit_scaler(df, ["x", "flat"], F.col("idx") < 50)
    out = sp.apply_scaler(df, fit, ["x", "flat"]).toPandas().sort_values("idx")
    np.testing.assert_allclose(out["x_scaled"], (np.arange(100) - 24.5) / np.arange(50).std())
    assert (out["flat_scaled"] == 0).all()
    seq = sp.sequences(df, ["x", "flat"], 60, chunk=64).toPandas().sort_values("idx")
    assert list(seq["idx"]) == list(range(59, 100))
    assert [v[0] for v in seq.iloc[30]["sequence"]] == list(range(30, 90))
