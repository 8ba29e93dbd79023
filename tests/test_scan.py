"""Chunked running values and row numbers against pandas."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from marketframe.functions.scan import Running, running, with_row_index


def sample(n=400, seed=3):
    rng = np.random.default_rng(seed)
    t = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.sort(rng.choice(20_000, n, replace=False)), "min")
    x = np.where(rng.random(n) < 0.3, np.nan, rng.normal(size=n))
    return pd.DataFrame({"symbol": np.where(rng.random(n) < 0.7, "A", "B"), "bar": t, "x": x, "i": np.arange(n)})


def to_spark(spark, pdf):
    return spark.createDataFrame(pdf, "symbol string, bar timestamp_ntz, x double, i long").withColumn(
        "x", F.when(~F.isnan("x"), F.col("x"))
    )


def test_running_kinds(spark):
    pdf = sample()
    out = running(
        to_spark(spark, pdf), ["symbol"], F.col("bar").cast("date"), ["bar"],
        [
            Running("s", "sum", F.col("x")), Running("m", "max", F.col("x")),
            Running("lo", "min", F.col("x")), Running("c", "count", F.col("x")),
            Running("l", "last", F.col("x")), Running("p", "last", F.col("i"), inclusive=False),
            Running("f", "first", F.col("i")),
        ],
    ).toPandas().sort_values("i").set_index("i")
    g = pdf.groupby("symbol")["x"]
    np.testing.assert_allclose(out["s"], g.transform(lambda v: v.fillna(0).cumsum()), atol=1e-12)
    np.testing.assert_allclose(out["m"].astype(float), g.transform(lambda v: v.cummax().ffill()))
    np.testing.assert_allclose(out["lo"].astype(float), g.transform(lambda v: v.cummin().ffill()))
    np.testing.assert_array_equal(out["c"], g.transform(lambda v: v.notna().cumsum()))
    np.testing.assert_allclose(out["l"].astype(float), g.transform(lambda v: v.ffill()))
    np.testing.assert_allclose(out["p"].astype(float), pdf.groupby("symbol")["i"].shift(1))
    np.testing.assert_array_equal(out["f"], pdf.groupby("symbol")["i"].transform("first"))


def test_row_index_and_fill(spark):
    pdf = sample()
    out = with_row_index(to_spark(spark, pdf), "bar", fill=["x"]).toPandas().sort_values("i")
    np.testing.assert_array_equal(out["idx"], pdf.groupby("symbol").cumcount())
    np.testing.assert_array_equal(out["n"], pdf.groupby("symbol")["i"].transform("count"))
    np.testing.assert_allclose(out["x"].astype(float), pdf.groupby("symbol")["x"].ffill())


def test_no_per_symbol_window_over_rows(spark):
    plan = with_row_index(to_spark(spark, sample()), "bar")._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line and "row_number" in line]
    assert windows and all("_day" in w for w in windows)
