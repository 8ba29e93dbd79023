"""Parameter tables in blocks, and joins with a measured small side."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from marketframe.functions import joins
from marketframe.operators import labels as lb, models as md, signals as sg, sweeps
from tests.test_features import frame
from tests.test_labels import bars as label_bars  # noqa: F401
from tests.test_signals import data as signal_data  # noqa: F401


def test_blocks_hold_every_set_once(spark):
    params = spark.range(37).select(
        (F.col("id") * 3).alias("set_id"), F.col("id").cast("double").alias("offset"), F.lit("x").alias("size")
    )
    held = sweeps.in_blocks(params, sg.Strategy, size=10)
    assert (held.count, held.blocks) == (37, 4)
    rows = held.table.select("set_block", F.inline("sets")).collect()
    assert sorted((r.set_id, r.offset) for r in rows) == [(3 * i, float(i)) for i in range(37)]
    # missing fields get their defaults
    assert {r.take_profit for r in rows} == {sg.Strategy().take_profit}
    assert max(sum(r.set_block == b for r in rows) for b in range(4)) == 10
    with pytest.raises(ValueError):
        sweeps.in_blocks(params.filter("false"), sg.Strategy)


def test_sweep_of_drawn_sets_equals_single_runs(spark, signal_data, monkeypatch):  # noqa: F811
    monkeypatch.setattr(sweeps, "SET_BLOCK", 16)
    bars = frame(spark, signal_data[0])
    drawn = sweeps.renamed(md.sweep_values(spark, 200, md.SEARCH_RANGES), md.STRATEGY_NAMES)
    drawn = drawn.withColumns({"horizon": F.lit(8), "max_hold": F.lit(15)})
    held = sweeps.in_blocks(drawn, sg.Strategy)
    assert held.blocks == 13
    got = sg.sweep(bars, held)
    cols = ["idx", "side", "entry_idx", "exit_idx", "exit_kind", "pnl"]
    rows = {(r.set_id, *[r[c] for c in cols]) for r in got.select("set_id", *cols).collect()}
    fields = [f for f in sg.Strategy.__dataclass_fields__ if f in drawn.columns]
    for p in drawn.filter("set_id IN (0, 15, 16, 199)").collect():
        one = replace(sg.Strategy(), **{f: p[f] for f in fields})
        want = sg.outcomes(bars, sg.signals(bars, [one]), one.reach).select(*cols).collect()
        assert {(p.set_id, *r) for r in want} == {r for r in rows if r[0] == p.set_id}


def test_label_sweep_of_drawn_sets_equals_single_runs(spark, label_bars):  # noqa: F811
    bars = frame(spark, label_bars.head(300))
    drawn = sweeps.renamed(md.sweep_values(spark, 200, md.SEARCH_RANGES), md.STRATEGY_NAMES)
    drawn = drawn.withColumns({"horizon": F.lit(10), "max_hold": F.lit(20)})
    got = lb.label_sweep(bars, drawn, chunk=97)
    cols = ["idx", "target_long", "target_short", "target_dir_long", "fill_long_idx", "fill_short_price"]
    rows = {(r.set_id, *[r[c] for c in cols]) for r in got.select("set_id", *cols).collect()}
    assert len(rows) == 200 * 300
    for p in drawn.filter("set_id IN (3, 16, 198)").collect():
        one = lb.LabelParams(p["offset"], p["take_profit"], p["stop_loss"], 10, 20)
        want = lb.labels(bars, one).select(*cols).collect()
        assert {(p.set_id, *r) for r in want} == {r for r in rows if r[0] == p.set_id}


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_small_side_join_broadcast_and_salted(spark, how):
    large = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 100 == 1, None)
        .otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("key"),
        "id",
    )
    small = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3), ("k2", 4), (None, 5)], "key string, v int")
    want = sorted(map(tuple, large.join(small, ["key"], how).collect()), key=repr)
    for most in (joins.BROADCAST_BYTES, 0):
        df = joins.small_side_join(large, small, ["key"], how, most_bytes=most, salt=8)
        assert sorted(map(tuple, df.collect()), key=repr) == want
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert ("_salt" in plan) == (most == 0)
