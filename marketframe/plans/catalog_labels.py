"""Registered queries: labels, splits, sequences."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from ..operators import labels as lb, splits as sp
from . import frames, sqltext as q
from .catalog_features import PLAIN, WITH_ATR
from .registry import query
from .rounding import rnd, sql_rnd as R

SETS = [
    lb.LabelParams(),
    lb.LabelParams(offset=0.5, take_profit=2.0, stop_loss=1.0, horizon=20, max_hold=60),
    lb.LabelParams(offset=1.5, take_profit=1.0, stop_loss=2.5, horizon=40, max_hold=120),
]

# Bars without a price are dropped after the ATR; the rest is numbered anew.
BARS_ATR = (
    PLAIN + ", " + WITH_ATR.replace("fa AS", "fa0 AS", 1)
    + """, fa AS (SELECT * REPLACE (row_number() OVER (PARTITION BY symbol ORDER BY idx) - 1 AS idx,
      count(*) OVER (PARTITION BY symbol) AS n) FROM fa0 WHERE close > 0)"""
)


def label_ctes(p: lb.LabelParams, suffix: str = "", source: str = "fa") -> str:
    """Labels by plain range joins over the bars of each window."""

    def side(s: str, sign: int) -> str:
        lim = f"close - ({sign}) * atr * {p.offset}"
        touch = "b.low <= a.lim" if sign > 0 else "b.high >= a.lim"
        better = "b.open < a.lim" if sign > 0 else "b.open > a.lim"
        stop = "b.low <= f.px - f.atr * {0}" if sign > 0 else "b.high >= f.px + f.atr * {0}"
        goal = "b.high >= f.px + f.atr * {0}" if sign > 0 else "b.low <= f.px - f.atr * {0}"
        stop, goal = stop.format(p.stop_loss), goal.format(p.take_profit)
        t = f"{s}{suffix}"
        return f"""
  f1_{t} AS (SELECT a.symbol, a.idx, min(b.idx) AS fidx FROM (SELECT *, {lim} AS lim FROM ok{suffix}) a
    JOIN {source} b ON b.symbol = a.symbol AND b.idx BETWEEN a.idx + 1 AND a.idx + {p.horizon} AND {touch} GROUP BY 1, 2),
  f2_{t} AS (SELECT a.symbol, a.idx, a.atr, f.fidx, CASE WHEN {better} THEN b.open ELSE a.lim END AS px
    FROM f1_{t} f JOIN (SELECT *, {lim} AS lim FROM ok{suffix}) a USING (symbol, idx)
    JOIN {source} b ON b.symbol = f.symbol AND b.idx = f.fidx),
  f3_{t} AS (SELECT f.symbol, f.idx, arg_min(CASE WHEN {stop} THEN 0 ELSE 1 END, b.idx) AS win
    FROM f2_{t} f JOIN {source} b ON b.symbol = f.symbol AND b.idx >= f.fidx AND b.idx < f.fidx + {p.max_hold}
     AND ({stop} OR {goal}) GROUP BY 1, 2)"""

    return f"""ok{suffix} AS (SELECT * FROM {source} WHERE idx < n - {p.max_hold} - 1 AND atr > 0),
  dir{suffix} AS (SELECT a.symbol, a.idx,
    CAST(b.close > a.close + a.atr * 0.5 AS INTEGER) AS dl, CAST(b.close < a.close - a.atr * 0.5 AS INTEGER) AS ds
    FROM ok{suffix} a JOIN {source} b ON b.symbol = a.symbol AND b.idx = least(a.idx + {p.horizon}, a.n - 1)),
  {side('long', 1)}, {side('short', -1)},
  lab{suffix} AS (SELECT s.symbol, s.bar, s.idx, s.n,
    CAST(coalesce(l3.win, 0) AS INTEGER) AS target_long, CAST(coalesce(s3.win, 0) AS INTEGER) AS target_short,
    coalesce(d.dl, 0) AS target_dir_long, coalesce(d.ds, 0) AS target_dir_short,
    l2.fidx AS fill_long_idx, l2.px AS fill_long_price, s2.fidx AS fill_short_idx, s2.px AS fill_short_price
    FROM {source} s LEFT JOIN dir{suffix} d USING (symbol, idx)
    LEFT JOIN f2_long{suffix} l2 USING (symbol, idx) LEFT JOIN f3_long{suffix} l3 USING (symbol, idx)
    LEFT JOIN f2_short{suffix} s2 USING (symbol, idx) LEFT JOIN f3_short{suffix} s3 USING (symbol, idx))"""


ONE = f"WITH {BARS_ATR}, {label_ctes(SETS[0])}"
TARGETS = ["target_long", "target_short", "target_dir_long", "target_dir_short"]


@query("label_dir", f"{ONE} SELECT symbol, bar, target_dir_long, target_dir_short FROM lab")
def label_dir(spark, d):
    out = lb.labels(frames.bars_with_atr(spark, d))
    return out.select("symbol", "bar", "target_dir_long", "target_dir_short")


@query(
    "label_fill",
    f"""{ONE} SELECT symbol, bar, fill_long_idx, {R('fill_long_price')} AS fill_long_price,
    fill_short_idx, {R('fill_short_price')} AS fill_short_price FROM lab""",
)
def label_fill(spark, d):
    out = lb.labels(frames.bars_with_atr(spark, d))
    return out.select(
        "symbol", "bar", "fill_long_idx", rnd("fill_long_price").alias("fill_long_price"),
        "fill_short_idx", rnd("fill_short_price").alias("fill_short_price"),
    )


@query("label_barrier", f"{ONE} SELECT symbol, bar, target_long, target_short FROM lab")
def label_barrier(spark, d):
    return lb.labels(frames.bars_with_atr(spark, d)).select(
        "symbol", "bar", "target_long", "target_short"
    )


def _sweep_sql() -> str:
    ctes = ", ".join(label_ctes(p, f"_{k}") for k, p in enumerate(SETS))
    rows = " UNION ALL ".join(
        f"SELECT CAST({k} AS INTEGER) AS set_id, symbol, bar, {', '.join(TARGETS)} FROM lab_{k}"
        for k in range(len(SETS))
    )
    return f"WITH {BARS_ATR}, {ctes}, every AS ({rows})"


@query("label_sweep", f"{_sweep_sql()} SELECT * FROM every")
def label_sweep(spark, d):
    return lb.label_sweep(frames.bars_with_atr(spark, d), SETS).select(
        "set_id", "symbol", "bar", *TARGETS
    )


@query(
    "label_counts",
    f"""{_sweep_sql()} SELECT set_id, symbol, count(*) AS rows,
    {", ".join(f"CAST(sum({t}) AS BIGINT) AS {t.replace('target', 'positives')}" for t in TARGETS)},
    sum(target_long) >= 50 AS usable FROM every GROUP BY 1, 2""",
)
def label_counts(spark, d):
    return lb.label_counts(
        lb.label_sweep(frames.bars_with_atr(spark, d), SETS), ["set_id", "symbol"]
    )


CUTS = [("train", 0.70), ("val", 0.85), ("test", 1.0)]
BASE = f"WITH {q.TRADES}, {q.bars('5 minutes')}, {q.indexed('bars')}"
SPLIT = """CASE WHEN idx < floor(n * 0.7::DOUBLE) THEN 'train'
  WHEN idx < floor(n * 0.85::DOUBLE) THEN 'val' ELSE 'test' END"""


@query("split_chrono", f"{BASE} SELECT symbol, bar, {SPLIT} AS split FROM ix")
def split_chrono(spark, d):
    return sp.split_chrono(frames.indexed_bars(spark, d), CUTS).select("symbol", "bar", "split")


def _folds_sql(n_groups: int, n_test: int, purge: int) -> str:
    values = ", ".join(
        f"({k}, {g}, {'true' if g in c else 'false'}, {'true' if g + 1 in c else 'false'})"
        for k, c in enumerate(combinations(range(n_groups), n_test))
        for g in range(n_groups)
    )
    return f"""folds(fold, grp, is_test, pre_test) AS (VALUES {values}),
    g AS (SELECT symbol, bar, idx, n, least(idx // (n // {n_groups}), {n_groups - 1}) AS grp FROM ix),
    roles AS (SELECT symbol, bar, fold,
      CASE WHEN is_test THEN 'test'
           WHEN pre_test AND idx >= (grp + 1) * (n // {n_groups}) - {purge} THEN NULL
           ELSE 'train' END AS role
      FROM g JOIN folds USING (grp))"""


@query(
    "cpcv",
    f"""{BASE}, {_folds_sql(5, 2, 50)} SELECT symbol, bar, CAST(fold AS INTEGER) AS fold, role
    FROM roles WHERE role IS NOT NULL""",
)
def cpcv(spark, d):
    return sp.cpcv(frames.indexed_bars(spark, d), 5, 2, 50).select("symbol", "bar", "fold", "role")


@query(
    "scaler",
    f"""{BASE}, tr AS (SELECT symbol, avg(close) AS m1, stddev_pop(close) AS s1, avg(volume) AS m2,
      stddev_pop(volume) AS s2 FROM ix WHERE {SPLIT} = 'train' GROUP BY 1)
    SELECT symbol, bar, {R('(close - m1) / CASE WHEN s1 = 0 THEN 1 ELSE s1 END', 6)} AS close_scaled,
    {R('(volume - m2) / CASE WHEN s2 = 0 THEN 1 ELSE s2 END', 6)} AS volume_scaled
    FROM ix JOIN tr USING (symbol)""",
)
def scaler(spark, d):
    rows = sp.split_chrono(frames.indexed_bars(spark, d), CUTS)
    cols = ["close", "volume"]
    fit = sp.fit_scaler(rows, cols, F.col("split") == "train")
    return sp.apply_scaler(rows, fit, cols).select(
        "symbol", "bar", *[rnd(f"{c}_scaled", 6).alias(f"{c}_scaled") for c in cols]
    )


@query(
    "sequences",
    f"""{BASE} SELECT symbol, bar, array_to_string(list(close) OVER w, '|') AS closes,
    len(list(close) OVER w) AS length FROM ix
    WINDOW w AS (PARTITION BY symbol ORDER BY idx ROWS 59 PRECEDING) QUALIFY idx >= 59""",
)
def sequences(spark, d):
    rows = sp.sequences(frames.indexed_bars(spark, d), ["close", "volume"], 60)
    text = F.transform("sequence", lambda x: x[0].cast("string"))
    return rows.select(
        "symbol", "bar", F.array_join(text, "|").alias("closes"),
        F.size("sequence").cast("long").alias("length"),
    )
