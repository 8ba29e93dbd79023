"""Forward-looking labels: direction, limit fill and triple-barrier outcome."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass, fields

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.scan import chunk_with_future
from .sweeps import SET_BLOCK, Sets, as_sets
from .touch import CHUNK, walk


@dataclass(frozen=True)
class LabelParams:
    """Offsets in ATR units, fill horizon and holding time in bars."""

    offset: float = 0.88
    take_profit: float = 1.2
    stop_loss: float = 3.9
    horizon: int = 60
    max_hold: int = 180

    @property
    def reach(self) -> int:
        return self.horizon + self.max_hold + 1


# Fixed value: move in ATR units that counts as a direction.
DIRECTION_ATR = 0.5

_SCHEMA = (
    "set_id int, symbol string, bar timestamp_ntz, idx long,"
    " target_long int, target_short int, target_dir_long int, target_dir_short int,"
    " fill_long_idx long, fill_long_price double, fill_short_idx long, fill_short_price double"
)


def _one_side(o, h, lo, i, n_local, limit, atr, sign, p: LabelParams):
    """Fill position and price and whether the target comes before the stop."""
    away = np.full(len(i), np.inf)
    first, last = i + 1, np.minimum(i + p.horizon + 1, n_local)
    if sign > 0:
        fill = walk(lo, h, first, last, limit, away)
    else:
        fill = walk(lo, h, first, last, -away, limit)
    filled = fill >= 0
    at_open = o[np.where(filled, fill, 0)]
    better = at_open < limit if sign > 0 else at_open > limit
    price = np.where(better, at_open, limit)
    target = price + sign * atr * p.take_profit
    stop = price - sign * atr * p.stop_loss
    until = np.where(filled, np.minimum(fill + p.max_hold, n_local), 0)
    floor, ceiling = (stop, target) if sign > 0 else (target, stop)
    end = walk(lo, h, np.where(filled, fill, 0), until, floor, ceiling)
    at = np.where(end >= 0, end, 0)
    stopped = lo[at] <= stop if sign > 0 else h[at] >= stop
    return fill, price, (end >= 0) & ~stopped


def _label_chunk(pdf: pd.DataFrame, sets: Sequence[tuple[int, LabelParams]]) -> pd.DataFrame:
    pdf = pdf.sort_values("idx", ignore_index=True)
    o, h, lo, c, atr = (pdf[x].to_numpy(float) for x in ("open", "high", "low", "close", "atr"))
    idx, n = pdf["idx"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
    own = np.flatnonzero(pdf["_own"].to_numpy(bool))
    parts = []
    for k, p in sets:
        usable = own[(idx[own] < n[own] - p.max_hold - 1) & (atr[own] > 0)]
        a, ci = atr[usable], c[usable]
        ahead = c[np.minimum(usable + p.horizon, len(c) - 1)]
        out = pdf.loc[own, ["symbol", "bar", "idx"]].copy()
        out.insert(0, "set_id", np.int32(k))

        def put(name, values, missing, kind):
            full = pd.Series(missing, index=own, dtype=kind)
            full.loc[usable] = values
            out[name] = full

        fl, pl, wl = _one_side(o, h, lo, usable, len(c), ci - a * p.offset, a, 1, p)
        fs, ps, ws = _one_side(o, h, lo, usable, len(c), ci + a * p.offset, a, -1, p)
        put("target_long", wl.astype("int32"), 0, "int32")
        put("target_short", ws.astype("int32"), 0, "int32")
        put("target_dir_long", (ahead > ci + a * DIRECTION_ATR).astype("int32"), 0, "int32")
        put("target_dir_short", (ahead < ci - a * DIRECTION_ATR).astype("int32"), 0, "int32")
        base = idx[0]
        for side, f, price in (("long", fl, pl), ("short", fs, ps)):
            hit = f >= 0
            put(f"fill_{side}_idx", pd.array(np.where(hit, f + base, -1)), -1, "Int64")
            out[f"fill_{side}_idx"] = out[f"fill_{side}_idx"].mask(out[f"fill_{side}_idx"] < 0)
            put(f"fill_{side}_price", np.where(hit, price, np.nan), np.nan, "float64")
        parts.append(out)
    return pd.concat(parts, ignore_index=True)


def label_sweep(
    bars: DataFrame, sets: Sequence[LabelParams] | DataFrame | Sets, chunk: int = CHUNK
) -> DataFrame:
    """Labels of every bar for every parameter set.

    ``sets`` is a list (``set_id`` is the position), a table with ``set_id`` and any of the
    fields of ``LabelParams``, or such a table in blocks.  A task labels one chunk of a
    series for one block of sets.  ``bars`` needs ``symbol, bar, idx, n, atr`` and prices.
    The last ``max_hold + 1`` bars of a series and bars without ATR are labelled 0.
    """
    needed = ["symbol", "bar", "idx", "n", "open", "high", "low", "close", "atr"]
    short = isinstance(sets, Sequence) and len(sets) <= SET_BLOCK
    if not short:
        held = as_sets(bars.sparkSession, sets, LabelParams)
        p = F.col("p")
        reach = held.largest(p["horizon"] + p["max_hold"]) + 1
    else:
        reach = max(p.reach for p in sets)
    chunk = max(chunk, reach)
    rows = chunk_with_future(bars.select(*needed), chunk, reach)
    if short:
        given = list(enumerate(LabelParams(**asdict(p)) for p in sets))
        out = rows.groupBy("symbol", "_chunk").applyInPandas(
            lambda pdf: _label_chunk(pdf, given), _SCHEMA
        )
    else:
        names = [f.name for f in fields(LabelParams)]
        chunks = held.beside(rows.select("symbol", "_chunk").distinct()).select(
            F.col("symbol").alias("s_symbol"), F.col("_chunk").alias("s_chunk"),
            F.col("set_block").alias("s_block"), F.inline("sets"),
        )

        def per_block(params: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
            given = [
                (r.set_id, LabelParams(**{n: getattr(r, n) for n in names}))
                for r in params.sort_values("set_id").itertuples(index=False)
            ]
            return _label_chunk(pdf, given)

        copies = rows.withColumn("set_block", F.explode(held.numbers))
        out = (
            chunks.groupBy("s_symbol", "s_chunk", "s_block")
            .cogroup(copies.groupBy("symbol", "_chunk", "set_block"))
            .applyInPandas(per_block, _SCHEMA)
        )
    # missing fills leave Python as NaN
    return out.withColumns(
        {f"fill_{s}_price": F.nanvl(f"fill_{s}_price", F.lit(None)) for s in ("long", "short")}
    )


def labels(bars: DataFrame, params: LabelParams = LabelParams(), chunk: int = CHUNK) -> DataFrame:
    return label_sweep(bars, [params], chunk).drop("set_id")


def add_labels(features: DataFrame, params: LabelParams = LabelParams()) -> DataFrame:
    """Feature frame with the four target columns."""
    targets = labels(features, params).select(
        "symbol", "idx", "target_long", "target_short", "target_dir_long", "target_dir_short"
    )
    return features.join(targets, ["symbol", "idx"])


def label_counts(labelled: DataFrame, keys: Sequence[str], minimum: int = 50) -> DataFrame:
    """Positive labels per key; ``usable`` is false under ``minimum`` long targets."""
    total = lambda c: F.sum(c).cast("long").alias(c.replace("target", "positives"))
    return labelled.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        *[
            total(c)
            for c in ("target_long", "target_short", "target_dir_long", "target_dir_short")
        ],
    ).withColumn("usable", F.col("positives_long") >= minimum)
