"""First bar after a start that touches a price barrier.

This is a range join that keeps only the first match.  As a join it would emit
every bar of the window for every query; here each chunk of a series, extended
by the next ``width`` bars, meets its queries in one task and NumPy walks all
open queries forward together, so nothing is multiplied.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.scan import chunk_with_future

CHUNK = 16_384

HIT = ["hit_idx long", "hit_bar timestamp_ntz", "hit_open double", "hit_high double",
       "hit_low double", "hit_close double", "end_idx long", "end_bar timestamp_ntz",
       "end_close double"]


def walk(low, high, start, stop, floor, ceiling) -> np.ndarray:
    """Position of the first bar in ``[start, stop)`` with ``low <= floor`` or
    ``high >= ceiling``; -1 where there is none."""
    found = np.full(len(start), -1, dtype=np.int64)
    live = np.flatnonzero(start < stop)
    pos = start[live].copy()
    while live.size:
        hit = (low[pos] <= floor[live]) | (high[pos] >= ceiling[live])
        found[live[hit]] = pos[hit]
        pos = pos + 1
        open_ = ~hit & (pos < stop[live])
        live, pos = live[open_], pos[open_]
    return found


def first_touch(
    bars: DataFrame, queries: DataFrame, width: int, chunk: int = CHUNK, blocks: int = 1
) -> DataFrame:
    """Queries with the bar that touches first and the last bar of their window.

    ``bars``: ``symbol, bar, idx, n`` and prices, dense ``idx``.  ``queries``:
    ``symbol``, ``start``, ``stop`` (bar numbers, end exclusive, at most
    ``width`` apart), ``floor`` and ``ceiling`` prices (infinite when unused),
    plus any other columns.  With more than one of ``blocks``, ``set_block`` numbers the
    block of a query from 0, and a task holds the queries of one chunk and block.  ``hit_*`` is NULL without a touch; ``end_*`` is
    the bar ``stop - 1``, NULL if the series ends before it.
    """
    if width > chunk:
        # a chunk is extended by the bars of the next one only
        chunk = width
    prices = ["open", "high", "low", "close"]
    # fresh names: a cogroup of two plans over one table must not share columns
    spread = chunk_with_future(bars.select("symbol", "bar", "idx", "n", *prices), chunk, width)
    series = spread.select(
        *[F.col(c).alias(f"b_{c}") for c in ("symbol", "_chunk", "bar", "idx", *prices)]
    )
    key = ["symbol", "_chunk"]
    if blocks > 1:
        key.append("set_block")
        series = series.withColumn("b_set_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = queries.withColumn("_chunk", F.floor(F.col("start") / chunk))
    schema = ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" for f in queries.schema.fields
    )
    names = queries.columns

    def per_chunk(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if q.empty:
            return pd.DataFrame(columns=[*names, *[h.split()[0] for h in HIT]])
        q = q[names].reset_index(drop=True)
        if b.empty:  # the window starts after the last bar
            return q.reindex(columns=[*names, *[h.split()[0] for h in HIT]])
        b = b.rename(columns=lambda c: c[2:]).sort_values("idx", ignore_index=True)
        base = int(b["idx"].iloc[0])
        start = q["start"].to_numpy(np.int64) - base
        wanted = q["stop"].to_numpy(np.int64) - base
        stop = np.minimum(wanted, len(b))
        hit = walk(
            b["low"].to_numpy(float), b["high"].to_numpy(float), start, stop,
            q["floor"].to_numpy(float), q["ceiling"].to_numpy(float),
        )
        end = np.where((wanted <= len(b)) & (wanted > start), wanted - 1, -1)
        at_hit = b.reindex(np.where(hit >= 0, hit, len(b) + 1)).reset_index(drop=True)
        at_end = b.reindex(np.where(end >= 0, end, len(b) + 1)).reset_index(drop=True)
        for name in ("idx", "bar", *prices):
            q[f"hit_{name}"] = at_hit[name]
        for name in ("idx", "bar", "close"):
            q[f"end_{name}"] = at_end[name]
        for name in ("hit_idx", "end_idx"):
            q[name] = q[name].astype("Int64")
        return q

    return (
        asked.groupBy(*key)
        .cogroup(series.groupBy(*[f"b_{k}" for k in key]))
        .applyInPandas(per_chunk, schema + ", " + ", ".join(HIT))
    )
