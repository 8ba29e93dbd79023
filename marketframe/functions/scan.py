"""Ordered computation without one task per key.

Every helper splits the rows of a key into chunks (a day, an hour, a block of
row numbers, a score bucket), works inside ``(key, chunk)`` and carries one
summary row per chunk across.  A key that holds a third of the data is spread
over all its chunks; only the summaries (one row per key and chunk) meet in a
per-key window.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F


@dataclass(frozen=True)
class Running:
    """One running value: ``kind`` is sum, count, max, min, last or first."""

    out: str
    kind: str
    expr: Column
    inclusive: bool = True


_LOCAL = {
    "sum": F.sum,
    "count": F.count,
    "max": F.max,
    "min": F.min,
    "last": lambda c: F.last(c, ignorenulls=True),
    "first": lambda c: F.first(c, ignorenulls=True),
}


def _summary(kind: str, expr: Column, order: Sequence[str]) -> Column:
    if kind in ("last", "first"):
        key = F.col(order[0]) if len(order) == 1 else F.struct(*order)
        pick = F.max_by if kind == "last" else F.min_by
        return pick(expr, F.when(expr.isNotNull(), key))
    return _LOCAL[kind](expr)


def _merge(kind: str, carry: Column, local: Column) -> Column:
    if kind in ("sum", "count"):
        return F.coalesce(carry, F.lit(0)) + F.coalesce(local, F.lit(0))
    if kind == "max":
        return F.greatest(carry, local)
    if kind == "min":
        return F.least(carry, local)
    if kind == "last":
        return F.coalesce(local, carry)
    return F.coalesce(carry, local)


def running(
    df: DataFrame,
    keys: Sequence[str],
    chunk: Column,
    order: Sequence[str],
    specs: Sequence[Running],
    few: bool = False,
) -> DataFrame:
    """Running aggregates per key in ``order``; ``chunk`` must be monotone in it.

    ``order`` should be unique inside a key.  ``df`` is read twice (summaries
    and rows), so hand in a scan or a materialised intermediate.  ``few`` chunks, of many
    rows each, send their summaries to every executor, and the rows stay as they are dealt.
    """
    keys, order = list(keys), list(order)
    rows = df.withColumn("_ck", chunk)
    sums = rows.groupBy(*keys, "_ck").agg(
        *[_summary(s.kind, s.expr, order).alias(f"_s{i}") for i, s in enumerate(specs)]
    )
    before = (
        Window.partitionBy(*keys).orderBy("_ck").rowsBetween(Window.unboundedPreceding, -1)
    )
    carry_kind = {"count": F.sum}
    carries = sums.select(
        *[F.col(k).alias(f"_k{j}") for j, k in enumerate(keys)],
        F.col("_ck").alias("_ckc"),
        *[
            carry_kind.get(s.kind, _LOCAL[s.kind])(F.col(f"_s{i}")).over(before).alias(f"_c{i}")
            for i, s in enumerate(specs)
        ],
    )
    on = F.col("_ck").eqNullSafe(F.col("_ckc"))
    for j, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{j}"))
    inside = Window.partitionBy(*keys, "_ck").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    prior = inside.rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(F.broadcast(carries) if few else carries, on, "inner")
    return out.select(
        *df.columns,
        *[
            _merge(
                s.kind,
                F.col(f"_c{i}"),
                _LOCAL[s.kind](s.expr).over(upto if s.inclusive else prior),
            ).alias(s.out)
            for i, s in enumerate(specs)
        ],
    )


def _by_key(rows: DataFrame, summaries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with the summary of their key and chunk; a null key is a key."""
    other = summaries.select(
        *[F.col(k).alias(f"_k{j}") for j, k in enumerate(keys)],
        *[c for c in summaries.columns if c not in keys],
    )
    on = F.lit(True)
    for j, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{j}"))
    return rows.join(other, on).drop(*[f"_k{j}" for j in range(len(keys))])


def with_row_index(
    df: DataFrame,
    ts: str,
    keys: Sequence[str] = ("symbol",),
    fill: Sequence[str] = (),
    valid: Column | None = None,
) -> DataFrame:
    """Dense 0-based ``idx`` and row count ``n`` per key in time order.

    Rows are numbered inside a day; day counts give the offset.  On the way,
    with the same two shuffles, columns in ``fill`` are forward filled and the
    rows that satisfy ``valid`` get their own dense ``valid_idx`` and
    ``valid_n``, for steps that later keep only those rows.
    """
    keys = list(keys)
    rows = df.withColumn("_day", F.col(ts).cast("date"))
    good = F.when(F.lit(True) if valid is None else valid, 1).otherwise(0)
    days = rows.groupBy(*keys, "_day").agg(
        F.count(F.lit(1)).alias("_cnt"),
        F.sum(good).alias("_vcnt"),
        *[
            F.max_by(c, F.when(F.col(c).isNotNull(), F.col(ts))).alias(f"_l_{c}")
            for c in fill
        ],
    )
    by = Window.partitionBy(*keys)
    before = by.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    offsets = days.select(
        *keys,
        "_day",
        F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"),
        F.sum("_cnt").over(by).alias("n"),
        F.coalesce(F.sum("_vcnt").over(before), F.lit(0)).alias("_voff"),
        F.sum("_vcnt").over(by).alias("valid_n"),
        *[F.last(f"_l_{c}", ignorenulls=True).over(before).alias(f"_f_{c}") for c in fill],
    )
    inside = Window.partitionBy(*keys, "_day").orderBy(ts)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    joined = _by_key(rows, offsets, [*keys, "_day"])
    filled = {
        c: F.coalesce(F.last(c, ignorenulls=True).over(upto), F.col(f"_f_{c}")).alias(c)
        for c in fill
    }
    return joined.select(
        *[filled.get(c, F.col(c)) for c in df.columns],
        (F.col("_off") + F.row_number().over(inside) - 1).alias("idx"),
        "n",
        *(
            []
            if valid is None
            else [(F.col("_voff") + F.sum(good).over(upto) - 1).alias("valid_idx"), "valid_n"]
        ),
    )


def chunk_with_past(df: DataFrame, chunk: int, halo: int) -> DataFrame:
    """Assign rows to chunks of ``chunk`` row numbers plus ``halo`` earlier rows.

    Adds ``_chunk`` and ``_own``; the copies cost ``halo / chunk`` extra rows.
    """
    own = F.floor(F.col("idx") / chunk)
    lends = (F.col("idx") % chunk >= chunk - halo) & ((own + 1) * chunk < F.col("n"))
    both = F.when(lends, F.array(own, own + 1)).otherwise(F.array(own))
    return df.withColumn("_chunk", F.explode(both)).withColumn(
        "_own", F.col("_chunk") == F.floor(F.col("idx") / chunk)
    )


def chunk_with_future(df: DataFrame, chunk: int, halo: int) -> DataFrame:
    """As ``chunk_with_past`` with the first ``halo`` rows of the next chunk."""
    own = F.floor(F.col("idx") / chunk)
    lends = (F.col("idx") % chunk < halo) & (own > 0)
    both = F.when(lends, F.array(own - 1, own)).otherwise(F.array(own))
    return df.withColumn("_chunk", F.explode(both)).withColumn(
        "_own", F.col("_chunk") == F.floor(F.col("idx") / chunk)
    )


def running_peak(
    df: DataFrame,
    keys: Sequence[str],
    chunk: Column,
    order: Sequence[str],
    sums: dict[str, Column],
    peak_of: str,
) -> DataFrame:
    """Running sums, and the running maximum ``peak`` of one of them.

    ``peak_before`` is the maximum up to the row before; both are NULL where no
    row has been seen.  A chunk hands on its totals and its highest local sum,
    so the maximum of a sum needs no second pass.
    """
    keys, order = list(keys), list(order)
    inside = Window.partitionBy(*keys, "_ck").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    prior = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = (
        df.withColumn("_ck", chunk)
        .withColumns({f"_l_{o}": F.sum(e).over(upto) for o, e in sums.items()})
        .withColumns(
            {
                "_hi": F.max(f"_l_{peak_of}").over(upto),
                "_hi0": F.max(f"_l_{peak_of}").over(prior),
            }
        )
    )
    totals = local.groupBy(*keys, "_ck").agg(
        *[F.sum(e).alias(f"_t_{o}") for o, e in sums.items()], F.max("_hi").alias("_top")
    )
    before = Window.partitionBy(*keys).orderBy("_ck").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumns(
        {f"_o_{o}": F.coalesce(F.sum(f"_t_{o}").over(before), F.lit(0)) for o in sums}
    ).withColumn("_past", F.max(F.col(f"_o_{peak_of}") + F.col("_top")).over(before))
    base = F.col(f"_o_{peak_of}")
    # one summary row per chunk makes a small hash table; the rows need no second sort
    carried = offsets.select(*keys, "_ck", "_past", *[f"_o_{o}" for o in sums]).hint("shuffle_hash")
    out = _by_key(local, carried, [*keys, "_ck"])
    return out.select(
        *df.columns,
        *[(F.col(f"_o_{o}") + F.col(f"_l_{o}")).alias(o) for o in sums],
        F.greatest("_past", base + F.col("_hi")).alias("peak"),
        F.greatest("_past", base + F.col("_hi0")).alias("peak_before"),
    )


def islands(
    df: DataFrame, keys: Sequence[str], chunk: Column, value: str, breaks
) -> DataFrame:
    """Add ``island``: the first ``value`` of the run a row belongs to.

    Rows are ordered by ``value``; ``breaks(previous, current)`` says where a
    new run starts.  Chunks hand on their ends and their last inner break.
    """
    keys = list(keys)
    v = F.col(value)
    inside = Window.partitionBy(*keys, "_ck").orderBy(value)
    # equal values share a run, so frames end at the last equal value
    upto = inside.rangeBetween(Window.unboundedPreceding, 0)
    prev = F.lag(value).over(inside)
    local = df.withColumn("_ck", chunk).withColumn("_brk", F.when(breaks(prev, v), v))
    ends = local.groupBy(*keys, "_ck").agg(
        F.min(value).alias("_first"), F.max(value).alias("_last"), F.max("_brk").alias("_inner")
    )
    by_chunk = Window.partitionBy(*keys).orderBy("_ck")
    left = F.lag("_last").over(by_chunk)
    opens = F.when(left.isNull() | breaks(left, F.col("_first")), F.col("_first"))
    ends = ends.withColumn("_opens", opens)
    newest = F.coalesce("_inner", "_opens")
    ends = ends.withColumn(
        "_carry",
        F.last(newest, ignorenulls=True).over(by_chunk.rowsBetween(Window.unboundedPreceding, -1)),
    )
    start = F.coalesce(F.max("_brk").over(upto), F.col("_opens"), F.col("_carry"))
    return (
        _by_key(local, ends.select(*keys, "_ck", "_opens", "_carry"), [*keys, "_ck"])
        .withColumn("island", start)
        .select(*df.columns, "island")
    )
