"""Nearest neighbours by inner product, as a block matrix join.

Queries and candidates are dealt to blocks by their ids and meet as tiles, one
cogrouped task input each, of bounded size.  Inside a tile vectors are quantised
to int8 with one scale each; the product of int8 blocks (exact in floating point)
gives every inner product with an error bound from the residual norms
(Cauchy-Schwarz).  Pairs whose upper bound reaches the k-th best lower bound of
their query survive, are recomputed from the original vectors in double precision,
and give the tile's best k in order.  The ordered lists of a query are merged by a
heap, first within groups of tiles and then over the groups.

The bound is never wrong, so the result is that of a full search (recall 1).

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components, and rows without an id, take no part; vectors meet only those of equal
length; a query's own id is no candidate; rows that repeat id and vector count once;
ties go to the smaller id; with fewer candidates than k all are returned; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from marketframe.llm.common import parts_for, pick, table
from marketframe.llm.registry import query

#: Rows of a block; a tile meets two blocks.
BLOCK_ROWS = 4096
#: Queries and candidates multiplied at once inside a tile.
STEP = (512, 4096)
#: Tiles whose lists meet in the first merge.
MERGE_TILES = 256

_BEST = pa.schema(
    [
        ("query_id", pa.int64()),
        ("query_hash", pa.int64()),
        ("group", pa.int64()),
        ("ids", pa.list_(pa.int64())),
        ("scores", pa.list_(pa.float64())),
    ]
)
_BEST_DDL = "query_id long, query_hash long, group long, ids array<long>, scores array<double>"


class Quantised:
    """int8 rows with scales, norms of the rounded rows and of what rounding left."""

    def __init__(self, vectors: np.ndarray):
        exact = vectors.astype(np.float64)
        scale = np.abs(exact).max(axis=1) / 127.0
        # scales too small to divide by leave the row to the residual
        safe = np.where(scale > 0, scale, 1.0)
        self.codes = np.rint(exact / safe[:, None]).astype(np.int8)
        self.scale = scale
        rounded = self.codes * scale[:, None]
        self.norm = np.linalg.norm(rounded, axis=1)
        self.left = np.linalg.norm(exact - rounded, axis=1)


def bounds(a: Quantised, rows: slice, b: Quantised, cols: slice) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the inner products of a tile part."""
    # int8 products sum exactly in single precision up to this many components
    kind = np.float32 if a.codes.shape[1] * 127 * 127 < 1 << 24 else np.float64
    product = (a.codes[rows].astype(kind) @ b.codes[cols].astype(kind).T).astype(np.float64)
    product *= a.scale[rows, None]
    product *= b.scale[cols]
    error = np.outer(a.norm[rows], b.left[cols])
    error += np.outer(a.left[rows], b.norm[cols] + b.left[cols])
    # room for the rounding of this arithmetic itself
    error += 1e-9 * np.outer(a.norm[rows] + a.left[rows], b.norm[cols] + b.left[cols])
    return product - error, product + error


def inner_products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of paired rows in double precision, components added in order."""
    total = np.zeros(len(x), dtype=np.float64)
    for d in range(x.shape[1]):
        total += x[:, d].astype(np.float64) * y[:, d]
    return total


def tile_best(ids, vectors, other_ids, others, k: int):
    """Per query: ids and scores of its best ``k`` candidates, best first."""
    a, b = Quantised(vectors), Quantised(others)
    n, m = len(ids), len(other_ids)
    for i in range(0, n, STEP[0]):
        rows = slice(i, min(i + STEP[0], n))
        floor = np.full((rows.stop - i, k), -np.inf)
        found_q, found_c, found_up = [], [], []
        for j in range(0, m, STEP[1]):
            cols = slice(j, min(j + STEP[1], m))
            low, up = bounds(a, rows, b, cols)
            own = ids[rows, None] == other_ids[cols]
            low[own], up[own] = -np.inf, -np.inf
            best = np.concatenate([floor, low], axis=1)
            floor = -np.partition(-best, k - 1, axis=1)[:, :k]
            q, c = np.nonzero((up >= floor.min(axis=1)[:, None]) & (up > -np.inf))
            found_q.append(q)
            found_c.append(c + j)
            found_up.append(up[q, c])
        q, c, up = (np.concatenate(x) for x in (found_q, found_c, found_up))
        stay = up >= floor.min(axis=1)[q]
        q, c = q[stay], c[stay]
        for at, score_of in _scored(q, c, vectors[rows], others):
            order = np.lexsort((other_ids[c[at]], -score_of))[:k]
            yield i + int(q[at.start]), other_ids[c[at]][order], score_of[order]


def _scored(q: np.ndarray, c: np.ndarray, vectors: np.ndarray, others: np.ndarray, pairs=200_000):
    """Slices of the pairs, one per query, with exact scores; ``q`` gets sorted first."""
    order = np.argsort(q, kind="stable")
    q[:], c[:] = q[order], c[order]
    scores = np.empty(len(q), dtype=np.float64)
    for at in range(0, len(q), pairs):
        part = slice(at, at + pairs)
        scores[part] = inner_products(vectors[q[part]], others[c[part]])
    starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.array([], dtype=int)
    for s, e in zip(starts, np.r_[starts[1:], len(q)]):
        yield slice(int(s), int(e)), scores[s:e]


def _unique(rows: pa.Table):
    ids = rows["vec_id"].to_numpy()
    flat = rows["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    vectors, hashes = flat.reshape(len(ids), -1), rows["hash"].to_numpy()
    # repeated rows are next to each other in this order
    order = np.lexsort((hashes, ids))
    ids, vectors, hashes = ids[order], vectors[order], hashes[order]
    same = np.r_[False, (ids[1:] == ids[:-1]) & (hashes[1:] == hashes[:-1])]
    return ids[~same], vectors[~same], hashes[~same]


def _tile(k: int):
    def tile(key, queries: pa.Table, candidates: pa.Table) -> pa.Table:
        if not queries.num_rows or not candidates.num_rows:
            return _BEST.empty_table()
        ids, vectors, hashes = _unique(queries)
        other_ids, others, _ = _unique(candidates)
        block = key[1].as_py()
        out = [
            (int(ids[q]), int(hashes[q]), block // MERGE_TILES, best.tolist(), scores.tolist())
            for q, best, scores in tile_best(ids, vectors, other_ids, others, k)
        ]
        columns = list(zip(*out)) if out else [()] * len(_BEST)
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, _BEST)], schema=_BEST)

    return tile


def _merger(k: int):
    def merge(batches):
        """Lists arrive sorted by query, so each query's lists are neighbours."""
        held, key = [], None
        out = []

        def close():
            merged = heapq.merge(*[zip((-s for s in ss), ii) for ii, ss in held])
            best = list(islice(merged, k))
            out.append((*key, [i for _, i in best], [-s for s, _ in best]))

        for batch in batches:
            rows = batch.to_pydict()
            for q, h, g, ii, ss in zip(*[rows[f.name] for f in _BEST]):
                if (q, h, g) != key:
                    if held:
                        close()
                    held, key = [], (q, h, g)
                held.append((ii, ss))
            yield _flush(out)
        if held:
            close()
        yield _flush(out)

    return merge


def _flush(out: list) -> pa.RecordBatch:
    columns = list(zip(*out)) if out else [()] * len(_BEST)
    out.clear()
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, _BEST)], schema=_BEST
    )


def merge_lists(lists: DataFrame, k: int) -> DataFrame:
    key = ["query_id", "query_hash", "group"]
    return (
        lists.repartition(*key).sortWithinPartitions(*key).mapInArrow(_merger(k), _BEST_DDL)
    )


def usable(vector: Column) -> Column:
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    )
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(
    queries: DataFrame,
    candidates: DataFrame,
    k: int,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of each query's ``k`` best candidates."""

    def rows(df: DataFrame) -> DataFrame:
        picked = pick(df, vec_id=vec_id, vector=vector).filter(
            F.col("vec_id").isNotNull() & usable(F.col("vector"))
        )
        return picked.select(
            F.col("vec_id").cast("long").alias("vec_id"),
            "vector",
            F.size("vector").alias("dims"),
            F.xxhash64("vector").alias("hash"),
        )

    asked, stored = rows(queries), rows(candidates)
    asked_blocks = parts_for(queries.count(), block_rows)
    stored_blocks = parts_for(candidates.count(), block_rows)

    def tiles(df: DataFrame, own: str, n: int, other: str, others: int) -> DataFrame:
        return df.withColumns(
            {
                own: F.pmod(F.xxhash64("vec_id"), F.lit(n)),
                other: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long"))),
            }
        )

    left = tiles(asked, "query_block", asked_blocks, "block", stored_blocks)
    right = tiles(stored, "block", stored_blocks, "query_block", asked_blocks)
    key = ["query_block", "block", "dims"]
    lists = (
        left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_tile(k), _BEST_DDL)
    )
    if stored_blocks > MERGE_TILES:
        lists = merge_lists(lists, k)
    merged = merge_lists(lists.withColumn("group", F.lit(0).cast("long")), k)
    return merged.select(
        "query_id", F.posexplode(F.arrays_zip("ids", "scores")).alias("pos", "hit")
    ).select(
        "query_id",
        (F.col("pos") + 1).alias("rank"),
        F.col("hit.ids").alias("vec_id"),
        F.col("hit.scores").alias("score"),
    )


SQL = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
  WHERE q.vec_id % 20 = 0
)
SELECT query_id, rank, vec_id, score
FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER
      AS rank FROM p)
WHERE rank <= 20
"""


@query("op6_block_matrix_knn", SQL)
def op6_block_matrix_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors.filter("vec_id % 20 = 0"), vectors, k=20)
