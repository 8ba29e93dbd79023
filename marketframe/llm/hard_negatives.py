"""Hard negatives by inner product, from sort-tile-recursive packed R-trees.

Rows are points: their label, then their components, both as integers.  Spark does the
upper levels of the packing: all points are cut into slabs by label and each slab into
tiles by the coordinate that varies most, at approximate percentiles; a hash of the row
is added as a fraction, so that rows with equal coordinates, however many, are dealt
evenly too.  A tile holds a bounded number of rows and packs them further into the
leaves and inner boxes of its tree (``Tree``).

Anchors meet the tiles in bounded blocks, one cogrouped task input each.  The minimum
bounding box of a node gives each coordinate's interval, and with it an interval of the
anchor's inner product with everything in the box.  A best-first queue visits boxes by
their upper end and prunes those that hold no row of the wanted labels, those outside
the windows of scores asked for, and those strictly below the k-th best score found.
All of it is integer arithmetic, so bounds and results are exact.

Two rounds: the first finds the positives of each anchor (same label, best first), the
second the negatives (other label) within a window of scores below each positive.  The
best of each tile are merged by a ranked window, which Spark limits before the shuffle.

Defined results: rows without an id, a label or a vector, or with a null or non-finite
component, take no part; rows that repeat id, label and vector count once, and a row's
own id is neither its positive nor its negative; rows meet only vectors of equal
length; equal scores go to the smaller id; an anchor without positives, and a positive
without negatives in its window, gives no rows; a score beyond 64 bits counts as the
nearest 64-bit integer; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from marketframe.functions.storage import materialise
from marketframe.llm.common import parts_for, pick, table
from marketframe.llm.registry import query

#: Rows of a tile, and anchors that meet it in one task input.
TILE_ROWS = 8192
ANCHOR_ROWS = 1024
#: Rows of a leaf and boxes of an inner node.
LEAF, FANOUT = 64, 8
#: Scale of components before they are rounded down; a fixed value.
SCALE = 256
#: Lowest share of the positive's score that a negative needs, in percent.
SHARE = 80

_LONG = (-(1 << 63), (1 << 63) - 1)


def exact_type(*sides: np.ndarray):
    """Number type in which inner products of these integer-valued rows are exact."""
    most = float(sides[0].shape[1])
    for side in sides:
        most *= float(np.abs(side).max()) if side.size else 0.0
    if most < 1 << 53:
        return np.float64
    return np.int64 if most < (1 << 62) else object


def clamped(scores: np.ndarray) -> np.ndarray:
    """Scores as 64-bit integers can hold them."""
    return np.clip(scores, *_LONG) if scores.dtype == object else scores


class Tree:
    """Sort-tile-recursive packed R-tree over integer points with labels."""

    def __init__(self, points: np.ndarray, labels: np.ndarray, leaf: int = LEAF, fanout: int = FANOUT):
        spread = np.argsort(-points.astype(np.float64).std(axis=0), kind="stable")
        pages = -(-len(points) // leaf)
        depth = max(1, round(math.log2(max(2, pages)) / 2))
        keys = [labels, *[points[:, d] for d in spread[:depth]]]
        runs = list(self._packed(np.arange(len(points)), keys, leaf))
        self.order = np.concatenate(runs)
        self.points, self.labels = points[self.order], labels[self.order]
        starts = np.cumsum([0, *[len(r) for r in runs]])
        #: Per node: first and last child (or row, for leaves), leaves first, the root last.
        self.spans = list(zip(starts[:-1].tolist(), starts[1:].tolist()))
        self.leaves = len(runs)
        boxes = [self._boxes(self.points, self.points, self.labels, self.labels, starts[:-1])]
        first = 0
        while len(boxes[-1][0]) > 1:
            low, high, least, most = boxes[-1]
            at = np.arange(0, len(low), fanout)
            boxes.append(self._boxes(low, high, least, most, at))
            self.spans += [(first + int(s), first + min(int(s) + fanout, len(low))) for s in at]
            first += len(low)
        self.low, self.high, self.least, self.most = (
            np.concatenate([b[i] for b in boxes]) for i in range(4)
        )

    def _packed(self, rows: np.ndarray, keys: list[np.ndarray], leaf: int):
        """Runs of at most ``leaf`` rows: sort by a coordinate, cut into slabs, go on inside."""
        pages = -(-len(rows) // leaf)
        if pages <= 1:
            yield rows
            return
        rows = rows[np.argsort(keys[0][rows], kind="stable")]
        slabs = pages if len(keys) == 1 else math.ceil(pages ** (1 / len(keys)))
        size = -(-pages // slabs) * leaf
        for at in range(0, len(rows), size):
            yield from self._packed(rows[at : at + size], keys[1:] or keys, leaf)

    @staticmethod
    def _boxes(low, high, least, most, starts):
        return (
            np.minimum.reduceat(low, starts),
            np.maximum.reduceat(high, starts),
            np.minimum.reduceat(least, starts),
            np.maximum.reduceat(most, starts),
        )

    def intervals(self, anchors: np.ndarray, kind) -> tuple[np.ndarray, np.ndarray]:
        """Lowest and highest inner product of each anchor with anything in each box."""
        up, down = np.maximum(anchors, 0).astype(kind), np.minimum(anchors, 0).astype(kind)
        low, high = self.low.astype(kind).T, self.high.astype(kind).T
        return clamped(up @ low + down @ high), clamped(up @ high + down @ low)


def search(tree: Tree, ids: np.ndarray, anchor: np.ndarray, own, label, low, high, windows, k, same):
    """Per window of scores: the best ``k`` (score, id, row), best first, ties to the smaller id.

    ``low`` and ``high`` are the anchor's intervals for all nodes, ``windows`` pairs of
    least and most score, ``same`` whether rows need the anchor's label or another one.
    """
    best: list[list[tuple]] = [[] for _ in windows]

    def need(i):
        return max(windows[i][0], best[i][-1][0]) if len(best[i]) == k else windows[i][0]

    def wanted(node):
        least, most = tree.least[node], tree.most[node]
        if (not least <= label <= most) if same else (least == most == label):
            return False
        # strictly below: a box that reaches the k-th score may hold a smaller id
        return any(
            high[node] >= need(i) and low[node] <= windows[i][1] for i in range(len(windows))
        )

    root = len(tree.spans) - 1
    queue = [(-high[root], root)]
    while queue:
        up, node = heapq.heappop(queue)
        if -up < min(map(need, range(len(windows)))):
            break
        if not wanted(node):
            continue
        start, end = tree.spans[node]
        if node >= tree.leaves:
            for child in range(start, end):
                if wanted(child):
                    heapq.heappush(queue, (-high[child], child))
            continue
        rows = slice(start, end)
        fits = (tree.labels[rows] == label) == same
        fits &= ids[rows] != own
        scores = clamped(tree.points[rows] @ anchor)
        for i, (least, most) in enumerate(windows):
            hits = np.flatnonzero(fits & (scores >= need(i)) & (scores <= most))
            if len(hits):
                found = best[i] + [(scores[h], ids[start + h], start + h) for h in hits]
                found.sort(key=lambda x: (-x[0], x[1]))
                best[i] = found[:k]
    return best


_HIT = pa.schema(
    [
        ("anchor_id", pa.int64()),
        ("anchor_hash", pa.int64()),
        ("place", pa.int32()),
        ("found_id", pa.int64()),
        ("score", pa.int64()),
    ]
)
_HIT_DDL = "anchor_id long, anchor_hash long, place int, found_id long, score long"


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    """Scaled components, rounded down; Python integers where doubles would round."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    scaled = np.floor(SCALE * flat)
    if scaled.size and np.abs(scaled).max() >= 1 << 53:
        # finite components near the end of the range may leave it when scaled
        whole = [SCALE * int(x) if abs(x) > 1 << 53 else math.floor(SCALE * x) for x in flat.tolist()]
        scaled = np.array(whole, dtype=object)
    return scaled.reshape(rows, len(scaled) // rows)


def _tile(k: int, same: bool, share: int):
    """Cogrouped function: best ``k`` of a tile per anchor, or per anchor and positive."""

    def tile(key, anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if anchors.num_rows and rows.num_rows:
            points = _matrix(rows["vector"], rows.num_rows)
            asked = _matrix(anchors["vector"], anchors.num_rows)
            kind = exact_type(points, asked)
            points, asked = points.astype(kind), asked.astype(kind)
            tree = Tree(points, rows["label"].to_numpy())
            ids = rows["vec_id"].to_numpy()[tree.order]
            low, high = tree.intervals(asked, kind)
            own, hashes = anchors["vec_id"].to_numpy(), anchors["hash"].to_numpy()
            labels = anchors["label"].to_numpy()
            positives = None if same else anchors["positives"].to_pylist()
            for a in range(len(own)):
                if same:
                    windows = [(-math.inf, math.inf)]
                else:
                    # share * positive <= 100 * score, as integers
                    windows = [(-(-share * p // 100), p) for p in positives[a]]
                found = search(
                    tree, ids, asked[a], own[a], labels[a], low[a], high[a], windows, k, same
                )
                out += [
                    (int(own[a]), int(hashes[a]), place, int(i), int(s))
                    for place, hits in enumerate(found)
                    for s, i, _ in hits
                ]
        columns = list(zip(*out)) if out else [()] * len(_HIT)
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, _HIT)], schema=_HIT)

    return tile


def usable(vector: Column) -> Column:
    return F.coalesce(
        F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))),
        F.lit(False),
    )


def tiled(rows: DataFrame, tile_rows: int = TILE_ROWS) -> DataFrame:
    """``rows`` with ``slab`` and ``tile``: the upper levels of the packing, per vector length.

    The cuts are square roots of the number of tiles, so their table is small at any size.
    """
    parts = parts_for(rows.count(), tile_rows)
    slabs = max(1, math.ceil(math.sqrt(parts)))
    tiles = max(1, math.ceil(parts / slabs))
    if parts == 1:
        return rows.withColumns({"slab": F.lit(0), "tile": F.lit(0)})
    fraction = F.pmod(F.col("hash"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    widths = (
        rows.select("dims", F.posexplode("vector").alias("d", "x"))
        .groupBy("dims", "d")
        .agg(F.coalesce(F.stddev_pop(F.col("x").cast("double")), F.lit(0.0)).alias("spread"))
        .groupBy("dims")
        .agg(F.max_by("d", F.struct("spread", -F.col("d"))).alias("d"))
    )
    placed = rows.join(materialise(widths, "tree-widths"), "dims", "left").withColumns(
        {
            "by_label": F.col("label") + fraction,
            "by_width": F.floor(SCALE * F.coalesce(F.get("vector", "d"), F.lit(0.0)).cast("double"))
            + fraction,
        }
    )

    def cut(df: DataFrame, by: str, keys: list[str], n: int, name: str) -> DataFrame:
        shares = F.array(*[F.lit(i / n) for i in range(1, n)]).cast("array<double>")
        accuracy = F.lit(max(10_000, 20 * n))
        cuts = df.groupBy(*keys).agg(F.percentile_approx(by, shares, accuracy).alias("cuts"))
        found = df.join(materialise(cuts, "tree-cuts"), keys, "left")
        return found.withColumn(
            name, F.size(F.filter("cuts", lambda x: x <= F.col(by))) if n > 1 else F.lit(0)
        ).drop("cuts")

    slabbed = cut(placed, "by_label", ["dims"], slabs, "slab")
    return cut(slabbed, "by_width", ["dims", "slab"], tiles, "tile").drop("by_label", "by_width", "d")


def hard_negatives(
    anchors: DataFrame,
    rows: DataFrame,
    positives: int = 5,
    negatives: int = 5,
    share: int = SHARE,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """Per anchor and positive, negatives scoring ``share`` to 100 percent of the positive.

    ``anchors`` are rows of the same columns; they meet every row of ``rows``.
    """

    def points(df: DataFrame) -> DataFrame:
        picked = pick(df, vec_id=vec_id, vector=vector, label=label).select(
            F.col("vec_id").cast("long"), "vector", F.col("label").cast("long")
        )
        return (
            picked.filter(
                F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vector"))
            )
            .withColumns({"dims": F.size("vector"), "hash": F.xxhash64("vec_id", "label", "vector")})
            .dropDuplicates(["vec_id", "hash"])
        )

    stored = materialise(tiled(materialise(points(rows), "points"), tile_rows), "tree-points")
    asked = materialise(points(anchors), "anchors")
    blocks = parts_for(asked.count(), ANCHOR_ROWS)
    # the tiles there are: a row for each of some thousand stored rows
    places = materialise(stored.select("dims", "slab", "tile").distinct(), "tiles")
    key = ["block", "dims", "slab", "tile"]
    block = F.pmod("hash", F.lit(blocks))
    all_blocks = F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))
    dealt = stored.withColumn("block", F.explode(all_blocks))

    def meet(df: DataFrame, k: int, same: bool) -> DataFrame:
        left = df.withColumn("block", block).join(places, "dims").groupBy(*key)
        found = left.cogroup(dealt.groupBy(*key)).applyInArrow(_tile(k, same, share), _HIT_DDL)
        best = Window.partitionBy("anchor_id", "anchor_hash", "place").orderBy(
            F.col("score").desc(), "found_id"
        )
        return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)

    chosen = materialise(
        meet(asked, positives, True).select(
            "anchor_id",
            "anchor_hash",
            F.col("rank").alias("at"),
            F.col("found_id").alias("positive_id"),
            F.col("score").alias("positive_score"),
        ),
        "positives",
    )
    wanted = (
        chosen.groupBy("anchor_id", "anchor_hash")
        .agg(F.sort_array(F.collect_list(F.struct("at", "positive_score"))).alias("p"))
        .select(
            F.col("anchor_id").alias("vec_id"),
            F.col("anchor_hash").alias("hash"),
            F.col("p.positive_score").alias("positives"),
        )
    )
    found = meet(asked.join(wanted, ["vec_id", "hash"]), negatives, False)
    return chosen.join(
        found.withColumn("at", F.col("place") + 1), ["anchor_id", "anchor_hash", "at"]
    ).select(
        "anchor_id",
        "positive_id",
        "rank",
        F.col("found_id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )


SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
),
s AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS other_id, a.label = r.label AS same,
    list_sum(list_transform(list_zip(a.e, r.e), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v a JOIN v r ON a.vec_id <> r.vec_id AND len(a.e) = len(r.e)
  WHERE a.vec_id % 100 = 0
),
p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT anchor_id, positive_id,
  (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id))::INTEGER AS rank,
  other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""


@query("op13_str_rtree_negatives", SQL)
def op13_str_rtree_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    # every seventh row carries a shifted label, by contract
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = vectors.select("vec_id", "embedding", label.alias("label"))
    return hard_negatives(rows.filter("vec_id % 100 = 0"), rows)
