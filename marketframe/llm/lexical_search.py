"""Exact ranked lexical search: inner products of sparse vectors in ball trees.

A document's vector holds, per term, the integer that the term adds to a score; an
item's vector holds 1 for each of its terms.  The score is their inner product.

One pass splits every whole text into terms.  Only terms that some item asks for can add
to a score, so the rest is dropped by a join with the items' vocabulary; one marker row
per document keeps its length for the corpus counts.  Document frequencies, weights and
addends are Spark aggregates and joins over all documents.

Documents are dealt to blocks of bounded size by a hash.  In a cogrouped task a block
builds a ball tree (``BallTree``): halves split between two far documents, with the
centroid of a subtree and the radius around it.  By Cauchy-Schwarz no document below a
node scores more than ``q . c + |q| r``; centroid, radius and bound are rounded up, by more
than doubles can lose.  Items search best-first and prune subtrees strictly below their
k-th score; leaves are scored exactly in integers.  A first round over one block in
``SCOUTS`` gives each item a score that k documents reach, which prunes from the start in
the round over all blocks.  The best of the blocks are merged by a ranked window, which
Spark limits before the shuffle.

Defined results: terms are read from the whole text, null has none; every row of the
documents counts, repeated ones too; items that repeat id and text count once, and
different texts under one id are ranked apart; an item without terms, or whose terms no
document holds, gives no rows; equal scores go to the smaller document id, rows without
an id last; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from marketframe.functions.storage import materialise
from marketframe.llm.common import parts_for, pick, table
from marketframe.llm.registry import query
from marketframe.llm.tokens import rows_of

#: Postings of a block of documents, items that meet it in one task, documents of a leaf.
BLOCK_POSTINGS = 262_144
ITEM_ROWS = 1024
LEAF = 32
#: One block of this many is searched first.
SCOUTS = 32
#: Relative room for rounding: sums of a million terms in doubles lose less.
ROOM = 1e-9

# letters and digits in ASCII, lower-cased, and all bytes of other characters; the rest splits
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)


def terms_of(text: str | None) -> list[bytes]:
    """Terms of a whole text in order, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


_POSTING = pa.schema(
    [
        ("key", pa.int64()),
        ("doc_id", pa.int64()),
        ("n", pa.int64()),
        ("term", pa.binary()),
        ("tf", pa.int64()),
    ]
)
_POSTING_DDL = "key long, doc_id long, n long, term binary, tf long"


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per text and term, and one with the empty term for each text with terms."""
    held: list[list] = [[], [], [], [], []]
    sizes: list[int] = []

    def flush():
        keys, ids, ns, terms, tfs = held
        columns = [
            pa.array(np.repeat(np.array(keys, dtype=np.int64), sizes)),
            pa.array(ids, pa.int64()).take(pa.array(np.repeat(np.arange(len(ids)), sizes))),
            pa.array(np.repeat(np.array(ns, dtype=np.int64), sizes)),
            pa.array(terms, pa.binary()),
            pa.array(tfs, pa.int64()),
        ]
        for part in (*held, sizes):
            part.clear()
        return pa.RecordBatch.from_arrays(columns, schema=_POSTING)

    for key, doc_id, text in rows_of(batches, "key", "doc_id", "text"):
        terms = terms_of(text)
        if not terms:
            continue
        counts = Counter(terms)
        counts[b""] = len(terms)
        held[0].append(key)
        held[1].append(doc_id)
        held[2].append(len(terms))
        held[3] += counts.keys()
        held[4] += counts.values()
        sizes.append(len(counts))
        if len(held[3]) > 100_000:
            yield flush()
    yield flush()


def postings(rows: DataFrame) -> DataFrame:
    """Postings of ``rows`` (``doc_id``, ``text``), numbered by ``key``; write them at once."""
    return rows.withColumn("key", F.monotonically_increasing_id()).mapInArrow(
        _postings, _POSTING_DDL
    )


class Sparse:
    """Rows of a sparse matrix: ``ptr`` bounds each row's columns ``idx`` and values ``val``."""

    def __init__(self, ptr: np.ndarray, idx: np.ndarray, val: np.ndarray):
        self.ptr, self.idx, self.val = ptr, idx, val

    def take(self, rows: np.ndarray) -> "Sparse":
        size = self.ptr[rows + 1] - self.ptr[rows]
        ptr = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(self.ptr[rows] - ptr[:-1], size) + np.arange(ptr[-1])
        return Sparse(ptr, self.idx[at], self.val[at])

    def dot(self, dense: np.ndarray) -> np.ndarray:
        """Inner product of each row, none of them empty, with a dense vector."""
        return np.add.reduceat(dense[self.idx] * self.val, self.ptr[:-1])


class BallTree:
    """Balanced ball tree over sparse rows with non-negative integer values."""

    def __init__(self, rows: Sparse, width: int, leaf: int = LEAF):
        self.width, self.leaf = width, leaf
        #: Per node: first and last row in tree order, and the two children or None.
        self.spans: list[tuple[int, int]] = []
        self.children: list[tuple[int, int] | None] = []
        self.radius: list[float] = []
        centres: list[tuple[np.ndarray, np.ndarray]] = []
        self._runs: list[np.ndarray] = []
        square = np.add.reduceat(rows.val.astype(np.float64) ** 2, rows.ptr[:-1])
        self._grow(rows, np.arange(len(square)), square, 0, centres)
        self.order = np.concatenate(self._runs)
        self.rows = rows.take(self.order)
        self.centres = Sparse(
            np.cumsum([0, *[len(i) for i, _ in centres]]),
            np.concatenate([i for i, _ in centres]),
            np.concatenate([v for _, v in centres]),
        )
        self.radii = np.array(self.radius)

    def _grow(self, all_rows: Sparse, rows: np.ndarray, square: np.ndarray, start: int, centres) -> int:
        part = all_rows.take(rows)
        values = part.val.astype(np.float64)
        centre = np.bincount(part.idx, weights=values, minlength=self.width) / len(rows)
        node = len(self.spans)
        self.spans.append((start, start + len(rows)))
        self.children.append(None)
        at = np.flatnonzero(centre)
        centres.append((at, centre[at]))
        own, middle = square[rows], centre @ centre
        away = own - 2.0 * part.dot(centre) + middle
        # squares cancel: what the sums can lose counts as distance
        self.radius.append(float(np.sqrt((np.maximum(away, 0.0) + ROOM * (own + middle)).max())))
        if len(rows) <= self.leaf:
            self._runs.append(rows)
            return node
        first = self._dense(part, int(np.argmax(away)))
        far = own - 2.0 * part.dot(first)
        second = self._dense(part, int(np.argmax(far)))
        # nearer to the first, nearer to the second, cut in the middle; ties by row order
        side = np.argsort(part.dot(second - first), kind="stable")
        half = len(rows) // 2
        left = self._grow(all_rows, rows[np.sort(side[:half])], square, start, centres)
        right = self._grow(all_rows, rows[np.sort(side[half:])], square, start + half, centres)
        self.children[node] = (left, right)
        return node

    def _dense(self, part: Sparse, row: int) -> np.ndarray:
        out = np.zeros(self.width)
        at = slice(part.ptr[row], part.ptr[row + 1])
        out[part.idx[at]] = part.val[at]
        return out

    def bounds(self, terms: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """No row below a node has a larger inner product with the item."""
        reach = self.centres.dot(asked.astype(np.float64)) + np.sqrt(len(terms)) * self.radii
        return reach * (1.0 + ROOM) + 1.0

    def search(self, terms: np.ndarray, ids: np.ndarray, unnamed: np.ndarray, k: int, floor: int):
        """The best ``k`` of the rows that score ``floor`` or more: (-score, unnamed, id)."""
        asked = np.zeros(self.width, dtype=np.int64)
        asked[terms] = 1
        up = self.bounds(terms, asked)
        best: list[tuple] = []
        need = max(floor, 1)
        queue = [(-up[0], 0)]
        while queue and -queue[0][0] >= need:
            _, node = heapq.heappop(queue)
            if self.children[node]:
                for child in self.children[node]:
                    if up[child] >= need:
                        heapq.heappush(queue, (-up[child], child))
                continue
            start, end = self.spans[node]
            at = slice(self.rows.ptr[start], self.rows.ptr[end])
            scores = np.add.reduceat(
                asked[self.rows.idx[at]] * self.rows.val[at],
                self.rows.ptr[start:end] - self.rows.ptr[start],
            )
            hits = np.flatnonzero(scores >= need)
            if len(hits):
                best += [(-int(scores[h]), bool(unnamed[start + h]), int(ids[start + h])) for h in hits]
                best.sort()
                del best[k:]
                if len(best) == k:
                    need = max(need, -best[-1][0])
        return best


_HIT = pa.schema(
    [
        ("item_id", pa.int64()),
        ("item_hash", pa.int64()),
        ("doc_id", pa.int64()),
        ("score", pa.int64()),
    ]
)
_HIT_DDL = "item_id long, item_hash long, doc_id long, score long"


def _block(k: int):
    """Cogrouped function: the best ``k`` documents of a block for each item."""

    def block(key, docs: pa.Table, items: pa.Table) -> pa.Table:
        if not docs.num_rows or not items.num_rows:
            return _HIT.empty_table()
        keys, terms = docs["key"].to_numpy(), docs["term_no"].to_numpy()
        order = np.lexsort((terms, keys))
        keys = keys[order]
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        known, idx = np.unique(terms[order], return_inverse=True)
        rows = Sparse(np.r_[starts, len(keys)], idx, docs["addend"].to_numpy()[order])
        tree = BallTree(rows, len(known))
        doc_ids = docs["doc_id"].combine_chunks().take(pa.array(order[starts][tree.order]))
        unnamed = doc_ids.is_null().to_numpy(zero_copy_only=False)
        ids = doc_ids.fill_null(0).to_numpy()
        out: list[tuple] = []
        rows_of_item = zip(*[items[c].to_pylist() for c in ("item_id", "item_hash", "terms", "floor")])
        for item_id, item_hash, wanted, floor in rows_of_item:
            wanted = np.array(wanted, dtype=np.int64)
            at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
            here = at[known[at] == wanted]
            if len(here):
                out += [
                    (item_id, item_hash, None if no_id else doc_id, -negative)
                    for negative, no_id, doc_id in tree.search(here, ids, unnamed, k, floor)
                ]
        columns = list(zip(*out)) if out else [()] * len(_HIT)
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, _HIT)], schema=_HIT)

    return block


def ranked_documents(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """``item_id, rank, doc_id, score`` of each item's ``k`` highest-scoring documents."""
    asked = (
        pick(items, item_id=item_id, text=item_text)
        .select(F.col("item_id").cast("long").alias("item_id"), "text")
        .withColumn("item_hash", F.xxhash64("item_id", "text"))
        .dropDuplicates(["item_id", "text"])
    )
    # the item's hash travels as the row's id
    item_terms = materialise(
        asked.join(
            postings(asked.select(F.col("item_hash").alias("doc_id"), "text"))
            .filter(F.length("term") > 0)
            .select(F.col("doc_id").alias("item_hash"), "term")
            .distinct(),
            "item_hash",
        ).select("item_id", "item_hash", "term"),
        "item-terms",
    )
    vocabulary = materialise(
        item_terms.select("term")
        .distinct()
        .withColumn("term_no", F.monotonically_increasing_id())
        .unionByName(item_terms.sparkSession.range(1).select(F.lit(b"").alias("term"), F.lit(-1).cast("long").alias("term_no"))),
        "vocabulary",
    )
    rows = pick(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long"), "text")
    held = materialise(
        postings(rows).join(vocabulary, "term").select("key", "doc_id", "n", "term_no", "tf"),
        "postings",
    )
    named = held.filter("term_no >= 0")
    totals = held.agg(
        F.count_if(F.col("term_no") < 0).alias("docs"),
        F.coalesce(F.sum(F.when(F.col("term_no") < 0, F.col("tf"))), F.lit(0)).alias("terms"),
        F.count_if(F.col("term_no") >= 0).alias("postings"),
    ).first()
    docs_in_all, terms_in_all = F.lit(totals["docs"]), F.lit(max(1, totals["terms"]))
    weights = materialise(
        named.groupBy("term_no")
        .agg(F.count("*").alias("df"))
        .select(
            "term_no",
            F.floor(1000 * F.log((2 * docs_in_all + 2) / (2 * F.col("df") + 1))).alias("weight"),
        ),
        "term-weights",
    )
    blocks = parts_for(totals["postings"], BLOCK_POSTINGS)
    item_blocks = parts_for(asked.count(), ITEM_ROWS)
    scored = named.join(weights, "term_no").withColumns(
        {"all_docs": docs_in_all, "all_terms": terms_in_all}
    )
    addend = F.expr(
        "weight * ((1000000000L * tf) div (1000 * tf + 8 * (10 + (90 * n * all_docs) div all_terms)))"
    )
    addends = materialise(
        scored.select(
            "key",
            "doc_id",
            "term_no",
            addend.alias("addend"),
            F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block"),
        ).filter("addend > 0"),
        "addends",
    )
    vectors = (
        item_terms.join(vocabulary, "term")
        .groupBy("item_id", "item_hash")
        .agg(F.sort_array(F.collect_list("term_no")).alias("terms"))
        .withColumn("item_block", F.pmod("item_hash", F.lit(item_blocks)))
    )
    best = Window.partitionBy("item_id", "item_hash").orderBy(
        F.col("score").desc(), F.col("doc_id").asc_nulls_last()
    )
    key = ["block", "item_block"]

    def every(n: int, step: int = 1):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"), F.lit(step).cast("long")))

    def found(step: int, wanted: DataFrame) -> DataFrame:
        left = addends if step == 1 else addends.filter(F.col("block") % step == 0)
        pairs = left.withColumn("item_block", every(item_blocks)).groupBy(*key)
        hits = pairs.cogroup(wanted.withColumn("block", every(blocks, step)).groupBy(*key))
        ranked = hits.applyInArrow(_block(k), _HIT_DDL).withColumn("rank", F.row_number().over(best))
        return ranked.filter(F.col("rank") <= k)

    floors = F.lit(0).cast("long").alias("floor")
    start = vectors.select("*", floors)
    if blocks > SCOUTS:
        reached = materialise(
            found(SCOUTS, start).filter(F.col("rank") == k).select("item_hash", F.col("score").alias("floor")),
            "floors",
        )
        start = vectors.join(reached, "item_hash", "left").fillna(0, ["floor"])
    return found(1, start).select("item_id", "rank", "doc_id", "score")


#: The term pattern and the upper-case letters that are folded; fixed values.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

SQL = rf"""
WITH fold AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS up, 'abcdefghijklmnopqrstuvwxyz' AS low),
d AS (
  SELECT row_number() OVER () AS k, doc_id,
    regexp_extract_all(translate(text, up, low), '{TERM}') AS terms
  FROM documents, fold
),
c AS (SELECT count(*) AS docs, sum(len(terms)) AS words FROM d WHERE len(terms) > 0),
p AS (
  SELECT k, doc_id, n, term, count(*) AS tf
  FROM (SELECT k, doc_id, len(terms) AS n, unnest(terms) AS term FROM d) GROUP BY ALL
),
w AS (
  SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w
  FROM p, c GROUP BY term, docs
),
i AS (
  SELECT DISTINCT item_id, item, term FROM (
    SELECT item_id, text AS item, unnest(regexp_extract_all(translate(text, up, low), '{TERM}')) AS term
    FROM (SELECT DISTINCT item_id, text FROM benchmark), fold)
),
s AS (
  SELECT item_id, item, k, doc_id,
    sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // words))))::BIGINT AS score
  FROM i JOIN p USING (term) JOIN w USING (term), c GROUP BY ALL
)
SELECT item_id, rank, doc_id, score FROM (
  SELECT *, (row_number() OVER (PARTITION BY item_id, item ORDER BY score DESC, doc_id NULLS LAST))::INTEGER AS rank
  FROM s WHERE score > 0)
WHERE rank <= 10
"""


@query("op11_ball_tree_search", SQL)
def op11_ball_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
