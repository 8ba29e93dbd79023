"""Near-duplicate detection with BagMinHash signatures, banding and exact verification.

Texts with the same words are one node.  Every node gets a BagMinHash signature of
its multiset of word shingles; bands of it are hash keys, and nodes that share a key
may be similar.  Links are verified on the shingle multisets themselves:

1. Every node of a key meets the key's hub (one of few chosen per node group), so a
   key of n nodes gives n - 1 pairs, not n^2.  Verified links give classes by
   contracting the graph of links.
2. Keys whose nodes are then all in one class are finished; a group of copies ends
   here.  In the other keys, nodes of the hub's class meet the nodes of other
   classes, and those each other, in tiles of bounded size.  Sketches (low bytes of
   the signature) sort out tiles' nodes that resemble nothing there, the rest is
   compared exactly, and a tile gives at most one link per node and foreign class.

No link between different texts that share a key is lost; the chance that two texts
at the threshold share none is below 0.1 %, and falls fast above it.

Defined results: texts that are null or have no word are classes of their own; ids
may be null or repeat (rows with equal words are always in one class; a class's id is
its smallest document id, null only if it has no other); exactly one row of each class
is kept, so a row is told by its id, its text and a number among equal rows, never by
its id alone; an empty table gives no rows; other columns are ignored; texts of any
length are used whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from marketframe.functions.storage import materialise
from marketframe.llm.common import WORD, column, pick, table
from marketframe.llm.registry import query
from marketframe.llm.shingles import (
    bag_signatures,
    band_hashes,
    digest,
    multiset,
    normal,
    overlaps,
)
from marketframe.llm.tokens import rows_of

#: Weighted Jaccard similarity from which texts are near duplicates.
SIMILARITY = 0.8
#: 24 bands of 6 components: similarity 0.8 is missed with chance 0.0007, 0.85 with 0.00001.
BANDS, ROWS = 24, 6
#: Sketch similarity below which a pair is not looked at: 5 standard errors under the threshold.
LIKELY = SIMILARITY - 5 * (SIMILARITY * (1 - SIMILARITY) / (BANDS * ROWS)) ** 0.5
#: Different hubs that the keys of one node group choose.
HUBS = 2
#: Nodes on either side of a tile, and documents signed at once.
TILE = 256
SIGNED = 128
#: Bytes of text per tile side compared at once.
TILE_BYTES = 16 << 20

_SIGNED = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("same", pa.binary()),
        ("node", pa.binary()),
        ("keys", pa.list_(pa.int64())),
        ("sketch", pa.binary()),
    ]
)
_SIGNED_DDL = "doc_id long, same binary, node binary, keys array<long>, sketch binary"
_PAIR_DDL = "a binary, b binary"
_PAIR = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def signed() -> pa.RecordBatch:
        words = [t for _, _, t in held if t]
        keys, sketches = iter(()), iter(())
        if words:
            signatures = bag_signatures(words, BANDS * ROWS)
            keys = iter(band_hashes(signatures, BANDS, ROWS).tolist())
            sketches = iter([s.tobytes() for s in (signatures & 0xFF).astype(np.uint8)])
        out = [
            (i, same, digest(t), next(keys) if t else None, next(sketches) if t else None)
            for i, same, t in held
        ]
        held.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*out), _SIGNED)], schema=_SIGNED
        )

    size = 0
    for doc_id, same, text in rows_of(batches, "doc_id", "same", "text"):
        held.append((doc_id, same, normal(text)))
        size += len(held[-1][2])
        if len(held) == SIGNED or size > 4 << 20:
            yield signed()
            size = 0
    if held:
        yield signed()


def same_row(doc_id: Column, text: Column) -> Column:
    """Digest of a row's id and text, equal for equal rows; null without a text."""
    named = F.coalesce(doc_id.cast("long").cast("string"), F.lit(""))
    return F.unhex(F.md5(F.concat(named, F.lit(" "), text)))


def signatures(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id, same, node, keys, sketch`` per document; the last three null without words."""
    rows = pick(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = rows.withColumn("same", same_row(F.col("doc_id"), F.col("text")))
    return rows.mapInArrow(_sign, _SIGNED_DDL)


def keyed_nodes(signed: DataFrame) -> DataFrame:
    """``key, hub, node`` of all keys with several nodes."""
    rows = signed.filter("node is not null").select(
        "node", F.posexplode("keys").alias("band", "key")
    )
    # nodes of one group agree on most keys; choosing by band gives the group a few hubs
    turn = F.xxhash64(F.col("node"), F.col("band") % HUBS)
    shared = (
        rows.groupBy("key")
        .agg(
            F.min(F.struct(turn.alias("turn"), "node")).alias("least"),
            F.max(F.struct(turn.alias("turn"), "node")).alias("most"),
        )
        .filter("least.node != most.node")
        .select("key", F.col("least.node").alias("hub"))
    )
    return rows.select("key", "node").join(shared, "key").distinct()


def _resemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        one, two = (
            np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(
                batch.num_rows, BANDS * ROWS
            )
            for c in ("sketch", "other")
        )
        stay = pa.array((one == two).mean(axis=1) >= LIKELY)
        yield batch.select(["a", "b"]).filter(stay)


def likely(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs ``a, b`` whose sketches do not rule out a link."""
    one = sketches.withColumnRenamed("node", "a")
    two = sketches.select(F.col("node").alias("b"), F.col("sketch").alias("other"))
    return pairs.join(one, "a").join(two, "b").mapInArrow(_resemble, _PAIR_DDL)


class Texts:
    """Shingle multisets of a tile side, joined for comparison with one set."""

    def __init__(self, nodes: list[bytes], texts: list[bytes]):
        self.nodes = nodes
        self.sets = [multiset(t) for t in texts]
        self.sizes = np.array([len(s) for s in self.sets])
        self.joined = np.concatenate(self.sets) if self.sets else np.empty(0, np.uint64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.int64)

    def similar_to(self, one: np.ndarray) -> np.ndarray:
        """Which texts are near duplicates of the multiset ``one``; all sets are non-empty."""
        common = overlaps(one, self.joined, self.starts)
        return common >= SIMILARITY * (self.sizes + len(one) - common)


def _parts(nodes: list, texts: list):
    """Consecutive parts of bounded text size."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > TILE_BYTES:
            yield nodes[at:i], texts[at:i]
            at, size = i, 0
        size += len(t)
    if at < len(nodes):
        yield nodes[at:], texts[at:]


def _star(key, hubs: pa.Table, members: pa.Table) -> pa.Table:
    if not hubs.num_rows or not members.num_rows:
        return _PAIR.empty_table()
    hub, text = hubs["hub"][0].as_py(), hubs["text"][0].as_py()
    one, found = multiset(text), []
    for nodes, texts in _parts(members["node"].to_pylist(), members["text"].to_pylist()):
        part = Texts(nodes, texts)
        found += [part.nodes[i] for i in np.flatnonzero(part.similar_to(one))]
    return pa.table({"a": pa.array(found, pa.binary()), "b": pa.array([hub] * len(found), pa.binary())})


def verified_stars(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``a`` (member), ``b`` (hub) whose multisets are similar.

    A hub with many members meets them in blocks, so no task gets them all.
    """
    sized = pairs.select(
        F.col("b").alias("hub"), F.col("a").alias("node")
    )
    blocks = sized.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("blocks"))
    members = (
        sized.join(blocks, "hub")
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .select("hub", "block", "node")
        .join(texts, "node")
    )
    hubs = blocks.join(texts.withColumnRenamed("node", "hub"), "hub").select(
        "hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "text"
    )
    return cogrouped(hubs, members, ["hub", "block"], _star, _PAIR_DDL)


def classes(links: DataFrame) -> DataFrame:
    """``node, label`` of all linked nodes: one label, itself a node, per component.

    Each round maps every node to the smallest of itself and its neighbours and
    carries the links over to the images, which keeps components and leaves far
    fewer nodes; rounds end when no link is left.  The maps are then applied one
    after the other.  Only written tables carry over.
    """
    # both directions come from one evaluation, so they always belong to the same links
    there = F.struct(F.col("a").alias("node"), F.col("b").alias("near"))
    back = F.struct(F.col("b").alias("node"), F.col("a").alias("near"))
    edges = materialise(links.select(F.inline(F.array(there, back))).distinct(), "links")
    labels = None
    while True:
        image = materialise(
            edges.groupBy("node").agg(F.least(F.col("node"), F.min("near")).alias("label")), "images"
        )
        if labels is None:
            labels = image
        else:
            onward = image.toDF("label", "next")
            labels = labels.join(onward, "label", "left").select(
                "node", F.coalesce("next", "label").alias("label")
            )
        moved = edges.join(image, "node").select("near", F.col("label").alias("a"))
        moved = moved.join(image.toDF("near", "b"), "near").filter("a != b")
        edges = materialise(
            moved.select(F.col("a").alias("node"), F.col("b").alias("near")).distinct(), "links"
        )
        if edges.isEmpty():
            return materialise(labels, "labels")


def unfinished(keyed: DataFrame, labels: DataFrame) -> DataFrame:
    """``key, node, label, inside`` of keys whose nodes are in several classes.

    ``inside``: the node is in the class of the key's hub.
    """
    rows = keyed.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    hubs = rows.filter("node = hub").select("key", F.col("label").alias("hub_label"))
    mixed = (
        rows.groupBy("key")
        .agg(F.min("label").alias("least"), F.max("label").alias("most"))
        .filter("least != most")
        .select("key")
    )
    return (
        rows.join(mixed.join(hubs, "key"), "key")
        .select("key", "node", "label", (F.col("label") == F.col("hub_label")).alias("inside"))
    )


def tiles(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Left and right sides of the tiles in which nodes of different classes meet.

    Nodes outside the hub's class are dealt to blocks, and so are those inside; an
    outside block meets every inside block and the outside blocks not before it.
    """
    parts = rows.groupBy("key").agg(
        F.ceil(F.sum(F.when(F.col("inside"), 1).otherwise(0)) / TILE).cast("int").alias("ins"),
        F.ceil(F.sum(F.when(F.col("inside"), 0).otherwise(1)) / TILE).cast("int").alias("outs"),
    )
    dealt = rows.join(parts, "key").withColumn(
        "block",
        F.pmod(
            F.xxhash64("node"), F.greatest(F.when(F.col("inside"), F.col("ins")).otherwise(F.col("outs")), F.lit(1))
        ).cast("int"),
    )
    # block numbers of the inside are counted from -1 downwards
    block = F.when(F.col("inside"), -1 - F.col("block")).otherwise(F.col("block"))
    dealt = dealt.withColumn("block", block)
    columns = [c for c in rows.columns if c not in ("key", "inside")]
    left = dealt.filter(~F.col("inside")).select(
        "key",
        F.col("block").alias("one"),
        F.explode(F.sequence(-F.col("ins"), F.col("block"))).alias("two"),
        *columns,
    )
    right = dealt.select(
        "key",
        F.explode(
            F.when(
                F.col("inside"), F.sequence(F.lit(0), F.col("outs") - 1)
            ).otherwise(F.sequence(F.col("block"), F.col("outs") - 1))
        ).alias("one"),
        F.col("block").alias("two"),
        *columns,
    )
    return left, right


def _sketch_tile(key, left: pa.Table, right: pa.Table) -> pa.Table:
    """Nodes of the tile that resemble a node of another class."""
    empty = pa.table({"key": pa.array([], pa.int64()), "node": pa.array([], pa.binary())})
    if not left.num_rows or not right.num_rows:
        return empty
    sides = []
    for side in (left, right):
        sketch = np.frombuffer(b"".join(side["sketch"].to_pylist()), np.uint8)
        sides.append((side["node"].to_pylist(), side["label"].to_pylist(), sketch.reshape(side.num_rows, -1)))
    (nodes, labels, one), (others, other_labels, two) = sides
    known = {label: i for i, label in enumerate({*labels, *other_labels})}
    other_numbers = np.array([known[x] for x in other_labels])
    found = set()
    for i, node in enumerate(nodes):
        close = ((two == one[i]).mean(axis=1) >= LIKELY) & (other_numbers != known[labels[i]])
        if close.any():
            found.add(node)
            found.update(others[j] for j in np.flatnonzero(close))
    out = sorted(found)
    return pa.table(
        {"key": pa.array([key[0].as_py()] * len(out), pa.int64()), "node": pa.array(out, pa.binary())}
    )


def _link_tile(key, left: pa.Table, right: pa.Table) -> pa.Table:
    """One link for each node of the left side and class of the right that it belongs to."""
    found_a, found_b = [], []
    if left.num_rows and right.num_rows:
        labels = dict(zip(right["node"].to_pylist(), right["label"].to_pylist()))
        own = list(zip(left["node"].to_pylist(), left["label"].to_pylist(), left["text"].to_pylist()))
        # links found here join classes here, so their further links are not needed
        merged: dict = {}

        def root(x):
            while x in merged:
                x = merged[x]
            return x

        for nodes, texts in _parts(right["node"].to_pylist(), right["text"].to_pylist()):
            part = Texts(nodes, texts)
            for node, label, text in own:
                if all(root(labels[n]) == root(label) for n in nodes):
                    continue
                for j in np.flatnonzero(part.similar_to(multiset(text))):
                    a, b = root(label), root(labels[nodes[j]])
                    if a != b:
                        merged[a] = b
                        found_a.append(node)
                        found_b.append(nodes[j])
    return pa.table({"a": pa.array(found_a, pa.binary()), "b": pa.array(found_b, pa.binary())})


def _meet(rows: DataFrame, task, ddl: str) -> DataFrame:
    return cogrouped(*tiles(rows), ["key", "one", "two"], task, ddl)


def cogrouped(left: DataFrame, right: DataFrame, key: list[str], task, ddl: str) -> DataFrame:
    """``task(key, left rows, right rows)`` per key; the sides may share ancestors."""

    def named(values, one: pa.Table, two: pa.Table) -> pa.Table:
        return task(values, one, two.rename_columns([c.removeprefix("r_") for c in two.column_names]))

    other = right.toDF(*[f"r_{c}" for c in right.columns])
    return left.groupBy(*key).cogroup(other.groupBy(*[f"r_{c}" for c in key])).applyInArrow(named, ddl)


def _normal_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            rows = [(n, normal(t)) for n, t in zip(part["node"].to_pylist(), part["text"].to_pylist())]
            # an id may belong to several texts
            rows = [(n, t) for n, t in rows if digest(t) == n]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], pa.binary()) for i in (0, 1)], ["node", "text"]
            )


def texts_of(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``node, text`` (normalised) of the nodes in ``wanted`` (``node, same``).

    ``same`` names one row of the node, so many texts of one id, or of none, do not meet.
    """
    rows = pick(docs, first_id=doc_id, text=text)
    rows = rows.select(same_row(F.col("first_id"), F.col("text")).alias("same"), "text")
    found = wanted.join(rows, "same").select("node", "text")
    return found.mapInArrow(_normal_texts, "node binary, text binary").dropDuplicates(["node"])


def classified(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id, class_id, class_size, kept, same`` per document; ``same`` as in ``same_row``."""
    # numbers are given once, in the written table: they tell equal rows apart
    numbered = signatures(docs, doc_id, text).withColumn("row", F.monotonically_increasing_id())
    signed = materialise(numbered, "signatures")
    # ids before nulls, then text, then one of the equal rows
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "same", "row")
    nodes = signed.filter("node is not null").groupBy("node").agg(
        F.count(F.lit(1)).alias("copies"), F.min(order).alias("least")
    )
    nodes = materialise(nodes, "nodes")
    # copies fold map-side before the join, so a group of them is one row per task
    sketches = (
        signed.filter("node is not null").groupBy("node").agg(F.max("sketch").alias("sketch"))
    )
    keyed = materialise(keyed_nodes(signed), "keyed-nodes")
    held = keyed.select("node").distinct()
    sketches = materialise(sketches.join(held, "node", "left_semi"), "sketches")
    stars = keyed.filter("node != hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    stars = materialise(likely(stars.distinct(), sketches), "likely-stars")

    def read_texts(wanted: DataFrame, tag: str) -> DataFrame:
        rows = nodes.join(wanted, "node").select("node", F.col("least.same").alias("same"))
        return materialise(texts_of(docs, rows, doc_id, text), tag)

    ends = stars.select(F.col("a").alias("node")).union(stars.select("b")).distinct()
    links = materialise(verified_stars(stars, read_texts(ends, "star-texts")), "star-links")
    labels = classes(links)

    open_rows = materialise(unfinished(keyed, labels), "open-keys")
    close = materialise(
        _meet(open_rows.join(sketches, "node"), _sketch_tile, "key long, node binary").distinct(),
        "close-nodes",
    )
    left_over = open_rows.join(close, ["key", "node"])
    more_texts = read_texts(close.select("node").distinct(), "tile-texts")
    more = materialise(
        _meet(left_over.join(more_texts, "node"), _link_tile, _PAIR_DDL), "tile-links"
    )
    if not more.isEmpty():
        labels = classes(links.union(more))

    labelled = nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = labelled.groupBy("label").agg(
        F.min("least").alias("least"), F.sum("copies").alias("class_size")
    )
    of_node = materialise(
        labelled.drop("least").join(named, "label").select(
            "node", F.col("least.doc_id").alias("class_id"), "class_size",
            F.col("least.row").alias("kept_row"),
        ),
        "node-classes",
    )
    found = signed.select("doc_id", "same", "node", "row").filter("node is not null")
    found = found.join(of_node, "node").select(
        "doc_id", "class_id", "class_size", (F.col("row") == F.col("kept_row")).alias("kept"), "same"
    )
    alone = signed.filter("node is null").select(
        "doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"),
        F.lit(True).alias("kept"), "same",
    )
    return found.union(alone)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, class_id, class_size, kept`` per document.

    ``class_id`` is the smallest document id of the class, ``class_size`` counts its
    documents, and ``kept`` marks the one document that stays.
    """
    return classified(docs, doc_id, text).drop("same")


def drop_near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", repeats: bool = True
) -> DataFrame:
    """``docs`` with the kept document of each class; columns unchanged.

    Rows with the id and the text of the kept row stay with it unless ``repeats`` is
    false; then one row of each class stays.  Rows without words all stay.
    """
    stays = classified(docs, doc_id, text).filter("kept").select(F.col("same").alias("__same"))
    words = F.coalesce(column(docs, text).rlike(WORD), F.lit(False))
    same = same_row(column(docs, doc_id), column(docs, text)).alias("__same")
    rows = docs.filter(words).select(same, F.struct(*[column(docs, c) for c in docs.columns]).alias("__doc"))
    if not repeats:
        # equal rows fold map-side; other columns decide between rows that differ there
        others = [F.col("__doc")[c] for c in docs.columns if c not in (doc_id, text)]
        order = F.to_json(F.struct(F.lit(0), *others))
        rows = rows.groupBy("__same").agg(F.min_by("__doc", order).alias("__doc"))
    kept = rows.join(stays, "__same", "left_semi")
    return kept.select("__doc.*").union(docs.filter(~words))


@query("op1_bag_minhash")
def op1_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
