"""Exact deduplication against a persistent digest index.

The index is a table of one row per batch and distinct text, bucketed and sorted by its
SHA-256 digest.  A batch of documents is reduced to distinct digests (partial
aggregation, so a group of copies of any size is one row per map task), joined
to the index by sort-merge joins that read the buckets in place (an anti-join leaves
out what the batch has added before), and the rest is appended.  Labelling all rows with the outcome is an ordinary
equi-join of two shuffled sides, which adaptive execution splits where a group
of copies is large.

Defined results: null text counts as empty text, so all of them are copies of
each other; the largest id of a group stays and null ids lose against any other;
rows that repeat the staying id and its text all count as that row; an empty
batch gives no rows and leaves the index as it is; other columns of the input
are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from marketframe.functions.storage import materialise, new_folder
from marketframe.llm.common import parts_for, pick, table, text_or_empty
from marketframe.llm.registry import query

#: Distinct texts per bucket: about 100 MB of index rows.
ROWS_PER_BUCKET = 2_000_000


class DigestIndex:
    """Table ``digest, keep_id, group_size, batch, first`` under ``path``, bucketed by digest.

    Each batch adds a row per text it holds: how many of its documents have it, the one
    that would stay, and whether no other batch held the text before.
    The files outlive the session: opening the same path with the same number of
    buckets in another session continues the index.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int, id_type: str = "bigint"):
        self.spark, self.buckets = spark, buckets
        self.name = "digest_index_" + uuid.uuid5(uuid.NAMESPACE_URL, path).hex
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} "
            f"(digest BINARY, keep_id {id_type}, group_size BIGINT, batch STRING, first BOOLEAN) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def read(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def append(self, rows: DataFrame) -> None:
        """Each task writes one bucket; the job's commit makes all files visible together."""
        (
            rows.select("digest", "keep_id", "group_size", "batch", "first")
            .repartition(self.buckets, "digest")
            .write.insertInto(self.name)
        )

    def close(self) -> None:
        """Forget the session's table entry; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def deduplicate(
        self, docs: DataFrame, batch: str | None = None, doc_id: str = "doc_id", text: str = "text"
    ) -> DataFrame:
        """One row per document: ``doc_id, digest, keep_id, group_size, kept``.

        ``keep_id`` is the document that stays for this text: the largest id of the first
        batch that held it.  If that was another batch, no row of this one stays.
        ``group_size`` counts the documents with this text in all batches of the index.

        ``batch`` names the batch.  Handing in a batch again under its name, as after a
        run whose result was lost, adds nothing twice and decides as before.
        """
        batch = batch or uuid.uuid4().hex
        own = F.col("batch") == batch
        keys = materialise(
            pick(docs, doc_id=doc_id, text=text).select(
                "doc_id", F.unhex(F.sha2(text_or_empty(), 256)).alias("digest")
            ),
            "digests",
        )
        groups = materialise(
            keys.groupBy("digest").agg(
                F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
            ),
            "digest-groups",
        )
        known = self.read().hint("merge")
        # what this batch has added before is left out; what others added is not new
        fresh = groups.join(known.filter(own), "digest", "left_anti")
        others = known.filter(~own).select("digest", F.lit(False).alias("first")).distinct()
        self.append(
            fresh.join(others.hint("merge"), "digest", "left").select(
                "digest",
                "keep_id",
                "group_size",
                F.lit(batch).alias("batch"),
                F.coalesce("first", F.lit(True)).alias("first"),
            )
        )
        index = self.read().hint("merge")
        # with batches added at the same time several may be first; the smallest name counts
        winner = F.min(F.when(F.col("first"), F.struct("batch", "keep_id")))
        decided = materialise(
            groups.select("digest")
            .join(index, "digest")
            .groupBy("digest")
            .agg(winner.alias("winner"), F.sum("group_size").alias("group_size"))
            .select(
                "digest",
                F.col("winner.keep_id").alias("keep_id"),
                (F.col("winner.batch") == batch).alias("fresh"),
                "group_size",
            ),
            "digest-decisions",
        )
        return keys.join(decided, "digest").select(
            "doc_id",
            "digest",
            "keep_id",
            "group_size",
            (F.col("fresh") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        )


SQL = """
SELECT doc_id,
       max(doc_id) OVER g AS keep_id,
       count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept,
       h AS text_sha256
FROM (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents)
WINDOW g AS (PARTITION BY h)
"""


@query("op9_exact_dedup", SQL)
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = new_folder(spark, "digest-index")
    index = DigestIndex(spark, path, parts_for(docs.count(), ROWS_PER_BUCKET, least=8))
    out = index.deduplicate(docs).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )
    index.close()
    return out
