r"""Line deduplication by the number of distinct sites that carry a line.

Lines are compared by a 128-bit hash of the trimmed line.  One HyperLogLog sketch
of sites per line hash is built map-side and merged by aggregation.  Lines whose
estimate lies clearly below the threshold stay, clearly above it they are
boilerplate, and only those near it get an exact count of distinct sites.  The
threshold is a share of all sites of the input, at least ``LEAST_SITES``.  Of a
boilerplate line the occurrence in the smallest document id (first row, first
position) stays, so no text leaves the corpus altogether; all others are removed.

A frequent line is one row per map task from the first aggregation on.  Removed
positions come back as a list per document, no longer than its lines.

Defined results: blank lines are never boilerplate; a null site is one site of its
own; null text stays null and an empty text has one blank line; of different rows
under one id, or under none, one keeps a line; repeated rows behave alike; an empty
table gives no rows; other columns pass through and may have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from marketframe.functions.storage import materialise
from marketframe.llm.common import column, pick, table
from marketframe.llm.registry import query

#: Percentage of all distinct sites from which a line counts as boilerplate, and the
#: number of sites it has at least.
SITE_PERCENT = 40
LEAST_SITES = 3
#: HyperLogLog precision (2^k registers) and the half width of "near", in standard errors.
LG_K = 8
NEAR = 4.0

_BLANK = " \t\r\x0b\x0c"


def _lines(docs: DataFrame, doc_id: str, text: str, site: str) -> DataFrame:
    """``r1, r2`` (document), ``doc_id, site, pos, h1, h2`` per line that is not blank."""
    rows = pick(docs, doc_id=doc_id, text=text, site=site)
    where = F.when(F.col("site").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), "site"))
    rows = rows.select(
        *_row_key(F.col("doc_id"), F.col("site"), F.col("text")),
        "doc_id",
        where.alias("site"),
        F.posexplode(F.split("text", "\n")).alias("pos", "line"),
    )
    line = F.btrim("line", F.lit(_BLANK))
    return rows.withColumn("line", line).filter("line != ''").select(
        "r1",
        "r2",
        "doc_id",
        "site",
        "pos",
        F.xxhash64("line").alias("h1"),
        F.xxhash64(F.lit(1), "line").alias("h2"),
    )


def _row_key(doc_id, site, text):
    return (
        F.xxhash64(doc_id, site, text).alias("r1"),
        F.xxhash64(F.lit(1), doc_id, site, text).alias("r2"),
    )


def site_threshold(docs: DataFrame, site: str = "source") -> int:
    """Distinct sites from which a line of ``docs`` counts as boilerplate."""
    # a null site is a site; one number comes back
    sites = pick(docs, site=site).distinct().count()
    return max(LEAST_SITES, (SITE_PERCENT * sites + 99) // 100)


def boilerplate_lines(lines: DataFrame, min_sites: int, lg_k: int, near: float) -> DataFrame:
    """``h1, h2, keep`` of lines on at least ``min_sites`` sites; ``keep`` is where one stays."""
    error = near * 1.04 / 2 ** (lg_k / 2)
    spread = materialise(
        lines.groupBy("h1", "h2")
        .agg(
            F.hll_sketch_estimate(F.hll_sketch_agg("site", lg_k)).alias("sites"),
            F.min(F.struct("doc_id", "r1", "pos")).alias("keep"),
        )
        .filter(F.col("sites") >= min_sites * (1 - error)),
        "line-spread",
    )
    clear = F.col("sites") > min_sites * (1 + error)
    close = spread.filter(~clear).select("h1", "h2", "keep")
    exact = (
        lines.select("h1", "h2", "site")
        .join(close, ["h1", "h2"])
        .groupBy("h1", "h2", "site")
        .agg(F.first("keep").alias("keep"))
        .groupBy("h1", "h2")
        .agg(F.first("keep").alias("keep"), F.count(F.lit(1)).alias("sites"))
        .filter(F.col("sites") >= min_sites)
    )
    return spread.filter(clear).drop("sites").unionByName(exact.drop("sites"))


def remove_boilerplate(
    docs: DataFrame,
    min_sites: int | None = None,
    lg_k: int = LG_K,
    near: float = NEAR,
    doc_id: str = "doc_id",
    text: str = "text",
    site: str = "source",
) -> DataFrame:
    """All documents as ``doc`` (struct of their columns), ``text, n_lines, n_removed, emptied``.

    ``emptied``: the document had lines that are not blank and all were removed.
    ``min_sites`` is ``site_threshold`` of the input unless given.
    """
    if min_sites is None:
        min_sites = site_threshold(docs, site)
    lines = _lines(docs, doc_id, text, site)
    flagged = materialise(boilerplate_lines(lines, min_sites, lg_k, near), "line-flags")
    here = (F.col("r1") == F.col("keep.r1")) & (F.col("pos") == F.col("keep.pos"))
    removed = (
        lines.join(flagged, ["h1", "h2"])
        .filter(~here)
        .groupBy("r1", "r2")
        .agg(F.collect_set("pos").alias("removed"))
    )
    rows = docs.select(
        F.struct(*[column(docs, c) for c in docs.columns]).alias("doc"),
        F.split(column(docs, text), "\n").alias("lines"),
        *_row_key(column(docs, doc_id), column(docs, site), column(docs, text)),
    )
    found = rows.join(removed, ["r1", "r2"], "left")
    places = F.sequence(F.lit(0), F.size("lines") - 1)
    kept = F.transform(
        F.array_except(places, F.col("removed")), lambda i: F.element_at(F.col("lines"), i + 1)
    )
    left = F.when(F.col("removed").isNull(), F.col("lines")).otherwise(kept)
    out = found.select(
        "doc",
        left.alias("kept"),
        F.coalesce(F.size("lines"), F.lit(0)).alias("n_lines"),
        F.coalesce(F.size("removed"), F.lit(0)).alias("n_removed"),
    )
    blank = F.forall("kept", lambda x: F.btrim(x, F.lit(_BLANK)) == "")
    return out.select(
        "doc",
        F.array_join("kept", "\n").alias("text"),
        F.greatest("n_lines", F.lit(0)).alias("n_lines"),
        F.greatest("n_removed", F.lit(0)).alias("n_removed"),
        ((F.col("n_removed") > 0) & blank).alias("emptied"),
    )


SQL = f"""
WITH line AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS pos
  FROM documents
),
trimmed AS (
  SELECT *, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS k FROM line
),
need AS (
  SELECT greatest({LEAST_SITES},
                  ({SITE_PERCENT} * count(DISTINCT coalesce('s' || source, 'n')) + 99) // 100) AS n
  FROM documents
),
spread AS (
  SELECT k, min((doc_id, pos)) AS keep FROM trimmed WHERE k <> ''
  GROUP BY k HAVING count(DISTINCT coalesce('s' || source, 'n')) >= (SELECT n FROM need)
),
marked AS (
  SELECT t.doc_id, t.pos, t.line, t.k,
         s.k IS NOT NULL AND (t.doc_id, t.pos) <> s.keep AS gone
  FROM trimmed t LEFT JOIN spread s ON t.k = s.k
)
SELECT doc_id,
       coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text,
       count(*)::INTEGER AS n_lines,
       (count(*) FILTER (gone))::INTEGER AS n_removed,
       bool_or(gone) AND count(*) FILTER (NOT gone AND k <> '') = 0 AS emptied
FROM marked GROUP BY doc_id
"""


@query("op8_line_dedup", SQL)
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_boilerplate(table(spark, sf_dir, "documents"))
    return out.select(F.col("doc.doc_id").alias("doc_id"), "text", "n_lines", "n_removed", "emptied")
