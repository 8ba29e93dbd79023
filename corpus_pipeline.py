"""From raw documents to packed training sequences.

Each stage takes the documents that its predecessor kept, written as Parquet and read
again, and returns documents with the same columns; the last returns packed pieces.
Stages handle what their operators handle: nulls in any column, empty and very long
texts, repeated rows and empty tables (see each operator's docstring).

1. ``language``: documents without a letter or without a language clearly ahead go.
2. ``lines``: lines on many sites are removed but for one occurrence; a document of
   which nothing else is left goes.
3. ``near_duplicates``: one document of each class of near duplicates stays.
4. ``mix``: sources are brought to their target weights by whole blocks of words; a
   document taken in part or several times gives a row per run of its words.
5. ``pack``: documents are encoded and packed into sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from marketframe.functions.ship import ship
from marketframe.functions.storage import new_folder, scope
from marketframe.llm.language_id import UNKNOWN, held_out, predictor, train
from marketframe.llm.line_dedup import remove_boilerplate
from marketframe.llm.mixing import mixed_documents
from marketframe.llm.near_dedup import drop_near_duplicates
from marketframe.llm.packing import pack_documents

#: Calibrated score below which no language is clearly ahead.
MIN_SCORE = 0.35


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised (operator 2)."""
    model = train(docs, ~held_out(F.col("doc_id")))
    found = predictor(model)(F.col("text"))
    known = (found["lang"] != UNKNOWN) & (found["score"] >= MIN_SCORE)
    # without a labelled document nothing can be recognised, and all stay
    return docs.filter(known) if model.languages else docs


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many sites share (operator 8)."""
    rows = remove_boilerplate(docs).filter(~F.col("emptied"))
    changed = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return rows.select(
        *[
            F.when(F.col("n_removed") > 0, changed[c]).otherwise(F.col("doc")[c]).alias(c)
            if c in changed
            else F.col("doc")[c].alias(c)
            for c in docs.columns
        ]
    )


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate class (operator 1)."""
    return drop_near_duplicates(docs, repeats=False)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents mixed to target weights (operator 10)."""
    return mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences with their token ids (operator 4)."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("mix", mix),
    ("pack", pack),
]

#: A fitted model decides the first stage, so SQL cannot give the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents``."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_folder(spark, f"pipeline-{name}")
        # what a stage writes for itself goes when its result is written
        with scope():
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
