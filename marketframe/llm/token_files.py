"""Token ids as flat binary files with 64-bit document offsets.

Documents are range-partitioned by id and sorted; each task encodes its range
and writes one pair of files, named by the partition and put in place by a
rename, so a repeated task replaces equal bytes.  Only counts per partition come
back; their prefix sums are the partition bases in the manifest.  Reading maps
the files into memory and slices documents out of them.

Format of a part ``k``: ``part-k.bin`` holds the ids, little-endian, two bytes
each where the vocabulary allows, else four.  ``part-k.idx`` holds, little-endian:
the number of documents n, n + 1 offsets into the ids, n document ids (all
64-bit), then n bytes that are 1 where the document id is not null.
``manifest`` is a Parquet table of parts with ``first_token`` and ``first_doc``.

Defined results: null text counts as empty and gets its end id alone; null ids
sort first; rows that share an id are ordered by their text and stay separate;
an empty table gives a manifest without rows; other columns are ignored.
"""

from __future__ import annotations

import os
import posixpath
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from marketframe.functions.storage import materialise, new_folder
from marketframe.llm.common import pick, table
from marketframe.llm.registry import query
from marketframe.llm.tokens import Rows, encoder, rows_of

_MANIFEST = "part int, docs long, tokens long, width int"
_READ = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())]
)
_READ_DDL = "doc_id long, start long, n_tokens long, ids binary"


def file_system(uri: str):
    """Arrow file system and path of a folder URI or a plain path."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        uri = "file://" + os.path.abspath(uri)
    elif uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return fs.FileSystem.from_uri(uri)


def _put(filesystem, path: str, chunks: list[bytes]) -> None:
    """All bytes appear under ``path`` at once."""
    attempt = f"{path}.{uuid.uuid4().hex}"
    with filesystem.open_output_stream(attempt) as out:
        for chunk in chunks:
            out.write(chunk)
    filesystem.move(attempt, path)


def _writer(folder: str, vocabulary: str, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = file_system(folder)
        enc, part = encoder(vocabulary), TaskContext.get().partitionId()
        lengths, ids, known, tokens = [], [], [], 0
        name = posixpath.join(root, f"part-{part:06d}")
        attempt = f"{name}.bin.{uuid.uuid4().hex}"
        with filesystem.open_output_stream(attempt) as out:
            for doc_id, text in rows_of(batches, "doc_id", "text"):
                found = enc.encode(text, end_id)
                out.write(found.tobytes())
                lengths.append(len(found))
                ids.append(0 if doc_id is None else doc_id)
                known.append(doc_id is not None)
                tokens += len(found)
        if not lengths:
            filesystem.delete_file(attempt)
            return
        filesystem.move(attempt, f"{name}.bin")
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype("<i8")
        head = np.array([len(lengths)], dtype="<i8")
        parts = [head, offsets, np.array(ids, dtype="<i8"), np.array(known, dtype="u1")]
        _put(filesystem, f"{name}.idx", [x.tobytes() for x in parts])
        yield pa.RecordBatch.from_pydict(
            {
                "part": pa.array([part], pa.int32()),
                "docs": pa.array([len(lengths)], pa.int64()),
                "tokens": pa.array([tokens], pa.int64()),
                "width": pa.array([enc.dtype.itemsize], pa.int32()),
            }
        )

    return write


def write_token_files(
    docs: DataFrame,
    folder: str,
    vocabulary: str,
    end_id: int,
    doc_id: str = "doc_id",
    text: str = "text",
    parts: int | None = None,
) -> DataFrame:
    """Write ``docs`` in ascending id order; returns the manifest.

    ``parts`` defaults to the session's shuffle partitions.  Rows are dealt by id
    and text hash, so many rows under one id do not meet in one part.
    """
    spark = docs.sparkSession
    filesystem, root = file_system(folder)
    filesystem.create_dir(root, recursive=True)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        pick(docs, doc_id=doc_id, text=text)
        .withColumn("doc_id", F.col("doc_id").cast("long"))
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange(parts, "doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie", "text")
        .select("doc_id", "text")
    )
    counts = materialise(
        ordered.mapInArrow(_writer(folder, vocabulary, end_id), _MANIFEST), "token-parts"
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts.select(
        "part",
        "docs",
        "tokens",
        "width",
        F.coalesce(F.sum("docs").over(before), F.lit(0)).alias("first_doc"),
        F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("first_token"),
    ).coalesce(1).write.mode("overwrite").parquet(posixpath.join(folder, "manifest"))
    return spark.read.parquet(posixpath.join(folder, "manifest"))


def _mapped(filesystem, path: str, dtype) -> np.ndarray:
    """The file as an array: mapped where it is local, else read."""
    if filesystem.type_name == "local":
        return np.memmap(path, dtype=dtype, mode="r")
    with filesystem.open_input_file(path) as f:
        return np.frombuffer(f.readall(), dtype=dtype)


class TokenPart:
    """One part's documents, sliced from the mapped files."""

    def __init__(self, folder: str, part: int, width: int):
        filesystem, root = file_system(folder)
        name = posixpath.join(root, f"part-{part:06d}")
        index = _mapped(filesystem, f"{name}.idx", "u1")
        n = int(index[:8].view("<i8")[0])
        self.offsets = index[8 : 16 + 8 * n].view("<i8")
        self.doc_ids = index[16 + 8 * n : 16 + 16 * n].view("<i8")
        self.known = index[16 + 16 * n : 16 + 17 * n]
        self.ids = _mapped(filesystem, f"{name}.bin", f"<u{width}")

    def __len__(self) -> int:
        return len(self.doc_ids)

    def __getitem__(self, i: int) -> np.ndarray:
        return self.ids[self.offsets[i] : self.offsets[i + 1]]


def _reader(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(_READ)
        for part, width, base in rows_of(batches, "part", "width", "first_token"):
            data = TokenPart(folder, part, width)
            for i in range(len(data)):
                ids = data[i].astype("<u4").tobytes()
                doc_id = int(data.doc_ids[i]) if data.known[i] else None
                row = (doc_id, base + int(data.offsets[i]), len(ids) // 4, ids)
                if out.add(row, len(ids)):
                    yield out.batch()
        yield out.batch()

    return read


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document: ``doc_id, start, n_tokens, ids`` (32-bit little-endian)."""
    manifest = spark.read.parquet(posixpath.join(folder, "manifest"))
    n = max(1, manifest.count())
    return (
        manifest.select("part", "width", "first_token")
        .repartition(n, "part")
        .mapInArrow(_reader(folder), _READ_DDL)
    )


@query("op5_token_files")
def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = new_folder(spark, "token-files")
    docs = table(spark, sf_dir, "documents")
    write_token_files(docs, folder, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_token_files(spark, folder).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )
