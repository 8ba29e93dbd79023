"""Packing documents into fixed windows by the sum-of-squares rule, online.

Every task encodes its documents and packs them as they come.  A level array
counts the open windows of each fill level; a document goes to the level (level
0 is a new window) after which the sum of the squared counts is least.  Only
documents longer than a window are cut while packing.  When a task's documents
end, the windows still open are joined and cut anew into full windows, and the
remainder becomes windows whose lengths are powers of two, which need no padding.
Nothing is shuffled, and memory holds one document and the open windows.

Defined results: null and empty texts are one piece, their end id; repeated rows
are packed each on its own; an empty table gives no rows; other columns are
ignored; a document of any length is cut into as many full windows as it fills.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from marketframe.llm.common import pick, table
from marketframe.llm.registry import query
from marketframe.llm.tokens import Rows, encoder, rows_of

_PIECE = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids", pa.binary()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
    ]
)
_PIECE_DDL = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, "
    "sequence_id long, offset long"
)
#: Sequence ids of task k start at k times this.
TASK_SPAN = 1 << 40


class SumOfSquares:
    """Open windows by fill level, and the level that a size should go to."""

    def __init__(self, window: int):
        self.window = window
        self.counts = np.zeros(window + 1, dtype=np.int64)
        self.open: list[list[list]] = [[] for _ in range(window)]

    def level(self, size: int) -> int:
        """Fill level to place ``size`` at; ties go to the fuller window.

        Moving a window from level h to level g changes the sum of squares by
        2 (counts[g] - counts[h]) + 2, without the term of an end that is not
        counted (a new window, a full one).
        """
        counts, top = self.counts, self.window - size
        change = 1 - 2 * counts[: top + 1]
        change[0] = 0
        change += 2 * counts[size : self.window + 1] + 1
        if top:
            change[top] -= 1  # the window becomes full and leaves the count
        usable = counts[: top + 1] > 0
        usable[0] = True
        change[~usable] = np.iinfo(np.int64).max
        return top - int(np.argmin(change[::-1]))

    def place(self, size: int, piece) -> list | None:
        """Pieces of the window, if this one fills it."""
        at = self.level(size)
        if at:
            self.counts[at] -= 1
            window = self.open[at].pop()
        else:
            window = []
        window.append(piece)
        if at + size == self.window:
            return window
        self.counts[at + size] += 1
        self.open[at + size].append(window)
        return None

    def rest(self) -> Iterator:
        """Pieces of the windows still open, fullest window first."""
        for level in range(self.window - 1, 0, -1):
            for window in self.open[level]:
                yield from window


def recut(pieces, window: int) -> Iterator[list]:
    """Pieces joined and cut into full windows, then into powers of two."""
    total = sum(len(p[2]) for p in pieces)
    sizes = [window] * (total // window)
    rest = total % window
    sizes += [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    pieces, at = iter(pieces), 0
    current = next(pieces, None)
    for size in sizes:
        out = []
        while size:
            doc_id, start, ids, doc_tokens = current
            take = min(size, len(ids) - at)
            out.append((doc_id, start + at, ids[at : at + take], doc_tokens))
            size, at = size - take, at + take
            if at == len(ids):
                current, at = next(pieces, None), 0
        yield out


def _packer(vocabulary: str, end_id: int, window: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, bins, out = encoder(vocabulary), SumOfSquares(window), Rows(_PIECE)
        sequence = TaskContext.get().partitionId() * TASK_SPAN

        def emit(pieces):
            nonlocal sequence
            offset, due = 0, False
            for doc_id, start, ids, doc_tokens in pieces:
                raw = ids.astype("<u4").tobytes()
                due |= out.add(
                    (doc_id, start, len(ids), raw, doc_tokens, sequence, offset), len(raw)
                )
                offset += len(ids)
            sequence += 1
            return due

        for doc_id, text in rows_of(batches, "doc_id", "text"):
            ids = enc.encode(text, end_id)
            whole = len(ids) - len(ids) % window
            for start in range(0, whole, window):
                if emit([(doc_id, start, ids[start : start + window], len(ids))]):
                    yield out.batch()
            if whole < len(ids):
                # a copy: a slice would hold the whole document in memory
                tail = (doc_id, whole, ids[whole:].copy(), len(ids))
                full = bins.place(len(tail[2]), tail)
                if full and emit(full):
                    yield out.batch()
        for pieces in recut(list(bins.rest()), window):
            if emit(pieces):
                yield out.batch()
        yield out.batch()

    return pack


def pack_documents(
    docs: DataFrame,
    vocabulary: str,
    end_id: int,
    window: int = 2048,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per piece: its document, place in it, ids, sequence and offset there."""
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    rows = pick(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(_packer(vocabulary, end_id, window), _PIECE_DDL)


def packing_digests(pieces: DataFrame) -> DataFrame:
    return pieces.select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


@query("op4_pack_sum_of_squares")
def op4_pack_sum_of_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return packing_digests(pack_documents(table(spark, sf_dir, "documents"), vocabulary, end_id=1))
