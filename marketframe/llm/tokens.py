"""Token ids of whole texts by a public tokenizer, with memory of words already seen.

Encoding runs inside Arrow batches.  The tokenizer of this vocabulary drops
white space, lower-cases, splits at fixed character classes and merges inside
each piece, so the ids of a text are the ids of its white-space separated words
in order.  Each Python worker keeps a bounded memory of words and pieces; a word
outside plain Latin letters, or with a control string in it, is handed to the
tokenizer as it is.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Words and pieces remembered per Python worker; beyond it, words are encoded anew.
WORD_MEMORY = 400_000
PIECE_MEMORY = 250_000
#: Characters below this code need no normalisation (no combining marks, all composed).
PLAIN = 0x130

_ENCODERS: dict[str, "TextEncoder"] = {}


def encoder(path: str) -> "TextEncoder":
    """The worker's encoder of this vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]


def _class(want) -> str:
    return "".join(re.escape(chr(i)) for i in range(PLAIN) if want(chr(i)))


def _byte_letters() -> dict[int, str]:
    """Printable stand-ins of bytes: itself where visible, else the next free code from 256."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(rest)}


class TextEncoder:
    """Ids of texts as flat unsigned arrays, equal to the tokenizer's own ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        letters = _class(lambda c: unicodedata.category(c)[0] == "L")
        numbers = _class(lambda c: unicodedata.category(c)[0] == "N")
        spaces = _class(lambda c: c.isspace() and not "\x1c" <= c <= "\x1f")
        # the split pattern of this vocabulary, limited to plain characters
        self.pieces_of = re.compile(
            f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{spaces}{letters}{numbers}]+"
        ).findall
        self.beyond = re.compile(f"[^\x00-{chr(PLAIN - 1)}]").search
        self.bytes_to_letters = _byte_letters()
        self.words: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        """Little-endian ids of the whole text, ``dtype`` each."""
        if "<|" in text or self.beyond(text):
            words = text.encode("utf-8", "surrogatepass").split()
        else:
            # ASCII letters only: without combining marks this commutes with the normaliser
            words = text.encode().lower().split()
        try:
            return b"".join(map(self.words.__getitem__, words))
        except KeyError:
            return b"".join(map(self._word, words))

    def _word(self, word: bytes) -> bytes:
        found = self.words.get(word)
        if found is None:
            text = word.decode("utf-8", "replace")
            if "<|" in text or self.beyond(text):
                found = self._pack(self.tokenizer.encode(text, add_special_tokens=False).ids)
            elif text.isalpha():
                found = self._piece(text.lower())
            else:
                found = b"".join(map(self._piece, self.pieces_of(text.lower())))
            if len(self.words) < WORD_MEMORY:
                self.words[word] = found
        return found

    def _piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            shown = piece.encode().decode("latin-1").translate(self.bytes_to_letters)
            found = self._pack([t.id for t in self.model.tokenize(shown)])
            if len(self.pieces) < PIECE_MEMORY:
                self.pieces[piece] = found
        return found

    def _pack(self, ids: list[int]) -> bytes:
        return np.array(ids, dtype=self.dtype).tobytes()

    def encode(self, text: str | None, end: int | None = None) -> np.ndarray:
        """Ids of ``text`` (null: none), then the end id."""
        raw = self.ids(text) if text else b""
        if end is not None:
            raw += np.array([end], dtype=self.dtype).tobytes()
        return np.frombuffer(raw, dtype=self.dtype)


def rows_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Rows of Arrow batches; values become Python objects one slice at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield from zip(*[part.column(n).to_pylist() for n in names])


class Rows:
    """Collects rows and gives them out as Arrow batches of bounded size."""

    def __init__(self, schema: pa.Schema, most_bytes: int = 8 << 20, most_rows: int = 50_000):
        self.schema, self.most_bytes, self.most_rows = schema, most_bytes, most_rows
        self.rows: list[tuple] = []
        self.held = 0

    def add(self, row: tuple, weight: int = 0) -> bool:
        """True when a batch is due."""
        self.rows.append(row)
        self.held += weight
        return self.held >= self.most_bytes or len(self.rows) >= self.most_rows

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) if self.rows else [()] * len(self.schema)
        out = pa.RecordBatch.from_arrays(
            [pa.array(c, type=f.type) for c, f in zip(columns, self.schema)], schema=self.schema
        )
        self.rows, self.held = [], 0
        return out
