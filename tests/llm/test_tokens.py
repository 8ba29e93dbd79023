"""Token ids, token files and packing against the tokenizer itself."""

import os
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from marketframe.llm import packing, token_files
from marketframe.llm.catalog import QUERIES
from marketframe.llm.tokens import encoder
from tests.conftest import SF

PATH = public_tokenizers.path("word_bpe_49k.json")
REAL = Tokenizer.from_file(PATH)


def real_ids(text):
    return REAL.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


@settings(max_examples=400, deadline=None)
@given(
    st.text(
        st.one_of(
            st.characters(max_codepoint=0x17F),
            st.sampled_from("aAhHßéÉ'’.,;|<>_ \t\n\x85\xa0\x1ć̱ΣςİıA0²½"),
            st.characters(exclude_categories=("Cs",)),
        )
    )
)
def test_ids_equal_the_tokenizers(text):
    assert encoder(PATH).encode(text).tolist() == real_ids(text)


def test_control_strings_and_contractions():
    for text in ["a<|endoftext|>b", "It's we'RE don't I'll", "<|startoftext|> x <|", "A'S 'Tis"]:
        assert encoder(PATH).encode(text).tolist() == real_ids(text)


def test_words_beyond_memory_are_encoded_anew(monkeypatch):
    from marketframe.llm import tokens

    monkeypatch.setattr(tokens, "WORD_MEMORY", 2)
    monkeypatch.setattr(tokens, "PIECE_MEMORY", 1)
    text = "one two three four, five six. one two"
    assert tokens.TextEncoder(PATH).encode(text).tolist() == real_ids(text)


def expected_files(rows):
    out, start = [], 0
    for doc_id, text in rows:
        ids = real_ids(text) + [2]
        out.append((doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    return out


def test_token_files_round_trip(spark, documents):
    rows = sorted((r.doc_id, r.text) for r in documents.select("doc_id", "text").collect())
    got = [tuple(r) for r in QUERIES["op5_token_files"](spark, SF).orderBy("start").collect()]
    assert got == expected_files(rows)


def test_token_files_of_odd_documents(spark, odd_documents, tmp_path):
    from pyspark.sql import functions as F

    token_files.write_token_files(odd_documents, str(tmp_path), PATH, 2, parts=3)
    read = token_files.read_token_files(spark, str(tmp_path)).withColumn("crc", F.crc32("ids"))
    got = [(r.doc_id, r.start, r.n_tokens, r.crc) for r in read.orderBy("start").collect()]
    rows = odd_documents.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    assert [g[0] for g in got] == sorted((r.doc_id for r in rows), key=lambda i: (i is not None, i))
    assert sorted(g[3] for g in got) == sorted(crc(real_ids(r.text) + [2]) for r in rows)
    assert [g[1] for g in got] == np.cumsum([0] + [g[2] for g in got])[:-1].tolist()


def test_token_files_are_memory_mapped(spark, documents, tmp_path):
    manifest = token_files.write_token_files(documents.limit(20), str(tmp_path), PATH, 2, parts=2)
    row = manifest.orderBy("part").first()
    part = token_files.TokenPart(str(tmp_path), row.part, row.width)
    assert isinstance(part.ids, np.memmap) and row.width == 2 and len(part) == row.docs
    assert not [f for f in os.listdir(tmp_path) if f.count(".") > 1 and not f.startswith(".")]


def test_token_files_of_no_documents(spark, documents, tmp_path):
    token_files.write_token_files(documents.filter("false"), str(tmp_path), PATH, 2, parts=2)
    assert token_files.read_token_files(spark, str(tmp_path)).count() == 0


def check_pieces(pieces, texts, window=2048):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    for doc_id, text in texts.items():
        ids, at = real_ids(text) + [1], 0
        for p in sorted(by_doc[doc_id], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == crc(ids[at : at + p.length])
            at += p.length
        assert at == len(ids)
    padding = 0
    for sequence in by_sequence.values():
        at = 0
        for p in sorted(sequence, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert 0 < at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    assert padding == 0


def test_packing(spark, documents):
    texts = {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
    check_pieces(QUERIES["op4_pack_sum_of_squares"](spark, SF).collect(), texts)


def test_packing_odd_documents(spark, odd_documents):
    rows = odd_documents.filter("doc_id is not null").dropDuplicates(["doc_id"])
    texts = {r.doc_id: r.text for r in rows.collect()}
    check_pieces(packing.packing_digests(packing.pack_documents(rows, PATH, 1)).collect(), texts)
    pieces = packing.pack_documents(odd_documents, PATH, 1).collect()
    assert sum(p.length for p in pieces) == sum(
        len(real_ids(r.text)) + 1 for r in odd_documents.collect()
    )
    assert packing.pack_documents(odd_documents.filter("false"), PATH, 1).count() == 0


def test_level_has_the_least_sum_of_squares():
    rng = np.random.default_rng(3)
    bins = packing.SumOfSquares(32)
    for size in rng.integers(1, 32, 400).tolist():
        costs = {}
        for h in [0] + [h for h in range(1, 32) if bins.counts[h] and h + size <= 32]:
            counts = bins.counts.copy()
            if h:
                counts[h] -= 1
            if h + size < 32:
                counts[h + size] += 1
            costs[h] = int((counts[:32] ** 2).sum())
        assert costs[bins.level(size)] == min(costs.values())
        bins.place(size, size)


@pytest.mark.parametrize("lengths", [[5], [8, 8], [3, 9, 14, 1], [64]])
def test_recut_leaves_no_padding(lengths):
    pieces = [(i, 0, np.arange(n), n) for i, n in enumerate(lengths)]
    sizes = [sum(len(p[2]) for p in s) for s in packing.recut(pieces, 16)]
    assert sum(sizes) == sum(lengths)
    assert all(n & (n - 1) == 0 for n in sizes)
