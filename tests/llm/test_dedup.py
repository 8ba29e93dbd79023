"""Exact, near and line deduplication against plain loops."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketframe.llm import line_dedup, near_dedup, shingles
from marketframe.llm.catalog import QUERIES
from marketframe.llm.exact_dedup import DigestIndex
from tests.conftest import SF


def index_at(spark, tmp_path, buckets=3):
    return DigestIndex(spark, f"file://{tmp_path}/index", buckets)


def rows_of(df):
    return sorted(
        ((r.doc_id, r.keep_id, r.group_size, r.kept) for r in df.collect()), key=repr
    )


def test_exact_dedup_odd_documents(spark, odd_documents, tmp_path):
    got = index_at(spark, tmp_path).deduplicate(odd_documents)
    rows = [(r.doc_id, r.text or "") for r in odd_documents.collect()]
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text].append(doc_id)
    want = []
    for doc_id, text in rows:
        ids = [i for i in groups[text] if i is not None]
        keep = max(ids) if ids else None
        want.append((doc_id, keep, len(groups[text]), doc_id == keep))
    assert rows_of(got) == sorted(want, key=repr)
    texts = {r.doc_id: r.digest for r in got.collect()}
    assert bytes(texts[4]) == hashlib.sha256(b"").digest()


def test_index_keeps_earlier_documents(spark, tmp_path):
    index = index_at(spark, tmp_path)
    first = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id long, text string")
    assert rows_of(index.deduplicate(first)) == [
        (1, 3, 2, False), (2, 2, 1, True), (3, 3, 2, True)
    ]
    again = spark.createDataFrame([(3, "a"), (9, "b"), (10, "c")], "doc_id long, text string")
    assert rows_of(index_at(spark, tmp_path).deduplicate(again)) == [
        (10, 10, 1, True), (3, 3, 3, False), (9, 2, 2, False)
    ]
    assert index.read().filter("first").count() == 3
    assert rows_of(index.deduplicate(first.filter("false"))) == []


def test_sizes_count_all_batches_and_a_repeated_batch_changes_nothing(spark, tmp_path):
    index = index_at(spark, tmp_path)
    batch = lambda *ids: spark.createDataFrame([(i, "a") for i in ids], "doc_id long, text string")
    one = rows_of(index.deduplicate(batch(1, 2), "one"))
    assert one == [(1, 2, 2, False), (2, 2, 2, True)]
    # the result of this batch is lost, and it is handed in again
    for _ in range(3):
        assert rows_of(index.deduplicate(batch(1, 2), "one")) == one
    assert rows_of(index.deduplicate(batch(3, 4, 5), "two")) == [(i, 2, 5, False) for i in (3, 4, 5)]
    assert rows_of(index.deduplicate(batch(9), "three")) == [(9, 2, 6, False)]
    assert rows_of(index.deduplicate(batch(1, 2), "one")) == [(1, 2, 6, False), (2, 2, 6, True)]
    # part of a batch was added before its job broke
    more = batch(9).unionByName(spark.createDataFrame([(11, "new")], "doc_id long, text string"))
    assert rows_of(index.deduplicate(more, "three")) == [(11, 11, 1, True), (9, 2, 6, False)]


def test_anti_join_reads_buckets_in_place(spark, tmp_path):
    index = index_at(spark, tmp_path)
    index.deduplicate(spark.createDataFrame([(1, "a")], "doc_id long, text string")).collect()
    new = spark.range(10).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"))
    plan = new.join(index.read().hint("merge"), "digest", "left_anti")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in text and text.count("Exchange hashpartitioning") == 1


def brute_classes(texts):
    sets = {i: set(shingles.multiset(shingles.normal(t)).tolist()) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, s in sets.items():
        for h in s:
            holders[h].append(i)
    common = Counter()
    for ids in holders.values():
        ids = sorted(ids)
        common.update((a, b) for k, a in enumerate(ids) for b in ids[k + 1 :])
    for (a, b), n in common.items():
        if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {i: root(i) for i in texts}


def test_near_duplicates_equal_brute_force(spark, documents):
    got = QUERIES["op1_bag_minhash"](spark, SF).collect()
    want = brute_classes({r.doc_id: r.text for r in documents.collect()})
    assert {r.doc_id: r.class_id for r in got} == want
    sizes = Counter(want.values())
    assert all(r.class_size == sizes[r.class_id] for r in got)
    assert all(r.kept == (r.doc_id == r.class_id) for r in got)


def varied(spark, seed=5):
    """A chain of versions that drift apart, many versions of one text, and clean texts."""
    rng = random.Random(seed)
    words = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    texts = {}
    base = words(150)
    for i in range(120):
        edited = base[:]
        for _ in range(rng.randrange(5)):
            edited[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        texts[i] = " ".join(edited)
    chain = words(200)
    for i in range(200, 230):
        chain = chain[:]
        chain[rng.randrange(200)] = f"y{i}"
        texts[i] = "  ".join(chain).upper()
    common = words(60)
    for i in range(300, 360):
        texts[i] = " ".join(common + words(60))
    for i in range(400, 430):
        texts[i] = " ".join(words(30) * 4)
    return texts, spark.createDataFrame(list(texts.items()), "doc_id long, text string")


def test_large_groups_chains_and_shared_passages(spark, monkeypatch):
    texts, docs = varied(spark)
    got = near_dedup.near_duplicates(docs).collect()
    assert {r.doc_id: r.class_id for r in got} == brute_classes(texts)


def test_tiles_find_links_that_hubs_miss(spark):
    """Keys with two classes: the tiles compare across and give the missing link."""
    texts, docs = varied(spark, seed=8)
    signed = near_dedup.signatures(docs, "doc_id", "text").cache()
    keyed = near_dedup.keyed_nodes(signed).cache()
    # nobody is linked yet: all keys are open, and tiles alone must find the classes
    none = spark.createDataFrame([], "node binary, label binary")
    rows = near_dedup.unfinished(keyed, none)
    nodes = signed.filter("node is not null").selectExpr("node", "doc_id first_id", "same")
    found = near_dedup.texts_of(docs, nodes.drop("first_id"), "doc_id", "text")
    links = near_dedup._meet(rows.join(found, "node"), near_dedup._link_tile, "a binary, b binary")
    labels = near_dedup.classes(links).join(nodes, "node").collect()
    smallest = {}
    for r in labels:
        smallest[bytes(r.label)] = min(smallest.get(bytes(r.label), 10**9), r.first_id)
    got = {r.first_id: smallest[bytes(r.label)] for r in labels}
    want = brute_classes(texts)
    assert {i: got.get(i, i) for i in want} == want


def test_near_duplicates_of_odd_documents(spark, odd_documents):
    got = near_dedup.near_duplicates(odd_documents).collect()
    assert len(got) == odd_documents.count()
    by_id = defaultdict(set)
    for r in got:
        by_id[r.doc_id].add((r.class_id, r.class_size))
    assert by_id[1] == by_id[2] == {(1, 3)}
    assert by_id[3] == {(3, 1)} and by_id[4] == {(4, 1)} and by_id[5] == {(5, 1)}
    assert near_dedup.near_duplicates(odd_documents.filter("false")).count() == 0
    left = near_dedup.drop_near_duplicates(odd_documents)
    assert left.columns == odd_documents.columns
    assert sorted(r.doc_id for r in left.filter("doc_id is not null").collect()) == [
        1, 1, 3, 4, 5, 6, 7, 8
    ]


A, B = "a house by the lake in the hills", "forty ships lay in the old harbour"


def kept_texts(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    near = near_dedup.near_duplicates(docs)
    kept = Counter((r.class_id, r.class_size) for r in near.filter("kept").collect())
    left = near_dedup.drop_near_duplicates(docs, **options).collect()
    return kept, sorted(((r.doc_id, r.text) for r in left), key=repr)


def test_id_of_a_dropped_row_does_not_drop_another_text(spark):
    rows = [(10, A, "s"), (10, B, "s"), (3, B, "s"), (12, A.upper(), "s")]
    for repeats in (True, False):
        kept, left = kept_texts(spark, rows, repeats=repeats)
        assert kept == {(10, 2): 1, (3, 2): 1} and left == [(10, A), (3, B)]


def test_null_id_copy_does_not_drop_other_null_ids(spark):
    rows = [(1, A, "s"), (None, A, "s"), (None, B, "s"), (None, None, "s"), (None, " ", "s")]
    for repeats in (True, False):
        kept, left = kept_texts(spark, rows, repeats=repeats)
        assert kept == {(1, 2): 1, (None, 1): 3}
        assert left == sorted([(1, A), (None, B), (None, None), (None, " ")], key=repr)


def test_one_of_equal_rows_is_kept(spark):
    rows = [(1, A, "s"), (1, A, "t"), (1, A, "s"), (1, A.upper(), "s"), (2, A, "s")]
    rows += [(None, B, "s"), (None, B, "s"), (5, None, "s"), (5, None, "s")]
    kept, left = kept_texts(spark, rows, repeats=False)
    assert kept == {(1, 5): 1, (None, 2): 1, (5, 1): 2}
    assert left.count((5, None)) == 2 and (None, B) in left and len(left) == 4
    assert ((1, A) in left) != ((1, A.upper()) in left)


def test_bag_signatures_estimate_multiset_similarity():
    rng = random.Random(2)
    errors = []
    for k in range(40):
        words = [f"{k}w{rng.randrange(300)}" for _ in range(300)]
        other = words[:]
        for _ in range(rng.randrange(12)):
            other[rng.randrange(300)] = f"v{rng.randrange(10**6)}"
        a = shingles.normal(" ".join(words + words[:80] * 3))
        b = shingles.normal(" ".join(other + other[:80] * 2))
        x, y = set(shingles.multiset(a).tolist()), set(shingles.multiset(b).tolist())
        one, two = shingles.bag_signatures([a, b], 2048)
        errors.append((one == two).mean() - len(x & y) / len(x | y))
    assert abs(np.mean(errors)) < 0.006 and np.max(np.abs(errors)) < 0.05


def test_signature_does_not_depend_on_company():
    texts = [shingles.normal(t) for t in ("a", "a b c d e f", "x " * 500, "p q r s t u v w " * 3)]
    together = shingles.bag_signatures(texts, 144)
    alone = [shingles.bag_signatures([t], 144)[0] for t in texts]
    assert all((a == b).all() for a, b in zip(together, alone))


def test_word_hashes_do_not_depend_on_sections(monkeypatch):
    text = shingles.normal(" ".join(f"wörd{i % 91}" for i in range(3000)))
    whole = shingles.word_hashes(text)
    monkeypatch.setattr(shingles, "SECTION", 64)
    assert (shingles.word_hashes(text) == whole).all() and len(whole) == 3000


def test_counted_words_and_short_texts():
    assert len(shingles.multiset(b"a b c d e f")) == 2
    assert len(shingles.multiset(b"a b")) == 1 and len(shingles.multiset(b"")) == 0
    assert len(np.unique(shingles.multiset(b" ".join([b"a"] * 30)))) == 26


@pytest.mark.parametrize("doc_id", [None, 7])
def test_texts_of_many_rows_under_one_id_stay_linear(spark, doc_id):
    rows = [(doc_id, " ".join(f"w{i}x{k}" for k in range(8))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").cache()
    signed = near_dedup.signatures(docs, "doc_id", "text").select("node", "same")
    met = docs.select(near_dedup.same_row(F.col("doc_id"), F.col("text")).alias("same")).join(signed, "same")
    assert met.count() == 300
    assert near_dedup.texts_of(docs, signed, "doc_id", "text").count() == 300
    got = near_dedup.near_duplicates(docs).collect()
    assert len(got) == 300 and all(r.kept and r.class_size == 1 for r in got)


@pytest.mark.parametrize("doc_id", [None, 7])
def test_line_dedup_of_rows_under_one_id(spark, doc_id):
    rows = [(doc_id, f"same line\nown {i}", f"s{i}") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = line_dedup.remove_boilerplate(docs).collect()
    assert sorted(r.n_removed for r in out) == [0] + [1] * 11


@pytest.mark.parametrize(
    "sites, need", [(0, 3), (1, 3), (5, 3), (7, 3), (8, 4), (20, 8), (100, 40), (1001, 401)]
)
def test_line_threshold_is_a_share_of_all_sites(spark, sites, need):
    docs = spark.range(sites * 2).selectExpr(f"nullif(id % {max(sites, 1)}, 0L) || '' AS source")
    assert line_dedup.site_threshold(docs) == need


def test_line_dedup_near_threshold_counts_exactly(spark):
    rows, doc = [], 0
    for n in range(1, 31):
        for s in range(n):
            doc += 1
            rows.append((doc, f"line on {n} sites\nown text {doc}", f"site{s}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = line_dedup.remove_boilerplate(docs, min_sites=10)
    removed = Counter()
    for r in out.collect():
        removed[r.doc.text.split("\n")[0]] += r.n_removed
    # all but one occurrence from ten sites on
    assert removed == {f"line on {n} sites": n - 1 if n >= 10 else 0 for n in range(1, 31)}


def test_line_dedup_odd_documents(spark, odd_documents):
    out = line_dedup.remove_boilerplate(odd_documents, min_sites=2).collect()
    assert len(out) == odd_documents.count()
    by_id = defaultdict(list)
    for r in out:
        by_id[r.doc.doc_id].append((r.text, r.n_lines, r.n_removed, r.emptied))
    assert by_id[2] == [("", 1, 1, True)]
    assert all(x[2] == 0 for x in by_id[1]) and len(by_id[1]) == 2
    assert by_id[3] == [(None, 0, 0, False)] and by_id[4] == [("", 1, 0, False)]
    assert by_id[5] == [(" \t\n ", 2, 0, False)]
    assert line_dedup.remove_boilerplate(odd_documents.filter("false")).count() == 0


def test_line_dedup_removes_repeats_in_the_keeping_document(spark):
    rows = [(i, "same\nsame\n\nown %d" % i, f"s{i}") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc.doc_id: r.text for r in line_dedup.remove_boilerplate(docs, 3).collect()}
    assert got == {i: ("same\n\nown 0" if i == 0 else f"\nown {i}") for i in range(5)}


@pytest.mark.parametrize("sites", [12, 40, 400])
def test_sketch_agrees_with_exact_beyond_the_zone(spark, sites):
    rows = [(i, "spread", f"s{i % sites}") for i in range(sites * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = line_dedup.remove_boilerplate(docs, min_sites=10)
    assert out.agg(F.sum("n_removed")).first()[0] == sites * 3 - 1
