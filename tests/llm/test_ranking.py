"""Lexical search, hard negatives and quality against brute force and held-out labels."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketframe.llm import hard_negatives as hn, lexical_search as ls, quality as ql
from marketframe.llm.catalog import QUERIES
from tests.conftest import SF

TERM = re.compile(ls.TERM)
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute_search(docs, items, k):
    found = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in found if c]
    n_docs, words = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item_id, text in set(items):
        scores = []
        for i, c, n in held:
            m = 10 + (90 * n * n_docs) // words
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                for t in set(terms(text))
                if c[t]
            )
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [
            (item_id, r, s[3], -s[0]) for r, s in enumerate(sorted(scores, key=lambda s: s[:3])[:k], 1)
        ]
    return sorted(out, key=repr)


def searched(spark, docs, items, k=10):
    d = spark.createDataFrame(
        [(i, t, "x", 1) for i, t in docs], "doc_id long, text string, term string, key long"
    )
    q = spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in ls.ranked_documents(d, q, k).collect()), key=repr)


def test_terms_split_like_the_pattern():
    for text in (None, "", " ", "A-b_C9", "ÀÉ naïve İSTANBUL ß", "a\x00b\x7fc d", "x" * 70_000 + "!Y"):
        assert [t.decode() for t in ls.terms_of(text)] == terms(text)


def test_search_equals_brute_force_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(ls, "BLOCK_POSTINGS", 60)
    monkeypatch.setattr(ls, "SCOUTS", 3)
    monkeypatch.setattr(ls, "ITEM_ROWS", 3)
    draw = np.random.default_rng(3)
    words = [f"w{i}" for i in range(40)] + ["Ünï", "THE", "the"]
    shares = 1 / np.arange(1, len(words) + 1)
    docs = [
        (int(draw.integers(0, 90)), " ".join(draw.choice(words, draw.integers(0, 30), p=shares / shares.sum())))
        for _ in range(120)
    ]
    # a third of all rows are copies; null, empty and long texts; rows without an id
    docs += [(i, "the w1 w2 copy") for i in range(60)] + [(7, None), (8, ""), (None, "w1 w2"), (None, None)]
    docs += [(99, " ".join(f"w{i % 500}" for i in range(50_000)))]
    items = [(i, " ".join(draw.choice(words, 6))) for i in range(8)]
    items += [(1, "w1 w1 w2"), (1, "w1 w1 w2"), (2, None), (3, "unheard of"), (None, "copy w3"), (9, "")]
    assert searched(spark, docs, items) == brute_search(docs, items, 10)


def test_search_of_empty_tables(spark):
    assert searched(spark, [], [(1, "a")]) == []
    assert searched(spark, [(1, "a")], []) == []
    assert searched(spark, [(1, None)], [(1, "a")]) == []


def test_ball_bounds_hold():
    draw = np.random.default_rng(5)
    for _ in range(20):
        dense = draw.integers(1, 10**6, (150, 30)) * (draw.random((150, 30)) < 0.3)
        dense[:, 0] = 7  # no empty row
        dense[50:90] = dense[50]
        r, c = np.nonzero(dense)
        rows = ls.Sparse(np.searchsorted(r, np.arange(151)), c, dense[r, c])
        tree = ls.BallTree(rows, 30, leaf=4)
        assert sorted(tree.order) == list(range(150))
        wanted = np.sort(draw.choice(30, 5, replace=False))
        asked = np.zeros(30, dtype=np.int64)
        asked[wanted] = 1
        up, scores = tree.bounds(wanted, asked), dense[tree.order] @ asked
        for node, (start, end) in enumerate(tree.spans):
            assert up[node] >= scores[start:end].max()


def brute_negatives(rows, k_pos=5, k_neg=5):
    kept = {}
    for i, v, label in rows:
        ok = i is not None and label is not None and v is not None
        if ok and all(x is not None and math.isfinite(x) for x in v):
            kept[(i, label, tuple(v))] = (i, label, [math.floor(256 * x) for x in v])
    rows = list(kept.values())
    out = []
    for a, a_label, av in rows:
        if a % 100:
            continue
        scored = [
            (-sum(x * y for x, y in zip(av, v)), i, label)
            for i, label, v in rows
            if i != a and len(v) == len(av)
        ]
        for ps, p in sorted((s, i) for s, i, label in scored if label == a_label)[:k_pos]:
            fits = sorted(
                (s, i)
                for s, i, label in scored
                if label != a_label and 80 * -ps <= 100 * -s <= 100 * -ps
            )
            out += [(a, p, r, i, -ps, -s) for r, (s, i) in enumerate(fits[:k_neg], 1)]
    return sorted(out)


def mined(spark, rows, tile_rows):
    df = spark.createDataFrame(
        [(*r, "x", 1) for r in rows],
        "vec_id long, embedding array<float>, label int, slab string, hash int",
    )
    found = hn.hard_negatives(df.filter("vec_id % 100 = 0"), df, tile_rows=tile_rows)
    return sorted(tuple(r) for r in found.collect())


@pytest.mark.parametrize("tile_rows", [40, 100_000])
def test_negatives_equal_brute_force(spark, monkeypatch, tile_rows):
    monkeypatch.setattr(hn, "ANCHOR_ROWS", 2)
    draw = np.random.default_rng(4)
    rows = [
        (i, [float(x) for x in draw.normal(size=6).astype(np.float32)], int(draw.integers(0, 3)))
        for i in range(350)
    ]
    # a third of all vectors are one vector; repeated rows; rows that take no part
    rows += [(1000 + i, rows[100][1], i % 3) for i in range(170)] + rows[:20]
    rows += [
        (2000, None, 1),
        (2100, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1),
        (2200, [float("nan")] * 6, 1),
        (2300, [float("inf")] + [0.0] * 5, 1),
        (2400, rows[0][1], None),
        (None, rows[0][1], 1),
        (2500, [1.0, 2.0], 1),
        (2501, [1.0, 2.0], 1),
        (2502, [1.0, 1.9], 2),
        (2600, [], 1),
        (2601, [], 1),
        (2602, [], 2),
        (2700, [0.0] * 6, 1),
    ]
    assert mined(spark, rows, tile_rows) == brute_negatives(rows)


def test_negatives_of_huge_components_and_of_nothing(spark):
    rows = [(0, [3e9, 1.0], 1), (1, [2e9, 1.0], 1), (2, [1.9e9, 5.0], 2), (3, [1e9, 0.0], 2)]
    most = 2**63 - 1
    assert mined(spark, rows, 10) == [(0, 1, 1, 2, most, most), (0, 1, 2, 3, most, most)]
    rows = [(0, [1e7, 1.0], 1), (1, [9e6, 1.0], 1), (2, [8e6, 5.0], 2), (3, [1e6, 0.0], 2)]
    assert mined(spark, rows, 10) == brute_negatives(rows)
    assert mined(spark, [], 10) == []


def test_packed_boxes_hold_their_rows():
    draw = np.random.default_rng(6)
    points = draw.integers(-300, 300, (1000, 5)).astype(float)
    labels = draw.integers(0, 4, 1000)
    tree = hn.Tree(points, labels, leaf=16, fanout=4)
    assert sorted(tree.order) == list(range(1000))
    anchors = draw.integers(-300, 300, (7, 5)).astype(float)
    low, high = tree.intervals(anchors, np.float64)

    def rows_below(node):
        start, end = tree.spans[node]
        if node < tree.leaves:
            return list(range(start, end))
        return [r for child in range(start, end) for r in rows_below(child)]

    assert rows_below(len(tree.spans) - 1) == list(range(1000))
    for node in range(len(tree.spans)):
        scores = anchors @ tree.points[rows_below(node)].T
        assert (low[:, node] <= scores.min(axis=1)).all() and (high[:, node] >= scores.max(axis=1)).all()


def test_quality_holds_out_of_sample(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = (
        QUERIES["op12_fourier_quality"](spark, "/root/testdata/sf0.01").join(labels, "doc_id").toPandas()
    )
    assert rows["score"].between(0, 1).all()
    assert (rows["predicted"] == (rows["score"] >= 0.3)).all()
    out = rows[rows["held_out"]]
    assert len(out) > 30 and (out["predicted"] == out["quality"]).mean() > 0.95


def test_quality_does_not_learn_from_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    stats = ql.measured(docs)
    usable = ~ql.held_out(F.col("doc_id"))
    turned = labels.withColumn(
        "quality", F.when(ql.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality"))
    )
    a, b = ql.train(stats, labels, usable), ql.train(stats, turned, usable)
    assert np.allclose(a.weights, b.weights, atol=1e-9)


def test_normal_equations_and_calibration(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    stats = ql.measured(docs).repartition(5)
    model = ql.train(stats, labels, F.lit(True))
    rows = (
        stats.join(labels, "doc_id")
        .filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(ql.FOLDS)) > 0)
        .toPandas()
    )
    x, y = np.array(rows["stats"].tolist()), rows["quality"].to_numpy(float)
    z, weight = model.features(x), y / y.sum() + (1 - y) / (len(y) - y.sum())
    whole = np.linalg.solve((z * weight[:, None]).T @ z + ql.RIDGE * np.eye(ql.FEATURES), z.T @ (weight * y))
    assert np.allclose(z @ whole, model.raw(x), atol=1e-5)
    steps = model.score(np.array(x)[np.argsort(model.raw(x))])
    assert (np.diff(steps) >= 0).all()


def test_random_features_approximate_the_kernel():
    model = ql.Model(np.zeros(20), np.ones(20), None, None, 0.5)
    draw = np.random.default_rng(8)
    x = draw.normal(size=(40, 20))
    z = model.features(x)[:, 1:]
    away = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    assert np.abs(z @ z.T - np.exp(-away / (2 * ql.WIDTH**2))).max() < 0.25


def test_isotonic_equals_brute_force():
    draw = np.random.default_rng(9)
    for _ in range(30):
        n = int(draw.integers(1, 30))
        counts = draw.integers(1, 5, n).astype(float)
        sums = np.floor(counts * draw.random(n))
        pools = ql.isotonic(np.arange(n), sums, counts)
        fitted = np.concatenate([[s / c] * int(last - first + 1) for s, c, first, last in pools])
        means = [
            max(
                min(sums[a : b + 1].sum() / counts[a : b + 1].sum() for b in range(i, n))
                for a in range(i + 1)
            )
            for i in range(n)
        ]
        assert np.allclose(fitted, means)


def test_quality_of_odd_rows(spark, odd_documents):
    stats = ql.measured(odd_documents)
    labels = spark.createDataFrame(
        [(1, 1), (1, 0), (2, 1), (4, 0), (5, 0), (6, 1), (7, None), (None, 1)], "doc_id long, quality int"
    )
    model = ql.train(stats, labels, F.lit(True))
    rows = stats.select("doc_id", ql.scorer(model)("stats").alias("score")).collect()
    assert len(rows) == odd_documents.count()
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (1, 2)}) == 1
    for none in (labels.filter("false"), labels.filter("quality = 1 AND doc_id = 2")):
        base = ql.train(stats, none, F.lit(True))
        assert len({r[0] for r in stats.select(ql.scorer(base)("stats")).collect()}) == 1
    assert ql.measured(odd_documents.filter("false")).count() == 0
