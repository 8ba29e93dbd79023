"""Each stage of the corpus pipeline on its own input, against a plain reading of it."""

from collections import Counter, defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from marketframe.llm.line_dedup import site_threshold

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, node string"


def frame(spark, rows):
    """``(doc_id, text, lang, source)`` rows as documents with one column more."""
    full = [(i, t, g, s, None if t is None else len(t), "n") for i, t, g, s in rows]
    return spark.createDataFrame(full, COLUMNS)


def prose(seed, n=60):
    return " ".join(f"w{(seed * 7919 + k * k * 31 + k) % 99991}" for k in range(n))


ENGLISH = "the old house stands near the river and the children play in the garden number %d"
GERMAN = "das alte haus steht neben dem fluss und die kinder spielen im garten nummer %d"


def test_stages_are_the_asked_ones():
    names = ["language", "lines", "near_duplicates", "mix", "pack"]
    assert [name for name, _ in corpus_pipeline.STAGES] == names
    assert corpus_pipeline.ORACLE_SQL is None


def test_language_keeps_recognised_documents(spark):
    rows = [(i, ENGLISH % i, "en", "a") for i in range(60)]
    rows += [(100 + i, GERMAN % i, "de", "b") for i in range(60)]
    rows += [(300, "12 34 %% 56", "en", "a"), (301, None, "en", "a"), (302, "", None, "a")]
    rows += [(None, ENGLISH % 7, None, None), (303, ENGLISH % 9, None, "c")]
    docs = frame(spark, rows)
    got = corpus_pipeline.language(spark, docs, "")
    assert got.columns == docs.columns
    assert Counter(map(tuple, got.collect())) == Counter(
        tuple(r) for r in docs.collect() if r.doc_id not in (300, 301, 302)
    )


def test_language_without_labels_keeps_all(spark):
    docs = frame(spark, [(1, "abc", None, "a"), (2, None, None, None)])
    assert corpus_pipeline.language(spark, docs, "").count() == 2


def lines_by_loop(rows, need):
    sites, first = defaultdict(set), {}
    for i, text, _, site in rows:
        for pos, line in enumerate((text or "").split("\n")):
            line = line.strip(" \t\r\x0b\x0c")
            if line:
                sites[line].add(site)
                first[line] = min(first.get(line, (i, pos)), (i, pos))
    out = {}
    for i, text, _, _ in rows:
        if text is None:
            out[i] = None
            continue
        kept = []
        for pos, line in enumerate(text.split("\n")):
            key = line.strip(" \t\r\x0b\x0c")
            if not key or len(sites[key]) < need or first[key] == (i, pos):
                kept.append(line)
        if len(kept) == len(text.split("\n")) or any(x.strip() for x in kept):
            out[i] = "\n".join(kept)
    return out


def test_lines_remove_boilerplate(spark):
    rows = []
    for i in range(30):
        text = f"own line {i}\nshared by all\n\n" + (f"shared by few\nend {i % 2}" if i < 4 else "tail")
        rows.append((i, text, "en", f"s{i % 10}" if i % 11 else None))
    rows += [(50, "shared by all", "en", "s1"), (51, None, "en", "s1"), (52, "", "en", None)]
    docs = frame(spark, rows)
    got = corpus_pipeline.lines(spark, docs, "")
    assert got.columns == docs.columns
    found = {r.doc_id: r for r in got.collect()}
    want = lines_by_loop(rows, site_threshold(docs))
    assert 50 not in want
    assert {i: r.text for i, r in found.items()} == want
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in found.values())


def test_near_duplicates_keep_one_of_each_class(spark):
    rows, group = [], {}
    for g in range(5):
        words = prose(g, 200).split()
        for c in range(4):
            near = words[:]
            if c > 1:
                near[-c] = "changed"
            rows.append((g * 10 + c, " ".join(near), "en", "a"))
            group[g * 10 + c] = g
    rows += [(None, prose(0, 200), "en", "b"), (None, prose(77), "en", "b"), (200, None, "en", "a")]
    rows += [(201, "", "en", "a"), (0, prose(0, 200), "en", "a")]
    docs = frame(spark, rows)
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    kept = got.collect()
    assert Counter(group[r.doc_id] for r in kept if r.doc_id in group) == {g: 1 for g in range(5)}
    rest = Counter((r.doc_id, r.text) for r in kept if r.doc_id not in group)
    assert rest == {(None, prose(77)): 1, (200, None): 1, (201, ""): 1}


def test_mix_meets_its_targets(spark):
    rows = [(i, prose(i, 40 + i % 50), "en", "abc"[i % 3]) for i in range(60)]
    rows += [(90, None, "en", "a"), (91, "", "en", "b")]
    docs = frame(spark, rows)
    got = corpus_pipeline.mix(spark, docs, "")
    assert got.columns == docs.columns
    size, taken = Counter(), Counter()
    texts = {i: t for i, t, _, _ in rows}
    for _, text, _, source in rows:
        size[source] += len((text or "").split())
    for r in got.collect():
        assert r.text in texts[r.doc_id] and r.n_chars == len(r.text)
        taken[r.source] += len(r.text.split())
    total = sum(size.values())
    # no source reaches three times its size here
    want = {s: total * w / 8 for s, w in zip("abc", (5, 2, 1))}
    assert all(want[s] <= 3 * size[s] for s in want)
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)


def test_pack_holds_every_token_once(spark):
    rows = [(i, prose(i, 30 + 40 * i), "en", "a") for i in range(20)]
    rows += [(100, None, None, None), (101, "", "en", "a")]
    pieces = corpus_pipeline.pack(spark, frame(spark, rows), "").collect()
    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    counts = {i: len(model.encode(t or "", add_special_tokens=False).ids) + 1 for i, t, _, _ in rows}
    found, places = defaultdict(list), defaultdict(list)
    for r in pieces:
        found[r.doc_id].append((r.start, r.length))
        places[r.sequence_id].append((r.offset, r.length))
    for spans, total in [(found[i], counts[i]) for i in counts] + [(p, None) for p in places.values()]:
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
        assert at == total or (total is None and at <= 2048)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_of_an_empty_table(spark, name, stage):
    assert stage(spark, frame(spark, [(1, "a", "en", "a")]).filter("false"), "").count() == 0


def test_run_hands_each_result_on(spark, tmp_path):
    rows = [(i, f"{ENGLISH % i} {prose(i, 40)}", "en", f"s{i % 3}") for i in range(40)]
    rows += [(60, None, "en", "s1"), (61, rows[3][1], "en", "s2")]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, str(tmp_path)).write.parquet(path)
        docs = spark.read.parquet(path)
    want = Counter(map(str, docs.collect()))
    assert Counter(map(str, corpus_pipeline.run(spark, str(tmp_path)).collect())) == want
