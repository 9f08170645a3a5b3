"""Stages against brute force on a small table, and the whole of the small documents."""

import random
from collections import defaultdict

import pytest

import corpus_pipeline
from loomtext.llm import langid, mixing, packing, secrets, simhash

COLS = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, finish int, _id string"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    vocab = {"en": "the of and there with that which".split(), "fr": "le la des et une dans où".split()}
    rows = []
    for i in range(160):
        lang = "en" if i % 3 else "fr"
        t = " ".join(rng.choice(vocab[lang]) for _ in range(rng.randint(30, 90)))
        rows.append([i, t, lang, f"s{i % 4}"])
    for k in range(20):
        rows[100 + k][1] = rows[k][1]
        rows[130 + k][1] += f" token=abcdef{k}xyz"
    rows += [[300, None, "en", "s0"], [301, "", None, None], [302, "123 456", "fr", "s1"], [303, "!!!", "en", None]]
    rows.append(list(rows[5]))
    return spark.createDataFrame([(d, t, a, s, len(t or ""), 0.5, "own", 1, "me") for d, t, a, s in rows], COLS)


def test_stages_one_by_one(spark, docs):
    f = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_copies", "secrets", "mixing", "packing"]
    a = f["language"](spark, docs, "")
    assert a.columns == docs.columns
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in a.collect()} == {300, 301, 302, 303}
    assert {(r.score, r.spans, r["_id"]) for r in a.collect()} == {(0.5, "own", "me")}
    b = f["near_copies"](spark, a, "")
    assert b.columns == docs.columns
    groups = defaultdict(set)
    rows = a.collect()
    fps = [simhash.fingerprint(r.text) for r in rows]
    comp = list(range(len(rows)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                comp[root(i)] = root(j)
    for i, r in enumerate(rows):
        groups[root(i)].add(r.doc_id)
    assert sorted(r.doc_id for r in b.collect()) == sorted(min(g) for g in groups.values())
    c = f["secrets"](spark, b, "")
    assert c.columns == docs.columns and c.count() == b.count()
    assert c.where("text like '%token=%'").count() == 0 and c.where("n_chars <> length(text)").count() == 0
    d = f["mixing"](spark, c, "")
    assert d.columns == docs.columns
    want = {r.doc_id: r for r in mixing.mix(c).collect()}
    n = defaultdict(int)
    for r in d.collect():
        n[r.doc_id] += 1
    for k, r in want.items():
        assert abs(n.get(k, 0) * r.size - r.taken) <= r.size / 2 + 1
    e = f["packing"](spark, d, "").collect()
    tokens = defaultdict(int)
    for r in e:
        tokens[r.doc_id] += r.length
    text = {r.doc_id: r.text for r in c.collect()}
    for k, m in n.items():
        assert tokens[k] == m * (len(packing.encode([text[k]], packing.default_tokenizer())[0]) + 1)


def test_empty_stages(spark, docs):
    none = docs.where("false")
    for name, f in corpus_pipeline.STAGES:
        got = f(spark, none, "")
        assert got.count() == 0
        if name != "packing":
            assert got.columns == docs.columns


def test_nulls_everywhere(spark, docs):
    odd = spark.createDataFrame([(None, None, None, None, None, None, None, None, None), (None, "le la des et", None, None, None, None, None, None, None), (1, "le la des et", "fr", None, None, None, None, None, None)], COLS)
    for _, f in corpus_pipeline.STAGES[1:]:
        assert f(spark, odd, "").count() >= 2


def test_whole_run(spark, sf):
    got = corpus_pipeline.run(spark, sf)
    seqs = got.groupBy("sequence_id").agg({"length": "sum"}).collect()
    assert max(r[1] for r in seqs) <= packing.LENGTH
    assert got.count() > 1000 and langid.UNKNOWN and secrets.RULES
