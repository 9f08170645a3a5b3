"""Pairwise quality, hard negatives and vector codes against plain versions and held-out labels."""

import hashlib
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtext.llm import codebooks, negatives, quality, queries, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, code string, block int, id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, y, "own", 3, "x") for i, v, y in rows], SCHEMA).repartition(3)


def odd_rows(n, seed, dims=16):
    """Copies, near copies, ties, repeated ids, null labels, and rows that drop."""
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((6, dims)) * 0.4
    rows = []
    for i in range(n):
        v = base[i % 6] + rng.standard_normal(dims) * 0.1
        if i % 4 == 0:
            v = base[0]
        rows.append((i, [float(np.float32(x)) for x in v], None if i % 11 == 3 else int(rng.integers(0, 4))))
    rows += [(20, rows[20][1], rows[20][2]), (33, rows[7][1], 1), (-5, rows[3][1], 0), (None, rows[4][1], 2)]
    rows += [(1000, None, 1), (1001, [float("nan")] * dims, 1), (1002, [None] * dims, 1), (1003, [float("inf")] * dims, 0), (1004, [1.0], 0), (1005, [0.0] * dims, 2)]
    return rows


def usable(v, dims=16):
    return v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)


def plain_lloyd(rows, parts, entries, rounds, scale):
    d = [(i, [math.floor(scale * x) for x in v], y) for i, v, y in rows if usable(v)]
    w = len(d[0][1]) // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    first = sorted(range(len(d)), key=lambda k: (d[k][0] is None, d[k][0] or 0, [x for x in d[k][1]]))[:entries]
    books = [[cut(d[k][1], p) for k in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for r in range(rounds + 1):
        got = [[min(range(len(books[p])), key=lambda e: (far(cut(v, p), books[p][e]), e)) for p in range(parts)] for _, v, _ in d]
        if r == rounds:
            break
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [cut(v, p) for (_, v, _), g in zip(d, got) if g[p] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    error = [sum(far(cut(v, p), books[p][g[p]]) for p in range(parts)) for (_, v, _), g in zip(d, got)]
    by = {}
    for (_, _, y), e in zip(d, error):
        by[y] = by.get(y, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{x:02x}" for x in g), e, by[y], digest) for (i, _, y), g, e in zip(d, got, error)), key=repr)


@pytest.mark.parametrize("scale,salted", [(4096, False), (40_000_000, True)])
def test_codes_are_those_of_plain_rounds(spark, monkeypatch, scale, salted):
    """Also where distances exceed what doubles hold exactly, over many small blocks, and with sums that meet by shuffle."""
    monkeypatch.setattr(vectors, "BLOCK_CELLS", 16 * 37)
    if salted:
        monkeypatch.setattr(codebooks, "LABELS", 0)
    rows = odd_rows(300, 5)
    got = codebooks.code_table(frame(spark, rows), parts=4, entries=7, rounds=4, scale=scale)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_lloyd(rows, 4, 7, 4, scale)


def test_heaps_spare_scans_and_codes_decode(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((16, 16))
    rows = [(i, (centres[i % 16] + rng.standard_normal(16) * 0.02).astype(np.float32).tolist(), 0) for i in range(3000)]
    coded, found = codebooks.fit_codes(frame(spark, rows))
    assert found.rescanned[0] == 3000 * 8 and sum(found.rescanned[1:]) < 0.5 * 6 * 3000 * 8
    r = coded.where("vec_id = 77").first()
    assert np.abs(np.array(found.decode(r["code"])) - rows[77][1]).max() < 0.15


def test_codes_of_few_and_none(spark):
    assert codebooks.code_table(frame(spark, [])).count() == 0
    assert codebooks.code_table(frame(spark, [(1, None, 1), (2, [], None)])).count() == 0
    got = codebooks.code_table(frame(spark, [(7, [0.5, 1e30], None), (7, [0.5, 1e30], None), (8, [-0.5, 0.0], None)])).collect()
    assert sorted((r.vec_id, r.code, r.error, r.label_error) for r in got) == [(7, "00" * 8, 0, 0), (7, "00" * 8, 0, 0), (8, "0000000200000002", 0, 0)] or len({r.label_error for r in got}) == 1


def plain_negatives(rows, scale=256, k_pos=5, k_neg=10):
    d = [(i, [math.floor(scale * x) for x in v], y) for i, v, y in rows if usable(v) and i is not None and y is not None]
    out = []
    for a, (ai, av, ay) in enumerate(d):
        if ai % 10:
            continue
        s = [(-sum(x * y for x, y in zip(av, v)), i, y) for b, (i, v, y) in enumerate(d) if b != a]
        for ps, pi, _ in sorted(x for x in s if x[2] == ay)[:k_pos]:
            fit = sorted((n, i) for n, i, y in s if y != ay and 30 * -ps <= 100 * -n <= 90 * -ps)[:k_neg]
            out += [(ai, pi, r, i, -ps, -n) for r, (n, i) in enumerate(fit, 1)]
    return sorted(out)


@pytest.mark.parametrize("scale,buckets", [(256, 64), (50_000_000, 16)])
def test_negatives_are_those_of_brute_force(spark, monkeypatch, scale, buckets):
    """Also with scores past what doubles hold, several chunks and blocks, few anchors at once, ties told apart by id and many digits."""
    monkeypatch.setattr(vectors, "BLOCK_CELLS", 16 * 41)
    monkeypatch.setattr(negatives, "CHUNK_CELLS", 16 * 13)
    monkeypatch.setattr(negatives, "TOGETHER", 7)
    monkeypatch.setattr(negatives, "BUCKETS", buckets)
    rows = odd_rows(240, 8)
    got = negatives.mine(frame(spark, rows), F.col("vec_id") % 10 == 0, scale=scale)
    assert sorted(tuple(r) for r in got.collect()) == plain_negatives(rows, scale)


def test_negatives_among_thousands_of_copies(spark):
    """More rows of the k-th score than are gathered: told apart by id; and one id a thousand times."""
    up, side = [1.0, 0.0], [0.5, 0.5]
    rows = [(100, up, 0), (1, up, 0)] + [(1000 + i, side, 1) for i in range(3000)] + [(-(2**62), side, 1), (2**62, side, 1)]
    got = negatives.mine(frame(spark, rows), F.col("vec_id") == 100).orderBy("rank").collect()
    assert [r.negative_id for r in got] == [-(2**62), *range(1000, 1009)] and {r.positive_id for r in got} == {1}
    rows = [(100, up, 0), (1, up, 0)] + [(5, side, 1)] * 2000
    got = negatives.mine(frame(spark, rows), F.col("vec_id") == 100).collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 11)) and {r.negative_id for r in got} == {5}


def test_negatives_of_few_and_none(spark):
    every = F.col("vec_id") >= 0
    assert negatives.mine(frame(spark, []), every).count() == 0
    assert negatives.mine(frame(spark, [(1, None, 1), (2, [1.0], None)]), every).count() == 0
    assert negatives.mine(frame(spark, [(1, [1.0], 1), (2, [0.5], 2)]), every).count() == 0
    assert negatives.mine(frame(spark, [(1, [-1.0], 1), (2, [1.0], 1), (3, [0.5], 2)]), every).collect() == []


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in queries.op11_pairwise_quality(spark, sf).collect()}
    docs = {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()}
    assert set(got) == docs and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    held = [(got[r.doc_id], r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 500 and all(r.held_out for r, _ in held)
    bad, good = [r.score for r, y in held if not y], [r.score for r, y in held if y]
    wins = np.mean([[g > b for g in good] for b in bad])
    right = np.mean([r.predicted == y for r, y in held])
    print("pairs ranked right", wins, "labels right", right)
    assert wins > 0.99 and right > 0.98
    assert np.mean([r.predicted for r, y in held if y]) > 0.99


def test_quality_learns_only_from_its_rows(spark):
    """The worth of a text depends on nothing but the text; labels outside ``learn`` change nothing."""
    texts = [f"Word after word it goes on, line {i} of many.\nAnd it ends here." for i in range(40)] + [f"$$ {i} %% ## junk!! || " * 5 for i in range(20)]
    docs = spark.createDataFrame([(i, t, "s", 0.5) for i, t in enumerate(texts)], "doc_id long, text string, features string, score double")
    marks = [(i, int(i < 40)) for i in range(60)]
    label = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int")
    learn = F.col("doc_id") % 3 != 0
    one = {r.doc_id: r.score for r in quality.rate(docs, label(marks), learn=learn).collect()}
    two = {r.doc_id: r.score for r in quality.rate(docs, label([(i, y if i % 3 else 1 - y) for i, y in marks]), learn=learn).collect()}
    assert all(abs(one[i] - two[i]) < 1e-9 for i in one)
    assert min(one[i] for i in range(40)) >= 0.3 > max(one[i] for i in range(40, 60))


def test_quality_against_plain_newton(spark):
    """The distributed steps find the minimum of the penalised loss over the pairs named in the docstring."""
    rng = np.random.default_rng(3)
    x = np.abs(rng.standard_normal((90, quality.FEATURES))).astype(np.float32)
    y = (x[:, 0] + 0.7 * rng.standard_normal(90) > 0.9).astype(int)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    f = spark.createDataFrame(rows, "doc_id long, features array<float>").repartition(3)
    m = quality.fit(f, spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "doc_id long, quality int"))
    h = {tuple(r.features): r.h for r in f.select("features", F.xxhash64(F.lit(7), "features").alias("h")).collect()}
    rare = int(y.sum() < len(y) - y.sum())
    few = sorted((v.tolist() for v, k in zip(x, y) if k == rare), key=lambda v: (h[tuple(v)], v))
    diffs = np.array([(1 if not rare else -1) * (v.astype(float) - np.array(few[((h[tuple(v.tolist())] % 2**64) >> (16 * k)) % len(few)])) for v, k2 in zip(x, y) if k2 != rare for k in range(quality.PAIRS)])
    slope = -(1 / (1 + np.exp(diffs @ m.weights))) @ diffs / len(diffs) + quality.PENALTY * m.weights
    assert np.abs(slope).max() < 1e-6


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (1, ""), (None, "a"), (2, " \n\t "), (3, "x" * 300_000), (4, "\x00퟿😀")], "doc_id long, text string")
    for marks, want in (([], 0.5), ([(2, 1)], 1.0), ([(2, 0), (3, None), (None, 1)], 0.0)):
        got = quality.rate(docs, spark.createDataFrame(marks, "doc_id long, quality int")).collect()
        assert len(got) == 6 and {r.score for r in got} == {want} and {r.predicted for r in got} == {int(want >= 0.3)}
    got = quality.rate(docs, spark.createDataFrame([(2, 0), (2, 1), (3, 0), (1, 0)], "doc_id long, quality int"))
    assert got.columns == ["doc_id", "score", "predicted"] and all(0 <= r.score <= 1 for r in got.collect())
    assert quality.rate(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int")).count() == 0
