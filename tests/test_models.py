"""Trained classifiers, binary models, label trees and second-order trees against plain versions."""

from itertools import product

import numpy as np
import pytest

from loomtext.operators import subword as SW
from loomtext.operators import training as TR
from loomtext.operators import trees as T


def toy(n, seed):
    """Sparse rows of four noisy classes; features 0 to 39."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        y = int(rng.integers(0, 4))
        ids = sorted({int(v) for v in rng.integers(0, 40, rng.integers(1, 9))} | ({y} if rng.random() < 0.8 else set()))
        rows.append((i, "abcd"[y], ids, rng.random(len(ids)).round(3).tolist()))
    return rows


def frames(spark, rows):
    x = spark.createDataFrame([(i, f, v) for i, _, ids, vs in rows for f, v in zip(ids, vs)], "doc_id long, feature_id long, value double").repartition(3)
    return x, spark.createDataFrame([(i, y) for i, y, *_ in rows], "doc_id long, label string")


def objective(w, rows, y, c):
    loss = sum(max(0.0, 1 - (1 if label == y else -1) * (w[0] + sum(w[f + 1] * v for f, v in zip(ids, vs)))) ** 2 for _, label, ids, vs in rows)
    return w @ w / 2 + c * loss


def test_support_vectors_against_the_dual_solver(spark):
    rows, c = toy(160, 3), 1.0
    got = TR.train_one_vs_rest(*frames(spark, rows), c, tol=1e-5).collect()
    for y in "abcd":
        w = np.zeros(41)
        for r in got:
            if r["class"] == y:
                w[r.feature_id + 1] = r.w
        x = [(np.array([0, *[f + 1 for f in ids]]), np.array([1.0, *vs])) for _, _, ids, vs in rows]
        dual = TR.solve_squared_hinge(x, np.array([1.0 if r[1] == y else -1.0 for r in rows]), c, tol=1e-7, rounds=5000)
        dual = np.pad(dual, (0, 41 - len(dual)))
        a, b = objective(w, rows, y, c), objective(dual, rows, y, c)
        assert abs(a - b) < 1e-6 * b


def test_support_vectors_of_few_and_none(spark):
    x, y = frames(spark, toy(5, 1))
    assert TR.train_one_vs_rest(x.limit(0), y.limit(0)).count() == 0
    one = TR.train_one_vs_rest(x, y.withColumn("label", TR.F.lit("z"))).collect()
    assert {r["class"] for r in one} == {"z"} and max(abs(r.w) for r in one) > 0


def model(rng, quantised=False, loss=SW.SOFTMAX, labels=5):
    words = {w: i for i, w in enumerate(["the", "cat", "chó", "</s>", "sat"])}
    dims, buckets = 7, 11
    dense = rng.standard_normal((len(words) + buckets, dims)).astype(np.float32)
    out = rng.standard_normal((labels if loss != SW.HIERARCHICAL else labels - 1, dims)).astype(np.float32)
    inputs = SW.Dense(dense)
    if quantised:
        book = SW.Quantiser(dims, 3, 3, 1, rng.standard_normal(3 * SW.CODES * 3).astype(np.float32))
        norms = SW.Quantiser(1, 1, 1, 1, rng.random(SW.CODES).astype(np.float32))
        inputs = SW.Quantised(rng.integers(0, 256, (len(dense), 3)).astype(np.uint8), book, rng.integers(0, 256, len(dense)).astype(np.uint8), norms)
    return SW.SubwordModel(words, [f"l{i}" for i in range(labels)], sorted(rng.integers(1, 99, labels).tolist(), reverse=True), inputs, SW.Dense(out), loss, buckets, 2, 3, 2)


@pytest.mark.parametrize("quantised", [False, True])
def test_model_files(spark, tmp_path, quantised):
    """A file is written, read through Spark, and its rows and answers agree with the matrix spelled out."""
    m = model(np.random.default_rng(5), quantised)
    path = tmp_path / ("m.ftz" if quantised else "m.bin")
    path.write_bytes(m.packed())
    got = SW.read_model(spark, str(path))
    assert (got.words, got.labels, got.counts, got.buckets, got.low, got.high, got.ngrams) == (m.words, m.labels, m.counts, 11, 2, 3, 2)
    full = np.zeros(m.inputs.shape, np.float32)
    for r in range(len(full)):
        if quantised:
            q = m.inputs.quantiser
            cells = [q.centroids[p * 256 * 3 + int(m.inputs.codes[r, p]) * 3 + j] for p in range(3) for j in range(1 if p == 2 else 3)]
            full[r] = np.array(cells) * m.inputs.norms.centroids[m.inputs.norm_codes[r]]
        else:
            full[r] = m.inputs.values[r]
    assert np.allclose(got.inputs.rows(np.arange(len(full))), full, atol=1e-6)
    texts = ["the cat sat", "", None, "chó the", "zzz zz"]
    d = SW.predict_labels(spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(2), got, k=3)
    for r in d.collect():
        if texts[r.i] is None:
            assert r.labels == []
            continue
        ids = TR.fasttext_features(texts[r.i].split(), m.words, 11, 2, 3, 2)
        s = m.outputs.values.astype(float) @ full[ids].astype(float).mean(axis=0)
        p = np.exp(s) / np.exp(s).sum()
        top = np.argsort(-p)[:3]
        assert [x.label for x in r.labels] == [m.labels[i] for i in top] and np.allclose([x.p for x in r.labels], p[top], atol=1e-5)
    with pytest.raises(ValueError):
        SW.SubwordModel.unpacked(b"\0" * 100)


def test_pruned_models_keep_their_buckets():
    m = model(np.random.default_rng(1))
    m.kept = {3: 0, 7: 1}
    assert SW.SubwordModel.unpacked(m.packed()).kept == {3: 0, 7: 1}


@pytest.mark.parametrize("n", [1, 2, 3, 9, 40])
def test_label_trees_against_all_leaves(n):
    rng = np.random.default_rng(n)
    for _ in range(20):
        counts = sorted(rng.integers(1, 50, n).tolist(), reverse=True)
        tree, out, h = SW.LabelTree([f"l{i}" for i in range(n)], counts), rng.standard_normal((max(1, n - 1), 6)) * rng.choice([0, 1, 8]), rng.standard_normal(6)
        turn = 1 / (1 + np.exp(-(out @ h)))
        score = [sum(np.log((turn[v] if right else 1 - turn[v]) + SW.EPS) for v, right in path) for path in tree.leaves()]
        for k in (1, 3, 50):
            got = tree.best(h, SW.Dense(out), k)
            want = sorted(range(n), key=lambda i: (-round(score[i], 9), i))[:k]
            assert np.allclose([p for _, p in got], np.exp([score[i] for i in want]))
            assert len({y for y, _ in got}) == len(want)
    assert SW.LabelTree([], []).best(np.ones(2), None, 3) == []


def projective(heads):
    arcs = [(min(h, d), max(h, d)) for d, h in enumerate(heads) if d]
    return not any(a < c < b < e for a, b in arcs for c, e in arcs)


def tree(heads):
    for d in range(1, len(heads)):
        seen, at = set(), d
        while at:
            if at in seen:
                return False
            seen.add(at)
            at = heads[at]
    return sum(h == 0 for h in heads[1:]) == 1


def sibling_score(heads, s, t):
    total = 0.0
    for d in range(1, len(heads)):
        h = heads[d]
        total += s[d][h]
        inner = [x for x in range(1, len(heads)) if heads[x] == h and min(h, d) < x < max(h, d)]
        if inner:
            total += t[d][h][max(inner) if d > h else min(inner)]
    return total


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6])
def test_sibling_trees_against_all_trees(n):
    rng = np.random.default_rng(n)
    every = [(0, *hs) for hs in product(range(n + 1), repeat=n) if all(h != d for d, h in enumerate(hs, 1))]
    every = [h for h in every if tree(h) and projective(h)]
    for _ in range(3 if n == 6 else 8):
        s, t = rng.standard_normal((n + 1, n + 1)), rng.standard_normal((n + 1,) * 3) * 2
        got = T.eisner_siblings(s, t)
        assert tuple(got) in every
        assert abs(sibling_score(got, s, t) - max(sibling_score(h, s, t) for h in every)) < 1e-9


def test_sibling_trees_as_a_column(spark):
    rng = np.random.default_rng(0)
    s, t = rng.standard_normal((4, 4)), rng.standard_normal((4, 4, 4))
    d = spark.createDataFrame([(1, s.tolist(), t.tolist()), (2, None, None), (3, [], [])], "i int, s array<array<double>>, t array<array<array<double>>>")
    got = {r.i: r.h for r in d.select("i", T.decode_siblings(T.F.col("s"), T.F.col("t")).alias("h")).collect()}
    assert got == {1: T.eisner_siblings(s, t), 2: None, 3: []}
