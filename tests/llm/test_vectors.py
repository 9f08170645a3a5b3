import random

import numpy as np
import pytest

from loomtext.llm import ann, rpforest

TYPES = "vec_id long, embedding array<float>, id string, score int"


def rows_of(n=300, dims=16, seed=1, copies=40):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dims)).astype(np.float32)
    x[n // 2 :] = x[: n - n // 2] + 0.12 * rng.standard_normal((n - n // 2, dims)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000 + i, x[3].tolist()) for i in range(copies)]
    rows += [(2000, None), (2001, [0.0] * dims), (2002, [float("nan")] + [1.0] * (dims - 1)), (2003, [float("inf")] + [1.0] * (dims - 1)), (2004, [1.0, None] + [1.0] * (dims - 2)), (2005, [1.0]), (2006, []), (None, x[5].tolist()), (7, x[7].tolist()), (2020, (2 * x[9]).tolist())]
    return rows


def good(rows, dims=16):
    return [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v is not None and len(v) == dims and None not in v and np.isfinite(v).all() and np.any(v)]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], TYPES)


def test_links_against_brute_force(spark):
    rows = rows_of()
    ok = good(rows)
    u = np.array([v / np.linalg.norm(v) for _, v in ok])
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    comp = list(range(len(ok)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i, j in zip(*np.nonzero(link)):
        comp[root(i)] = root(j)
    low = {}
    for k, (i, _) in enumerate(ok):
        low[root(k)] = min(low.get(root(k), i), i)
    want = sorted((i, int(link[k].sum()), low[root(k)]) for k, (i, _) in enumerate(ok))
    got = rpforest.link_table(frame(spark, rows).repartition(4), leaf=32).collect()
    assert len(got) == len(rows)
    linked = {r[0] for r in want}
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got if r.vec_id in linked) == want
    for r in got:
        assert r.kept == (r.vec_id is not None and r.vec_id == r.component_id)
        if r.vec_id not in linked:
            assert r.n_links == 0 and r.component_id == r.vec_id


@pytest.mark.parametrize("setting", ["blocks", "tiers"])
def test_links_in_deep_trees(spark, monkeypatch, setting):
    """Outer leaves far smaller than the table: recall stays, and nothing is counted twice. A heap of near copies is met in blocks."""
    monkeypatch.setattr(rpforest, "LEAST_ROWS", 64)
    rng = np.random.default_rng(8)
    x = rng.standard_normal((3000, 24))
    x[1500:2000] = x[:500] + 0.15 * rng.standard_normal((500, 24))
    if setting == "blocks":
        x[2000:] = x[7] + 0.01 * rng.standard_normal((1000, 24))
    x = x.astype(np.float32)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    want = (u @ u.T >= 0.95).sum(axis=1) - 1
    got = {r.vec_id: r.n_links for r in rpforest.link_table(frame(spark, [(i, v.tolist()) for i, v in enumerate(x)]), cells=24 * 64, leaf=32).collect()}
    assert len(got) == len(x)
    assert all(got[i] <= want[i] for i in got)
    assert sum(got.values()) >= 0.99 * want.sum() > 0


def test_few_nodes_hold_near_copies():
    rng = np.random.default_rng(2)
    x = rpforest.unit(rng.standard_normal((1, 32)) + 1e-4 * rng.standard_normal((5000, 32)))
    t = rpforest.grow(x, 64, 16, 3, rpforest.SPILL, 1)
    assert len(t.cut) == 0 and t.share.tolist() == [5000] * 3
    t = rpforest.grow(rpforest.unit(rng.standard_normal((5000, 32))), 64, 16, 3, rpforest.SPILL, 1)
    assert t.share.max() <= 64 and len(t.below) < 3 * 5000


def test_links_of_few_and_none(spark):
    assert rpforest.link_table(frame(spark, [])).count() == 0
    assert [r.n_links for r in rpforest.link_table(frame(spark, [(1, None), (2, [0.0])])).collect()] == [0, 0]
    got = rpforest.link_table(frame(spark, [(2, [1.0, 0.0]), (1, [1.0, 0.0]), (3, [0.0, 1.0])])).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


@pytest.mark.parametrize("block", [4096, 16])
def test_search_with_all_probes_is_exact(spark, monkeypatch, block):
    monkeypatch.setattr(ann, "BLOCK", block)
    rows = rows_of(n=120, copies=60)
    ok = {}
    for i, v in good(rows):
        ok[i] = v
    ids = np.array(sorted(ok))
    x = np.array([ok[i] for i in ids])
    df = frame(spark, rows)
    got = ann.nearest(df, df.where("vec_id % 20 = 0"), 20, probes=32, tables=16).collect()
    for q in [i for i in ids if i % 20 == 0]:
        s = (x * ok[q]).sum(axis=1)
        o = [k for k in np.lexsort((ids, -s)) if ids[k] != q][:20]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, len(o) + 1))
        assert [r.vec_id for r in mine] == [int(ids[k]) for k in o]
        assert np.allclose([r.score for r in mine], s[o], rtol=0, atol=1e-12)
    assert {r.query_id for r in got} <= set(ids.tolist())


def test_search_recall_on_unequal_norms(spark):
    rng = np.random.default_rng(9)
    x = (rng.standard_normal((1500, 32)) * rng.uniform(0.5, 2, (1500, 1))).astype(np.float32)
    df = frame(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    got = {(r.query_id, r.vec_id) for r in ann.nearest(df, df.where("vec_id % 20 = 0")).collect()}
    s = x.astype(float) @ x.astype(float).T
    np.fill_diagonal(s, -np.inf)
    want = {(q, int(k)) for q in range(0, 1500, 20) for k in np.argsort(-s[q])[:20]}
    assert len(got & want) / len(want) >= 0.9


@pytest.mark.parametrize("norms", ["outlier", "lognormal", "unit"])
def test_search_recall_whatever_the_norms(spark, norms):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if norms == "outlier":
        x[17] *= 100
    elif norms == "lognormal":
        x *= np.exp(rng.standard_normal((4000, 1)))
    x = x.astype(np.float32)
    df = frame(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    got = {(r.query_id, r.vec_id) for r in ann.nearest(df, df.where("vec_id % 20 = 0")).collect()}
    s = x.astype(float) @ x.astype(float).T
    np.fill_diagonal(s, -np.inf)
    want = {(q, int(k)) for q in range(0, 4000, 20) for k in np.argsort(-s[q])[:20]}
    print(norms, len(got & want) / len(want), len(got), len(want))
    assert len(got) == len(want)
    assert len(got & want) / len(want) >= 0.9


@pytest.mark.parametrize("exact", [1024, 0])
@pytest.mark.parametrize("n", [15, 21, 60])
def test_search_fills_up(spark, monkeypatch, n, exact):
    monkeypatch.setattr(ann, "EXACT", exact, raising=False)
    x = np.random.default_rng(n).standard_normal((n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = frame(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    got = ann.nearest(df, df).collect()
    assert sorted((r.query_id, r["rank"]) for r in got) == [(q, k) for q in range(n) for k in range(1, min(20, n - 1) + 1)]
    if n <= 21:
        assert {(r.query_id, r.vec_id) for r in got} == {(q, i) for q in range(n) for i in range(n) if i != q}


def test_settings_follow_the_data():
    """Near neighbours in a large table are found in fine buckets, far ones only by probing most of the coarse ones."""
    rng = np.random.default_rng(3)
    rows = rng.standard_normal((4000, 64))
    rows /= np.linalg.norm(rows, axis=1)[:, None]
    index = ann.Index(np.array([0.5]), np.array([1.0001]), np.array([10**8]), np.random.default_rng(5).choice([-1.0, 1.0], (4, 3, 3, 128)))
    near = [r + 0.02 * rng.standard_normal((20, 64)) for r in rows[:100]]
    near = [v / np.linalg.norm(v, axis=1)[:, None] for v in near]
    fine = ann.choose(index, rows, 10**8, rows[:100], near, 5 * 10**6, lambda t: 2000)
    far = ann.choose(index, rows, 10**8, rows[:100], [rows[rng.integers(0, 4000, 20)] for _ in range(100)], 5 * 10**6, lambda t: 2000)
    buckets = lambda i: np.prod([2.0 * d for d in i.hashes])
    assert buckets(fine) > buckets(far) and fine.probes[0] / buckets(fine) < 0.02 < far.probes[0] / buckets(far)


@pytest.mark.parametrize("exact", [1024, 0])
def test_search_among_extreme_norms(spark, monkeypatch, exact):
    monkeypatch.setattr(ann, "EXACT", exact)
    x = np.random.default_rng(1).standard_normal((60, 8))
    x[::3] *= 1e-160
    x[1::3] *= 1e150
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): r.vec_id for r in ann.nearest(df, df.where("vec_id = 1"), 5).collect()}
    s = x @ x[1]
    s[1] = -np.inf
    assert [got[1, r] for r in range(1, 6)] == np.argsort(-s)[:5].tolist()


def test_search_of_few_is_whole(spark):
    df = frame(spark, [(20, [1.0, 0.0]), (1, [0.5, 0.5]), (40, [0.0, 0.0]), (3, [-1.0, 0.0])] + [(2, [0.9, 0.0])] * 30)
    got = ann.nearest(df, df.where("vec_id % 20 = 0")).collect()
    assert {(r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in got} == {(20, 1, 2, 0.9), (20, 2, 1, 0.5), (20, 3, 3, -1.0)}


def test_search_of_little(spark):
    df = frame(spark, [(20, [1.0, 0.0]), (1, [0.5, 0.5]), (40, [0.0, 0.0])])
    got = ann.nearest(df, df.where("vec_id % 20 = 0")).collect()
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == {(20, 1, 1, 0.5)}
    none = frame(spark, [])
    assert ann.nearest(none, none).count() == 0
    assert ann.nearest(frame(spark, [(1, None)]), df).count() == 0


def test_hadamard_is_orthogonal():
    h = ann.hadamard(np.eye(16))
    assert np.allclose(h @ h.T, np.eye(16))
    assert random.Random(1)
