import random

import numpy as np
import xxhash

from loomtext.llm import simhash
from loomtext.llm.components import connected_components, forest

TYPES = "doc_id long, text string, fp string, component string, m int"


def plain_fingerprint(text):
    words = []
    word = b""
    for b in (text or "").encode():
        if b == 32 or 9 <= b <= 13:
            if word:
                words.append(word)
            word = b""
        else:
            word += bytes([b + 32]) if 65 <= b <= 90 else bytes([b])
    if word:
        words.append(word)
    if not words:
        return 0
    sh = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64(s, seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    comp = list(range(len(rows)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                comp[root(i)] = root(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            r = root(i)
            ids[r] = min(ids.get(r, d), d)
    return sorted((d is None, d or 0, fps[i], ids.get(root(i))) for i, (d, _) in enumerate(rows))


def rows_of(spark, rows):
    return spark.createDataFrame([(d, t, "x", "y", 1) for d, t in rows], TYPES)


def result(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.fp & (2**64 - 1), r.component) for r in df.collect())


def test_fingerprints_of_odd_texts():
    for t in (None, "", " \t\n", "one", "One two three", "a b c d", "a b c d e", "É é\x0bx y\x0c z w", "word " * 5000, "  a b c"):
        assert simhash.fingerprint(t) == plain_fingerprint(t)


def test_components_against_brute_force(spark):
    rng = random.Random(1)
    base = [[rng.choice("abcdefghijklmnop") * rng.randint(1, 4) for _ in range(rng.randint(1, 120))] for _ in range(25)]
    rows = [(None, "null id"), (900, None), (901, ""), (902, "\t"), (7, "same"), (7, "same"), (8, "same")]
    for k, w in enumerate(base):
        for c in range(4):
            v = list(w)
            for _ in range(c):
                v[rng.randrange(len(v))] = "zz"
            rows.append((100 + 4 * k + c, " ".join(v)))
    assert result(simhash.simhash_components(rows_of(spark, rows))) == brute(rows)


def test_links_at_every_distance(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = set(base)
    for b in base:
        for d in range(1, 7):
            fps.add(b ^ sum(1 << i for i in rng.sample(range(64), d)))
    fps = sorted(fps)
    signed = [(int(np.uint64(f).view(np.int64)),) for f in fps]
    links = simhash.near_links(spark.createDataFrame(signed, "fp long"))
    comp = {r.node & (2**64 - 1): r.component for r in connected_components(links).collect()}
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 4:
                assert comp[a] == comp[b]
    for r in links.collect():
        assert ((r.src ^ r.dst) & (2**64 - 1)).bit_count() <= 64
    # No component joins fingerprints that brute force keeps apart.
    par = {f: f for f in fps}

    def root(x):
        while par[x] != x:
            x = par[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 4:
                par[root(a)] = root(b)
    groups = {}
    for f in comp:
        groups.setdefault(comp[f], set()).add(root(f))
    assert all(len(g) == 1 for g in groups.values())


def test_empty_and_partitions(spark):
    assert simhash.simhash_components(rows_of(spark, [])).count() == 0
    rows = [(i, f"text of some words number {i // 3} and a few more of them") for i in range(30)]
    assert result(simhash.simhash_components(rows_of(spark, rows).repartition(7))) == result(simhash.simhash_components(rows_of(spark, rows).coalesce(1)))


def test_deduplicate_keeps_one_whole_row(spark):
    rows = [(5, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (9, "something else entirely here"), (None, "a b c d e"), (None, None)]
    got = simhash.deduplicate(rows_of(spark, rows))
    assert got.columns == ["doc_id", "text", "fp", "component", "m"]
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "", r.fp) for r in got.collect()) == [(False, 3, "a b c d e", "x"), (False, 9, "something else entirely here", "x"), (True, 0, "", "x"), (True, 0, "a b c d e", "x")]


def test_components_of_long_chains(spark):
    e = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 100), (7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(e, "src long, dst long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[200] == got[100] == 100


def test_forest():
    a, b = forest(np.array([5, 9, 9, 2]), np.array([9, 7, 7, 1]))
    assert sorted(zip(a.tolist(), b.tolist())) == [(2, 1), (7, 5), (9, 5)]


def test_crowded_prefixes_are_split_alike(spark):
    """A third of all fingerprints lies around one centre; small bounds split its prefixes among tasks and within them."""
    rng = random.Random(4)
    centre = rng.getrandbits(64)
    fps = {rng.getrandbits(64) for _ in range(60)}
    while len(fps) < 160:
        x = centre
        for b in rng.sample(range(64), rng.choice([1, 2, 6, 7, 9])):
            x ^= 1 << b
        fps.add(x)
    fps = sorted(fps)
    comp = {x: x for x in fps}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i, x in enumerate(fps):
        for y in fps[:i]:
            if (x ^ y).bit_count() <= 4:
                comp[root(x)] = root(y)
    groups = {}
    for x in fps:
        groups.setdefault(root(x), set()).add(x)
    want = sorted(sorted(g) for g in groups.values() if len(g) > 1)
    assert max(map(len, want)) > 20
    d = spark.createDataFrame([(int(np.array(x, np.uint64).view(np.int64)),) for x in fps], "fp long")
    for heavy in (simhash.HEAVY, 20_000, 500):
        found = {}
        for r in connected_components(simhash.near_links(d, heavy=heavy)).collect():
            found.setdefault(r.component, set()).add(r.node & (2**64 - 1))
        assert sorted(sorted(g) for g in found.values()) == want


def test_rows_of_one_id_are_told_apart(spark):
    """The second row of id 5 is a copy of 3's text, the other one stays; repeated rows stay once; an id's own near copies too."""
    a, b = " ".join(f"one{i}" for i in range(60)), " ".join(f"two{i}" for i in range(60))
    rows = [(3, a), (5, b), (5, a), (8, a), (9, "other words here now"), (9, "other words here now"), (10, b), (10, None), (None, a), (None, a)]
    got = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))
    want = [(3, a), (5, b), (9, "other words here now"), (10, None), (None, a), (None, a)]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
