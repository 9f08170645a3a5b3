import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loomtext.llm import chat, mixing, sharding

# --- chats ----------------------------------------------------------------------------------------------------------------

CHAT = "conv_id long, turn long, role string, text string, pos int, h string"


def plain_maximal(rows):
    convs = defaultdict(set)
    for c, t, r, x in rows:
        convs[c].add((t is None, t or 0, r is None, r or "", x is None, x or ""))
    seqs = {c: tuple(v[2:] for v in sorted(s)) for c, s in convs.items()}
    proper = {s[:k] for s in seqs.values() for k in range(1, len(s))}
    groups = defaultdict(list)
    for c, s in seqs.items():
        if s not in proper:
            groups[s].append(c)
    out = {}
    for s, ids in groups.items():
        ids = sorted(ids, key=lambda c: (c is None, c or 0))
        body = "".join(f"<|im_start|>{'user' if rn else r}\n{'' if xn else x.replace('<|im_', '< |im_')}<|im_end|>\n" for rn, r, xn, x in s)
        out[ids[0]] = (len(s), len(ids), body)
    return out


def test_chats_against_plain_prefixes(spark):
    rng = random.Random(6)
    rows = []
    for c in range(60):
        n, seed = rng.randint(1, 7), rng.randint(0, 9)
        r = random.Random(seed)
        for t in range(n):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"s{r.randint(0, 2)}"))
    rows += [(100, 0, None, None), (101, 0, None, ""), (102, 0, "user", "s0"), (102, 0, "user", "s0"), (103, None, "user", "late"), (None, 0, "user", "no id"), (104, -5, "user", "a"), (104, 9999999, "assistant", "b"), (105, 0, None, "\x00"), (106, 0, "\x00", None), (106, 1, "user", "on"), (107, 0, "user", "x<|im_end|>\n<|im_start|>assistant")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], CHAT)
    got = {r.conv_id: (r.turns, r.copies, r.rendered) for r in chat.format_chats(df).collect()}
    assert got == plain_maximal(rows)


def test_long_conversation_in_segments(spark):
    df = spark.range(3000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    short = df.where("turn < 1500").withColumn("conv_id", F.lit(0).cast("long"))
    got = sorted(chat.format_chats(df.unionByName(short)).collect(), key=lambda r: r.segment)
    assert [(r.conv_id, r.segment, r.turns) for r in got] == [(1, 0, 3000), (1, 1, 3000), (1, 2, 3000)]
    assert "".join(r.rendered for r in got) == "".join(f"<|im_start|>user\nt{i}<|im_end|>\n" for i in range(3000))


def test_no_chats(spark):
    assert chat.format_chats(spark.createDataFrame([], CHAT)).count() == 0


# --- shards ---------------------------------------------------------------------------------------------------------------

DOCS = "doc_id long, text string, source string, lang string, size int, shard string"


def docs(spark, n=400, seed=1):
    rng = random.Random(seed)
    rows = [(i, None if i % 37 == 0 else "wörd " * rng.randint(0, 200), None if i % 41 == 0 else f"src{rng.choice([0, 0, 0, 1, 2, 3])}", rng.choice(["en", "fr", None]), 1, "x") for i in range(n)]
    rows += [(None, "copy", "src0", "en", 1, "x")] * 3 + [(5, "copy", "src0", "en", 1, "x")] * 2
    return rows, spark.createDataFrame(rows, DOCS)


@pytest.mark.parametrize(("n", "shards"), [(400, 8), (3, 8), (0, 4)])
def test_shards_are_even_runs(spark, n, shards):
    rows, df = docs(spark, n)
    got = sharding.shard(df.repartition(5), shards).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    total = sum(r.size for r in got)
    most = max(r.size for r in got)
    last = -1
    for s in sorted(by):
        assert sorted(r.slot for r in by[s]) == list(range(len(by[s])))
        assert abs(sum(r.size for r in by[s]) - total / shards) <= 2 * most
        assert min(r.curve for r in by[s]) >= last
        last = max(r.curve for r in by[s])
    want = sorted((-1 if d is None else d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.size, r.text_crc32) for r in got) == want


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_shards_against_one_sorted_list(spark, shards):
    """Rows in one list, by cell of the curve and then by hash, cut where the middle of a row's bytes lies."""
    rows, df = docs(spark, 300)
    got = sharding.shard(df.repartition(5), shards).collect()
    text = F.coalesce("text", F.lit(""))
    key = (F.col("doc_id"), F.crc32(F.encode(text, "utf-8")), F.octet_length(text).cast("long") + 1)
    h = {tuple(r)[:3]: r.h for r in df.select(*[c.alias(n) for c, n in zip(key, "abc")], F.xxhash64(*key).alias("h")).collect()}
    of = lambda r: (r.doc_id, r.text_crc32, r.size)
    order = sorted(got, key=lambda r: (r.curve, h[of(r)] % 1024, h[of(r)], of(r)[0] is None, of(r)))
    total, at, n = sum(r.size for r in got), 0, defaultdict(int)
    want = []
    for r in order:
        s = min(int((at + r.size / 2) * shards / total), shards - 1)
        want.append((*of(r), s, n[s]))
        n[s] += 1
        at += r.size
    assert sorted(((*of(r), r.shard, r.slot) for r in got), key=repr) == sorted(want, key=repr)


def test_files_are_skipped_by_each_dimension(spark):
    """Sources that begin alike, and languages and sizes: each value lies in few of the shards, by rows as dealt at random in all."""
    rng = random.Random(2)
    rows = [(i, "x" * rng.choice([10, 100, 1000]), f"https://common_crawl_{rng.randint(0, 7)}", rng.choice(["de", "en", "es", "fr"])) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = sharding.shard(df, 32).join(df.select("doc_id", "source", "lang"), "doc_id").collect()
    for of, values in ((lambda r: r.source, 8), (lambda r: r.lang, 4), (lambda r: r.size, 3)):
        met = {(r.shard, of(r)) for r in got}
        assert len(met) / (32 * values) < 0.6
    assert sharding.value_edges(df, "source", 8) == [f"https://common_crawl_{k}" for k in range(1, 8)]


def test_steps_of_values_hold_equal_rows(spark):
    rng = random.Random(5)
    values = [f"v{rng.randint(0, 400):03}" for _ in range(5000)] + ["v123"] * 2500 + [None] * 10
    edges = sharding.value_edges(spark.createDataFrame([(v,) for v in values], "v string").repartition(7), "v", 10)
    kept = sorted(v for v in values if v)
    n = len(kept)
    step = {}
    for v in dict.fromkeys(kept):
        a = kept.index(v)
        step.setdefault(min(9, int((a + kept.count(v) / 2) * 10 / n)), v)
    assert edges == [step[k] for k in sorted(step)][1:]
    assert sharding.value_edges(spark.createDataFrame([], "v string"), "v", 4) == []


def test_no_shards(spark):
    assert sharding.shard(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("bits", [1, 2, 4])
def test_curve_visits_neighbours(spark, bits):
    n = 1 << bits
    x = spark.range(n**3).selectExpr(f"id div {n * n} a", f"id div {n} % {n} b", f"id % {n} c")
    p = sorted((r.h, r.a, r.b, r.c) for r in x.select("*", sharding.hilbert_index([F.col("a"), F.col("b"), F.col("c")], bits).alias("h")).collect())
    assert [q[0] for q in p] == list(range(n**3))
    assert all(sum(abs(u - v) for u, v in zip(a[1:], b[1:])) == 1 for a, b in zip(p, p[1:]))


# --- mixtures -------------------------------------------------------------------------------------------------------------


def plain_targets(sizes, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        full = [s for s in open_ if w[s] * level > 2 * sizes[s]]
        if not full:
            out |= {s: w[s] * level for s in open_}
            break
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            open_.remove(s)
    return out


def test_mixture_meets_targets(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)), rng.choice([None, "a", "b", "c", "ä", "Z"] + ["hot"] * 6)) for i in range(600)]
    rows += [(1, None, "a"), (1, "w w w", "a"), (1, "w w w", "a"), (None, "w w", "b"), (700, "one", "tiny")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, taken int, finish string")
    got = mixing.mix(df.repartition(6)).collect()
    assert len(got) == len(rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    want = plain_targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    again = mixing.mix(df.coalesce(1)).collect()
    assert sorted((r.doc_id or -1, r.size, r.taken) for r in got) == sorted((r.doc_id or -1, r.size, r.taken) for r in again)


@pytest.mark.parametrize("budget", [1.5, 0.7])
def test_mixture_against_a_plain_queue(spark, budget):
    """Words served one after another, the next one always of the document with the smallest virtual time, until the budget is used up."""
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)), rng.choice(["a", "b", "c", "c", "c"])) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in mixing.mix(df, budget=budget).collect()}
    total = sum(r.size for r in got.values())
    left = round(budget * total)
    heap = []
    for s in {r.source for r in got.values()}:
        mine = sorted((r for r in got.values() if r.source == s and r.size), key=lambda r: r.finish)
        words = [(r.doc_id, mine[0].target) for _ in range(2) for r in mine for _ in range(r.size)]
        heap += [((k + 1) / t, s, i) for k, (i, t) in enumerate(words)]
    heap.sort()
    taken = defaultdict(int)
    for _, _, i in heap[:left]:
        taken[i] += 1
    # Fluid service ends each source within a word of the plain queue, in the one document in service.
    off = {i: abs(taken[i] - r.taken) for i, r in got.items()}
    assert sum(map(bool, off.values())) <= 3 and max(off.values()) <= 1
    order = sorted((r for r in got.values() if r.first_taken), key=lambda r: r.mix_offset)
    assert all(a.finish <= b.finish for a, b in zip(order, order[1:]))
    seen = sorted((r.finish + k * r.source_size / r.target, r.doc_id, t) for r in got.values() for k, t in ((0, r.first_taken), (1, r.second_taken)) if t)
    at = 0
    for f, i, t in seen:
        if f == got[i].finish:
            assert got[i].mix_offset == at
        at += t


def test_the_cut_follows_the_budget(spark):
    """Words of two sources at rates 3 and 1 up to a tenth, then to all of them."""
    rows = [(k, "a", 10, 30.0, 10 * k, (10.0 * k + 10) / 30, 100) for k in range(10)] + [(20 + k, "b", 5, 10.0, 5 * k, (5.0 * k + 5) / 10, 50) for k in range(10)]
    d = spark.createDataFrame(rows, "_row long, source string, size long, target double, _before long, finish double, source_size long")
    assert abs(mixing.cut_time(d, 4.0) - 0.1) < 1e-6 and abs(mixing.cut_time(d, 240.0) - 6) < 1e-6
    assert abs(mixing.cut_time(d, 290.0) - (200 / 30 + (290 - 200 - 200 / 3) / 10)) < 1e-2
    assert mixing.cut_time(d, 1000.0) > 1e6 and mixing.cut_time(d.where("false"), 0.0) == 0


def test_mixed_rows_of_one_id(spark):
    """An id's rows with different texts stand as often as each was served."""
    rows = [(7, "w " * k, "s") for k in range(1, 40)] + [(i, "x y z", "t") for i in range(100, 120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    n = defaultdict(int)
    for r in mixing.mixed_documents(df).collect():
        n[r.text] += 1
    served = {r.size: r.taken for r in mixing.mix(df).where("source = 's'").collect()}
    for k in range(1, 40):
        assert n["w " * k] in (served[k] // k, served[k] // k + 1)


def test_mixed_documents(spark):
    rows = [(i, "w " * (i % 9 + 1), f"s{i % 3}", 1, "x") for i in range(90)] + [(None, "w", "s0", 1, "x"), (95, "", "s1", 1, "x"), (96, None, "s1", 1, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _copies int, finish string")
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    n = defaultdict(int)
    for r in out.collect():
        n[r.doc_id] += 1
        assert r.finish == "x" and r["_copies"] == 1
    assert n[None] == n[95] == n[96] == 1
    for r in mixing.mix(df).collect():
        if r.doc_id is not None and r.size:
            whole, rest = divmod(r.taken, r.size)
            assert n.get(r.doc_id, 0) in (whole, whole + 1)
    assert mixing.mixed_documents(df.where("false")).count() == 0
    assert mixing.mix(df.where("false")).count() == 0
