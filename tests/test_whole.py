"""Queries read whole tables and whole texts."""

import random
import re
import tracemalloc
from itertools import product

import pytest

from loomtext.operators import lexicon as L
from loomtext.operators import sequence as S
from loomtext.operators import tagger as T
from loomtext.operators.treebank import SENTENCES
from loomtext.plans import load_all
from loomtext.plans import sequences as Q
from loomtext.plans.catalog import QUERIES

load_all()

TEXTS = {
    3: " ".join(f"{'Big' if i % 3 == 0 else 'small'}{i}" for i in range(450)),
    4: "One day, we went. Then more... what? Yes!\nA line\n\n tail of 3.5 words _x",
    6: "".join(f"Line {i} holds a few words. " for i in range(40)),
    7: "",
    9: "... ?!",
    501: "An id past two hundred, with 1.500 words.",
    503: "lower start. lower again",
}


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    return d


def words(text):
    return re.findall(r"\w+", text)


def test_sentences_are_whole_texts(spark, docs):
    rows = {r.doc_id: r.sentences for r in Q.sentence_words(spark, docs).collect()}
    assert {i: [w for s in x for w in s] for i, x in rows.items()} == {i: words(t) for i, t in TEXTS.items()}
    assert [len(s) for s in rows[3]] == [450] and len(rows[6]) == 40


def test_training_rows(spark, docs):
    """Labels are the pipeline's for the whole sentence; features see both neighbours."""
    rows = [r for r in Q.training_rows(spark, docs).collect() if r.doc_id == 3]
    assert len(rows) == 1
    want = T.default_pipeline().run([words(TEXTS[3])], 2)
    assert rows[0].words == want[0][0] and rows[0].gold == want[1][0]
    low = [w.lower() for w in rows[0].words]
    assert [f[:3] for f in rows[0].feats] == [[f"T[0].lower={w}", f"T[-1].lower={a}", f"T[1].lower={b}"] for w, a, b in zip(low, ["BOS", *low], [*low[1:], "EOS"])]


@pytest.mark.parametrize("name", ["word_segment", "pos_tag", "chunk", "ner"])
def test_segmented_texts_are_whole(spark, docs, name):
    rows = QUERIES[name](spark, docs).collect()
    for i, text in TEXTS.items():
        mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.word_no)
        assert [r.word_no for r in mine] == list(range(len(mine)))
        assert "_".join(r.word for r in mine) == "_".join(words(text))


@pytest.mark.parametrize("name", ["crf_train", "crf_likelihood_train", "crf_sparse_train"])
def test_taggers_are_scored_on_all_odd_documents(spark, docs, name):
    r = QUERIES[name](spark, docs).first()
    assert r.sentences == Q.training_rows(spark, docs).where("doc_id % 2 = 1").count() == 1 + 1 + 2 and r.words > 450
    assert 0 < r.accuracy <= 1


def test_regex_tokens_of_the_whole_table(spark, docs):
    """Plain texts by brute force: numbers with a fraction, words, and single marks."""
    got = QUERIES["regex_tokens"](spark, docs).collect()
    for i in (6, 501, 503):
        mine = sorted((r for r in got if r.doc_id == i), key=lambda r: r.pos)
        want = re.findall(r"\d+(?:\.\d+)?|\w+|[^\w\s]", TEXTS[i])
        assert [r.token for r in mine] == want and [r.pos for r in mine] == list(range(len(want)))
        assert [r.cls for r in mine] == ["number" if w[0].isdigit() else "word" if w[0].isalpha() else "punct" for w in want]


def test_rule_forms(spark):
    """As a loop over rules sets them in a dictionary."""
    rules = [(1, "hoà", "hòa"), (2, "k", "không"), (3, "k", "k"), (4, "Hoà", "own"), (5, "ABc", "xYz")]
    base = {}
    for _, k, v in rules:
        base[k] = v
    want = dict(base)
    for k, v in base.items():
        want[k.capitalize()] = v.capitalize()
        want[k.upper()] = v.upper()
    got = {r.key: r.value for r in L.expand_rules(spark.createDataFrame(rules, "seq int, key string, value string")).collect()}
    assert got == want and got["k"] == "k"


def test_template_sets(spark):
    """Sizes, and the same values as the column operator gives."""
    assert [len(t) for t in (T.POS_TEMPLATES, T.CHUNK_TEMPLATES, T.NER_TEMPLATES)] == [22, 29, 31]
    rows = [(0, i, w, p) for i, (w, p) in enumerate([("Bộ", "N"), ("Công Thương", "Np"), ("xóa", "V"), ("500", "M")])]
    d = S.context_features(spark.createDataFrame(rows, "s int, i int, w string, p string"), T.NER_TEMPLATES[:28], ["w", "p"], ["s"], "i").orderBy("i").collect()
    got = T.features([[r[2] for r in rows], [r[3] for r in rows]], T.NER_TEMPLATES[:28])
    assert got == [[r[f"f{k}"] for k in range(28)] for r in d]


def test_taggers_learn_the_tagged_sentences():
    p = T.default_pipeline()
    gold = [[x.split("/") for x in s.split()] for s in SENTENCES]
    got = list(zip(*p.run([" ".join(g[0] for g in s).replace("_", " ").split() for s in gold], 4)))
    got = [list(zip(*columns)) for columns in got]
    assert [[w.replace(" ", "_") for w, *_ in s] for s in got] == [[g[0] for g in s] for s in gold]
    pairs = [(tuple(g[1:]), t[1:]) for a, b in zip(gold, got) for g, t in zip(a, b)]
    assert sum(g == t for g, t in pairs) / len(pairs) > 0.95
    names = p.run(["Bộ Công Thương xóa một tổng cục giảm nhiều đầu mối".split(), [], ["BOS"]], 4)
    assert names[3][0][:2] == ["B-ORG", "I-ORG"] and names[3][1] == [] and len(names[3][2]) == 1


def test_tags_against_one_by_one_decoding():
    """Many sentences at once as each alone, by the features as text."""
    p = T.default_pipeline()
    rng = random.Random(4)
    known = [x.split("/")[0] for s in SENTENCES for x in s.split()]
    rows = [[rng.choice([*known, "zzz", "BOS", "EOS", "9"]) for _ in range(rng.randint(0, 12))] for _ in range(60)]
    tags = [[rng.choice(["N", "V", "Np"]) for _ in r] for r in rows]
    got = p.chunk.tags([rows, tags])
    for r, g, y in zip(rows, tags, got):
        fs = T.features([r, g, ["X"] * len(r)], T.CHUNK_TEMPLATES)
        assert y == p.chunk.chain.decode(fs)[0]


def test_tags_of_a_sentence_in_blocks(monkeypatch):
    """5,000 words, decoded from block to block: as one chain over the features as text."""
    p = T.default_pipeline()
    rng = random.Random(6)
    known = " ".join(x.split("/")[0] for s in SENTENCES for x in s.split()).replace("_", " ").split()
    long = [rng.choice(known) for _ in range(5000)]
    want = p.words.chain.decode(T.features([long, ["X"] * len(long)], T.WORD_TEMPLATES))[0]
    tags = [rng.choice(["N", "V", "Np"]) for _ in long]
    chunks = p.chunk.chain.decode(T.features([long, tags, ["X"] * len(long)], T.CHUNK_TEMPLATES))[0]
    for block in (1 << 15, 1000, 7):
        monkeypatch.setattr(T, "BLOCK", block)
        assert p.words.tags([[["a"], long, [], ["b", "c"]]])[1] == want
        assert p.chunk.tags([[long], [tags]])[0] == chunks


def test_tags_of_texts_and_of_sentences(spark):
    """A text of sentences as its sentences one after another; null and empty ones have no words."""
    texts = [[["Ông", "sống", "ở", "Hà", "Nội"], [], ["Tôi", "đi", "học"]], [], None, [None, ["Mary", "read", "books"]]]
    d = T.tag(spark.createDataFrame(list(enumerate(texts)), "i int, s array<array<string>>").repartition(2), "s", 4)
    got = {r.i: [tuple(x) for x in r.tagged] for r in d.collect()}
    p = T.default_pipeline()
    for i, t in enumerate(texts):
        run = p.run([s or [] for s in t or []], 4)
        assert got[i] == [x for s in zip(*run) for x in zip(*s)]


def test_sparse_training_against_proximal_steps():
    """Weights that are zero, and all others, as plain proximal gradient descent finds them."""
    import numpy as np

    from loomtext.operators import crf

    rng = np.random.default_rng(0)
    sizes = np.array([3, 0, 1, 4, 6])
    n = int(sizes.sum())
    counts = rng.integers(0, 4, n)
    ids, gold = rng.integers(0, 5, counts.sum()), rng.integers(0, 3, n)

    def smooth(x):
        gs, gt = np.zeros((5, 3)), np.zeros((3, 3))
        v = crf.gradient(ids, counts, sizes, gold, x[:15].reshape(5, 3), x[15:].reshape(3, 3), gs, gt)
        return v + 0.05 * x @ x, np.concatenate([gs.ravel(), gt.ravel()]) + 0.1 * x

    got = crf.minimise_sparse(smooth, np.zeros(24), 0.3, 300, tol=1e-9)
    y = np.zeros(24)
    for _ in range(10_000):
        z = y - 0.02 * smooth(y)[1]
        y = np.sign(z) * np.maximum(np.abs(z) - 0.006, 0)
    assert np.abs(got - y).max() < 1e-6 and ((got == 0) == (np.abs(y) < 1e-12)).all() and 0 < (got == 0).sum() < 24


def test_gradients_against_all_labellings():
    import numpy as np

    from loomtext.operators import crf

    rng = np.random.default_rng(1)
    sizes, counts = np.array([2, 4, 1]), np.array([1, 0, 2, 1, 1, 3, 1])
    ids, gold = rng.integers(0, 3, counts.sum()), rng.integers(0, 2, 7)
    ends = np.cumsum(counts)

    def plain(x):
        s, t, at, total = x[:6].reshape(3, 2), x[6:].reshape(2, 2), 0, 0.0
        for size in sizes:
            e = [s[ids[ends[i] - counts[i] : ends[i]]].sum(axis=0) for i in range(at, at + size)]
            score = lambda p: sum(r[y] for r, y in zip(e, p)) + sum(t[a, b] for a, b in zip(p, p[1:]))  # noqa: E731, B023
            total += np.log(sum(np.exp(score(p)) for p in product(range(2), repeat=int(size)))) - score(gold[at : at + size].tolist())
            at += size
        return total

    x = rng.standard_normal(10)
    gs, gt = np.zeros((3, 2)), np.zeros((2, 2))
    assert abs(crf.gradient(ids, counts, sizes, gold, x[:6].reshape(3, 2), x[6:].reshape(2, 2), gs, gt) - plain(x)) < 1e-9
    slope = [(plain(x + 1e-5 * e) - plain(x - 1e-5 * e)) / 2e-5 for e in np.eye(10)]
    assert np.abs(np.concatenate([gs.ravel(), gt.ravel()]) - slope).max() < 1e-6


def test_gradient_by_products_is_the_one_by_logarithms(monkeypatch):
    """On sentences of many lengths and far scores; products are taken only where they can't underflow."""
    import numpy as np

    from loomtext.operators import crf

    rng = np.random.default_rng(3)
    sizes = np.array([5, 0, 1, 300, 2, 7])
    counts = rng.integers(0, 5, sizes.sum())
    ids, gold = rng.integers(0, 40, counts.sum()), rng.integers(0, 4, len(counts))
    for far in (1.0, 25.0, 1000.0):
        state, trans = rng.uniform(-far, far, (40, 4)), rng.uniform(-far, far, (4, 4))
        made, used, one = [], [], crf._scaled
        monkeypatch.setattr(crf, "_scaled", lambda *a, one=one, used=used: (used.append(1), one(*a))[1])
        for near in (200.0, 0.0):
            monkeypatch.setattr(crf, "NEAR", near)
            gs, gt = np.zeros((40, 4)), np.zeros((4, 4))
            made.append((crf.gradient(ids, counts, sizes, gold, state, trans, gs, gt), gs, gt))
        monkeypatch.setattr(crf, "_scaled", one)
        assert len(used) == (far < 100)
        for x, y in zip(*made):
            assert np.allclose(x, y, rtol=1e-9, atol=1e-8)


def test_trained_weights_are_not_copied():
    """A chain made of a weight vector is the one made of its single weights, and takes little memory besides."""
    import numpy as np

    from loomtext.operators import crf

    attrs, labels = [f"a{i}" for i in range(20_000)], [f"Y{k:02}" for k in range(15)]
    x = np.random.default_rng(1).normal(size=len(attrs) * 15 + 225)
    x[15:30] = 0
    tracemalloc.start()
    got = crf._chain(x, attrs, labels)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * x.nbytes
    few = crf._chain(np.concatenate([x[:60], x[-225:]]), attrs[:4], labels)
    state = [(a, y, x[i * 15 + k]) for i, a in enumerate(attrs[:4]) for k, y in enumerate(labels) if i != 1]
    want = S.Chain([*state, *[("", y, 0.0) for y in labels]], [(a, b, x[-225 + 15 * i + j]) for i, a in enumerate(labels) for j, b in enumerate(labels)])
    assert list(few.state) == list(want.state) and few.labels == want.labels and (few.trans == want.trans).all()
    assert all((few.state[a] == want.state[a]).all() for a in want.state) and len(got.state) == len(attrs)


def one_pass(m, rows):
    """A structured perceptron on one sentence after the other: what its weights are in the end."""
    at, k = {y: i for i, y in enumerate(m.labels)}, len(m.labels)
    for x, y in rows:
        got = m.decode(x)[0]
        for fs, g, p in zip(x, y, got):
            for f in fs if g != p else ():
                v = m.state.setdefault(f, [0.0] * k)
                m.state[f] = [w + (i == at[g]) - (i == at[p]) for i, w in enumerate(v)]
        if got != y:
            for path, sign in ((y, 1), (got, -1)):
                for a, b in zip(path, path[1:]):
                    m.trans[at[a], at[b]] += sign


def test_sentences_decoded_ahead_teach_the_same(monkeypatch):
    """One by one, or some at once up to the first wrong one; the weights' matrix grows on the way."""
    import numpy as np
    from loomtext.operators import perceptron as P

    monkeypatch.setattr(P, "ROWS", 2)
    rng = np.random.default_rng(4)
    sizes = rng.integers(0, 9, 300)
    attrs = rng.integers(0, 40, (sizes.sum(), 3)) + [0, 100, 200]
    gold = np.where(attrs[:, 0] < 14, 0, np.where(attrs[:, 1] < 120, 1, 2))
    made = []
    for ahead in ((1 << 30, 1 << 30), (1, 4), (3, 64)):
        monkeypatch.setattr(P, "AHEAD", ahead)
        m = P._Local(np.zeros((3, 3)))
        tokens = m.ids(attrs.ravel()).reshape(attrs.shape)
        for _ in range(3):
            m.learn(tokens, sizes, gold)
        made.append((m.w[: len(m.at) + 1], m.trans, m.best(tokens, sizes)))
    for w, trans, best in made[1:]:
        assert (w == made[0][0]).all() and (trans == made[0][1]).all() and (best == made[0][2]).all()
    assert (made[0][2] == gold).mean() > 0.9 and made[0][0].any() and not made[0][0][0].any()


@pytest.mark.parametrize("part", [17, 3])
def test_perceptron_weights_are_a_table(spark, monkeypatch, part):
    """As parts' passes over single sentences, mixed in memory; the weights of all attributes never come to the driver."""
    import numpy as np
    from loomtext.operators import perceptron as P

    monkeypatch.setattr(P, "PART", part)
    monkeypatch.setattr(P, "HELD", 5)
    rng = random.Random(3)
    rows = []
    for i in range(60):
        w = [rng.choice("abcdefgh") for _ in range(rng.randint(0, 9))]
        rows.append((i, [[f"w={x}", f"p={y}", *(["v"] if x in "ae" else [])] for x, y in zip(w, ["", *w])], ["V" if x in "ae" else "N" if y in "bcd" else "O" for x, y in zip(w, ["", *w])]))
    d = P.in_parts(spark.createDataFrame(rows, "id long, feats array<array<string>>, tags array<string>").coalesce(1))
    got = P.train_perceptron(d, P.F.col("feats"), "tags", 2)
    size = 1 << part
    parts = [[(x, y) for _, x, y in rows[lo : lo + size]] for lo in range(0, len(rows), size)]
    state, trans, labels = {}, np.zeros((3, 3)), ["N", "O", "V"]
    for _ in range(2):
        made = []
        for p in parts:
            m = S.Chain([*[(a, y, w) for a, v in state.items() for y, w in zip(labels, v)], *[("", y, 0.0) for y in labels]], [(a, b, trans[i, j]) for i, a in enumerate(labels) for j, b in enumerate(labels)])
            one_pass(m, p)
            made.append(m)
        names = {a for m in made for a in m.state if a}
        state = {a: np.mean([m.state.get(a, np.zeros(3)) for m in made], axis=0) for a in names}
        trans = np.mean([m.trans for m in made], axis=0)
    assert got.labels == labels and np.allclose(got.trans, trans)
    of = {r.h: r.a for r in spark.createDataFrame([(a,) for a in state], "a string").select("a", P.F.xxhash64("a").alias("h")).collect()}
    weights = {(of[r.attr], labels[r.y]): r.w for r in got.state.collect()}
    want = {(a, y): w for a, v in state.items() for y, w in zip(labels, v) if abs(w) > 1e-12}
    assert {k: round(w, 9) for k, w in weights.items() if abs(w) > 1e-12} == {k: round(w, 9) for k, w in want.items()} and len(want) > 10
    m = S.Chain([(a, y, w) for (a, y), w in weights.items()] + [("", y, 0.0) for y in labels], [(a, b, got.trans[i, j]) for i, a in enumerate(labels) for j, b in enumerate(labels)])
    tags = {r.id: r.best for r in P.decode(d, P.F.col("feats"), got, ["id"], "best").collect()}
    assert tags == {i: m.decode(x)[0] for i, x, _ in rows}


def test_sums_before_and_first_shares(spark, monkeypatch):
    """Prefix sums of groups, one of them most of the table, cut into ranges."""
    monkeypatch.setattr(L, "RANGE_SAMPLE", 40)
    monkeypatch.setattr(L, "RANGES", 8)
    rng = random.Random(2)
    rows = [(i, "hot" if i % 3 else rng.choice("ab"), rng.randint(0, 9)) for i in range(500)] + [(900, None, 4), (901, None, 2)]
    d = spark.createDataFrame(rows, "id long, g string, v int").repartition(4)
    got = {r.id: r.before for r in L.sums_before(d, "g", ["v", "id"], L.F.col("v")).collect()}
    assert got == {i: sum(w for j, h, w in rows if h == g and (w, j) < (v, i)) for i, g, v in rows}
    first = {r.id for r in L.first_share(d, "g", "id", 0.3).collect()}
    of = {g: sorted(i for i, h, _ in rows if h == g) for g in {r[1] for r in rows}}
    assert first == {i for ids in of.values() for i in ids[: int(len(ids) * 0.3)]}


def test_counts_in_a_row(spark):
    d = spark.createDataFrame([(1, "b a b a b c"), (2, ""), (3, None), (4, "x")], "doc_id long, text string")
    got = sorted(tuple(r) for r in L.document_counts(d, L.X.lower_tokens("text")).collect())
    assert got == [(1, "a", 2), (1, "b", 3), (1, "c", 1), (4, "x", 1)]


def test_vectors_are_made_in_their_rows(spark, monkeypatch):
    """As by the join with the vocabulary, without a shuffle of documents' terms; a text in one batch, however long."""
    monkeypatch.setattr(L, "COUNTED", 30)
    rng = random.Random(7)
    texts = [None if i == 7 else "" if i == 8 else "none of them" if i == 9 else " ".join(rng.choice("abcdef") for _ in range(120 if i == 30 else rng.randint(1, 20))) for i in range(40)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counts = L.document_counts(d, L.X.lower_tokens("text"), name="term", high=2)
    v = L.tfidf_vocabulary(counts, 40, 2, 0.9, 25)
    got = L.document_vectors(d, L.X.lower_tokens("text"), v, high=2)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    key = lambda rows: sorted((r.doc_id, r.feature_id, round(r.value, 9)) for r in rows)
    want = key(L.tfidf_vectors(counts, v).collect())
    assert key(got.collect()) == want and len({i for i, _, _ in want}) == 37


@pytest.mark.parametrize("case", ["frequent", "rare", "few", "dropped", "all"])
@pytest.mark.parametrize("sums", [7, 512, 1 << 19])
def test_vocabulary_by_bounds(spark, monkeypatch, case, sums):
    """As by counting all terms: also where terms are equally rare, fewer than asked for, the frequent ones dropped, or sums far fewer than terms."""
    monkeypatch.setattr(L, "BOUNDS", sums)
    monkeypatch.setattr(L, "COUNTED", 50)
    rng = random.Random(3)
    common = ["a b", "b c a", "c d", "ä é a", "d a b"]
    texts = [None, "", "a", *(" ".join(["a b c d e f"] * (case == "dropped") + [rng.choice(common) if case != "rare" and rng.random() < 0.6 else f"w{rng.randint(0, 99)}" for _ in range(rng.randint(1, 15))]) for _ in range(60))]
    d = spark.createDataFrame([(i, t if case != "few" or i < 9 else "x y") for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    top, share = {"few": 200, "all": None}.get(case, 20), 0.5 if case == "dropped" else 0.9
    want = L.tfidf_vocabulary(L.document_counts(d, L.X.lower_tokens("text"), name="term", high=2), len(texts), 2, share, top)
    got = L.document_vocabulary(d, L.X.lower_tokens("text"), len(texts), 2, share, top, high=2)
    assert got.dtypes == want.dtypes
    key = lambda v: sorted((r.feature_id, r.term, r.df, r.cf, round(r.idf, 12)) for r in v.collect())
    assert key(got) == key(want) and want.count() > (10 if case != "few" else 0)


def test_rare_terms_are_not_shuffled(spark, monkeypatch, tmp_path):
    """Of a table whose terms mostly stand once, the query names few: those whose bound reaches the count of a kept term."""
    one, folder = L._term_sums, str(tmp_path)

    def seen(*of):
        term, df, cf = one(*of)
        open(f"{folder}/{len(term)}-{random.getrandbits(60)}", "w").close()
        return term, df, cf

    monkeypatch.setattr(L, "_term_sums", seen)
    rng = random.Random(4)
    of = [rng.sample("pqrst", 3) for _ in range(40)]
    texts = [(i, " ".join(f"{rng.choice(c)}{rng.randint(0, 9)} u{i}x{j}" for j in range(300))) for i, c in enumerate(of)]
    d = f"{folder}/in"
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    monkeypatch.setattr("loomtext.plans.words.L.document_vocabulary", lambda *a, of=L.document_vocabulary, **k: of(*a[:5], 50, **k))
    got = QUERIES["tfidf_features"](spark, d)
    named = sum(int(f.name.split("-")[0]) for f in tmp_path.iterdir() if f.is_file())
    assert 40 <= len({r.feature.split("=")[0] for r in got.collect()}) <= 50 and 50 <= named < 5000


@pytest.mark.parametrize("name", ["tfidf_vectors", "tfidf_features"])
def test_vectors_of_the_table_are_not_shuffled(spark, docs, name):
    assert "Exchange" not in QUERIES[name](spark, docs)._jdf.queryExecution().executedPlan().toString()


def test_counts_are_made_of_bounded_batches(spark, monkeypatch, tmp_path):
    """Many texts come in one batch of Spark's; each part of it holds COUNTED words at most, but for a longer text."""
    made = str(tmp_path)
    one, most = L._counts, 50

    def seen(v, *rest):
        open(f"{made}/{len(v.flatten())}-{len(v)}", "w").close()
        return one(v, *rest)

    monkeypatch.setattr(L, "COUNTED", most)
    monkeypatch.setattr(L, "_counts", seen)
    rng = random.Random(5)
    texts = [None if i == 7 else " ".join(rng.choice("abcdef") for _ in range(120 if i == 30 else rng.randint(0, 20))) for i in range(60)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    for only in (None, ["b", "a c"]):
        want = []
        for i, t in enumerate(texts):
            w = (t or "").split()
            runs = w + [f"{a} {b}" for a, b in zip(w, w[1:])]
            want += [(i, r, runs.count(r)) for r in set(runs) if only is None or r in only]
        assert sorted(tuple(r) for r in L.document_counts(d, L.X.lower_tokens("text"), high=2, only=only).collect()) == sorted(want)
    sizes = [tuple(map(int, f.name.split("-"))) for f in tmp_path.iterdir()]
    assert len(sizes) > 10 and all(n <= most or texts_in == 1 for n, texts_in in sizes)


def test_tags_against_all_labellings():
    """The best labelling by trying every one, with the trained weights."""
    t = T.default_pipeline().words
    words = "Ông sống ở Hà Nội hôm nay".split()
    e = t.chain.emissions(T.features([words, ["X"] * len(words)], t.templates))
    score = lambda path: sum(e[i, y] for i, y in enumerate(path)) + sum(t.chain.trans[a, b] for a, b in zip(path, path[1:]))
    best = max(product(range(len(t.chain.labels)), repeat=len(words)), key=score)
    assert t.tags([[words]])[0] == [t.chain.labels[y] for y in best]


def test_values_are_looked_up_once_a_class(monkeypatch):
    """Words that the model doesn't know are told apart once a batch, not once a template."""
    calls = []
    for fn in ("lower", "istitle"):
        monkeypatch.setitem(T._VALUE, fn, lambda v, f=T._VALUE[fn]: calls.append(v) or f(v))
    t = T.Tagger(T.default_pipeline().pos.chain, T.POS_TEMPLATES)
    rows = [[f"w{i}x{j}" for j in range(10)] for i in range(500)]
    assert len(t.tags([rows])) == 500 and len(calls) < 5000


def test_tags_by_all_kinds_of_templates():
    """Spans of three, spans with a function, digits and capitals, values with spaces in them, unknown ones and edges: as each sentence alone."""
    templates = ["T[0].lower", "T[-1].istitle", "T[0].isdigit", "T[1].isallcap", "T[0]", "T[-1,0]", "T[-1,1]", "T[0,1].lower", "T[-2,-1][1]", "T[1,2]", "T[-3][1]", "T[2]"]
    rng = random.Random(7)
    words = ["a", "A", "b c", "B", "c d", "d", "9", "İ", "ΑΣ", "BOS", "EOS", "", " ", "a b"]
    sentence = lambda n: [(rng.choice(words), rng.choice("xyz")) for _ in range(n)]
    t = T.fit([[(*w, rng.choice("PQR")) for w in sentence(n % 7 + 1)] for n in range(60)], [*templates[:8], "T[-2,-1][2]", *templates[9:]])
    for p, k in ((t, 2), (T.fit([[(*w, rng.choice("PQR")) for w in sentence(6)] for _ in range(40)], templates), 2), (T.default_pipeline().ner, 3)):
        rows = [[[rng.choice([*words, "zz", "q r"]) for _ in range(n)] for n in (0, 1, 2, 3, 12, 5, 1, 40)] for _ in range(k)]
        rows[1:] = [[[rng.choice("xyzN") for _ in r] for r in rows[0]] for _ in rows[1:]]
        for i, got in enumerate(p.tags(rows)):
            fs = T.features([*[c[i] for c in rows], ["X"] * len(rows[0][i])], p.templates)
            assert got == p.chain.decode(fs)[0]


def test_chains_decode_many_sentences_as_each_alone(spark):
    """Ties, unknown attributes, repeated ones, tokens without any (also null) and sentences without tokens."""
    rng = random.Random(3)
    m = S.Chain([(a, y, rng.choice([-0.5, 0.1, 0.25, 0.7])) for a in "abcdef" for y in "XYZ"], [(x, y, rng.choice([0.1, 0.3])) for x in "XYZ" for y in "XYZ"])
    rows = [(i, [rng.choice([None, [], [rng.choice("abcdefgh") for _ in range(rng.randint(1, 5))]]) for _ in range(n)]) for i, n in enumerate([0, 1, 2, 7, 60, 3, 0, *range(9)])]
    got = S.decode(spark.createDataFrame(rows, "i int, feats array<array<string>>").repartition(2), m).collect()
    assert {r.i: r.tags for r in got} == {i: m.decode([t or [] for t in f])[0] for i, f in rows}


def test_values_are_asked_once_each():
    import pyarrow as pa

    class Asked(dict):
        n = 0

        def get(self, *a):
            self.n += 1
            return super().get(*a)

    at = Asked(a=3, b=0)
    assert S.places(pa.array(["a", "c", None, "b", "a"] * 50), at).tolist() == [3, -1, -1, 0, 3] * 50 and at.n <= 4


def test_vectors_summed_over_tasks(spark):
    """Vectors of several slices, of which some are zero in all tasks, and a last one that is short."""
    import numpy as np

    from loomtext.operators.summing import SLICE, summed

    length = 3 * SLICE + 5

    def part(batches):
        v = np.zeros(length)
        for b in batches:
            for x in b.column(0).to_pylist():
                v[x % 7] += x
                v[3 * SLICE + x % 5] -= 0.5
        return v

    want = np.zeros(length)
    for x in range(1000):
        want[x % 7] += x
        want[3 * SLICE + x % 5] -= 0.5
    assert (summed(spark.range(1000).repartition(9), part, length) == want).all()
    assert not summed(spark.range(0), part, length).any()


@pytest.mark.parametrize("name", ["crf_likelihood_train", "crf_sparse_train"])
def test_features_are_not_written(spark, docs, monkeypatch, name):
    from loomtext.plans import extras

    seen = []
    monkeypatch.setattr(extras, "written", lambda d: seen.append(d.columns) or d)
    QUERIES[name](spark, docs)
    assert seen == [["doc_id", "sent", "words", "gold"]]
