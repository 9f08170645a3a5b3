"""Fixtures: functions against literals, and properties that hold for any text."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomtext.functions import sql, tables
from loomtext.functions import text as X
from loomtext.operators import trees
from loomtext.operators.sequence import Chain, Restorer
from loomtext.operators.training import fasttext_hash

ABBR = frozenset(a.lower() for a in tables.ABBREVIATIONS)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("", []),
        (" \n ", []),
        ("Xin chào. Tôi là A.", ["Xin chào.", "Tôi là A."]),
        ("Giá 1.500.000 đồng. Rẻ!", ["Giá 1.500.000 đồng.", "Rẻ!"]),
        ("Ông A. B. tới. Dr. X đi?!  Ừ", ["Ông A. B. tới.", "Dr. X đi?!", "Ừ"]),
        ("Và... rồi. Thế...  Hết", ["Và... rồi.", "Thế...", "Hết"]),
        ("Dòng một\ndòng hai", ["Dòng một\ndòng hai"]),
        ("hết ...", ["hết ..."]),
    ],
)
def test_sentences(text, want):
    assert X.split_sentences(text, ABBR) == want


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab A.?!…1 \n\tđ", max_size=60))
def test_sentences_keep_all_letters(text):
    squeeze = lambda s: "".join(s.split())
    assert squeeze("".join(X.split_sentences(text, ABBR))) == squeeze(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab A.?!-1/_ \n@:đ'&=>", max_size=60))
def test_tokens_keep_all_but_space(text):
    assert "".join("".join(t for t, _ in X.tokenize(text)).split()) == "".join(text.split())


def test_token_classes():
    got = dict(X.tokenize("Xem http://a.vn/x?y=1 a@b.vn 02/05/2014 100,000 3x4 :) H&M => e-mail 4K 03-5730-2357"))
    assert got == {"Xem": "word", "http://a.vn/x?y=1": "url", "a@b.vn": "email", "02/05/2014": "datetime", "100,000": "number", "3x4": "special", ":)": "emoji", "H&M": "abbr", "=>": "special", "e-mail": "abbr", "4K": "name", "03-5730-2357": "phone"}
    assert X.tokenize("a+b", ("a+b",)) == [("a+b", "fixed_words")]


def test_no_tone_twice(spark):
    d = spark.createDataFrame([("Đường đi khó, khó vì ngăn sông CÁCH NÚI",)], "s string").withColumn("a", X.remove_tone("s")).withColumn("b", X.remove_tone("a"))
    r = d.first()
    assert r.a == r.b == "Duong di kho, kho vi ngan song CACH NUI"


def test_ngrams(spark):
    d = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "w array<string>")
    assert [r[0] for r in d.select(X.word_ngrams(F.col("w"), 1, 3)).collect()] == [["a", "b", "c", "a b", "b c", "a b c"], ["a"], []]
    d = spark.createDataFrame([("ab",), ("abcd",)], "s string")
    assert [r[0] for r in d.select(X.char_ngrams("s")).collect()] == [["ab"], ["abc", "bcd"]]


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_partitions_change_nothing(spark, parts):
    from loomtext.operators import lexicon as L

    rows = [(i, f"w{i % 7} x{i % 3} y") for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    assert [tuple(r) for r in L.vocabulary(L.frequencies(L.tokens(d)), 2).orderBy("id").collect()] == [(0, "<pad>", None), (1, "<unk>", None)] + [(k + 2, w, n) for k, (w, n) in enumerate(sorted([(f"w{j}", len([i for i in range(60) if i % 7 == j])) for j in range(7)] + [(f"x{j}", 20) for j in range(3)] + [("y", 60)]))]


def test_chain_decoding_beats_all_labellings():
    from itertools import product

    m = Chain([("a", "X", 1.0), ("a", "Y", 0.9), ("b", "Y", 0.4), ("c", "X", 0.3)], [("X", "X", -1.0), ("Y", "X", 0.5)])
    feats = [["a"], ["b", "zz"], ["c"], ["a"]]
    tags, score = m.decode(feats)
    e, at = m.emissions(feats), {y: k for k, y in enumerate(m.labels)}
    value = lambda ys: sum(e[t, at[y]] for t, y in enumerate(ys)) + sum(m.trans[at[a], at[b]] for a, b in zip(ys, ys[1:]))
    assert abs(value(tags) - score) < 1e-12
    assert all(value(ys) <= score + 1e-12 for ys in product(m.labels, repeat=4))
    p = m.marginals(feats)
    assert abs(p.sum(axis=1) - 1).max() < 1e-12
    assert m.decode([]) == ([], 0.0)


def test_restorer():
    r = Restorer.of({"hoa": 1, "hòa": 9, "bình": 8, "binh": 1, "<num>": 3}, {("hòa", "bình"): 8})
    assert r.restore("Hoa BINH, 30 hoà http://x.y") == "Hòa BÌNH, 30 hoà http://x.y"
    assert r.restore("") == "" and r.restore(None) is None


def test_restorer_against_dictionaries(spark):
    """A model read from tables restores as one that looks words and pairs up in dictionaries and weighs every chain."""
    import math
    import random
    from itertools import product

    from loomtext.functions import text as X
    from loomtext.operators import sequence as S

    rng = random.Random(3)
    words = ["a", "à", "á", "la", "là", "lá", "du", "dû", "ou", "où", "x", "y"]
    uni = {w: rng.randint(1, 40) for w in words}
    bi = {(a, b): rng.randint(1, min(uni[a], 9)) for a in words for b in words if rng.random() < 0.4}
    model = S.restorer(spark.createDataFrame(list(uni.items()), "w string, n int"), spark.createDataFrame([(a, b, n) for (a, b), n in bi.items()], "w1 string, w2 string, n int"))
    plain = str.maketrans(*X._tone_pairs())
    variants = {}
    for w in sorted(uni):
        variants.setdefault(w.translate(plain), []).append(w)
    total, size = sum(uni.values()), len(uni)
    p = lambda w: (uni.get(w, 0) + 1) / (total + size)
    step = lambda a, b: math.log(0.8 * (bi[a, b] / uni[a] if (a, b) in bi else 0) + 0.2 * p(b))
    texts = [" ".join(rng.choice(["a", "la", "du", "ou", "x", "q", "là"]) for _ in range(rng.randint(1, 7))) for _ in range(60)]
    got = {r.t: r.o for r in S.restore_marks(spark.createDataFrame([(t,) for t in texts], "t string"), model, "t", "o").collect()}
    score = lambda c: math.log(p(c[0])) + sum(step(a, b) for a, b in zip(c, c[1:]))
    for t in texts:
        every = product(*[[w] if w != w.translate(plain) else variants.get(w, [w]) for w in t.split()])
        assert abs(score(got[t].split()) - max(map(score, every))) < 1e-9


def test_trees_against_all():
    from itertools import product

    import numpy as np

    rng = np.random.default_rng(1)

    def ok(h):
        if sum(x == 0 for x in h) != 1:
            return False
        for i in range(1, len(h) + 1):
            seen, v = set(), i
            while v:
                if v in seen:
                    return False
                seen.add(v)
                v = h[v - 1]
        return True

    def flat(h):
        a = [(min(x, i), max(x, i)) for i, x in enumerate(h, 1)]
        return not any(p < r < q < s for p, q in a for r, s in a)

    for n in (1, 2, 3, 4):
        for _ in range(15):
            s = rng.standard_normal((n + 1, n + 1)) * 3
            all_ = [h for h in product(range(n + 1), repeat=n) if ok(h)]
            value = lambda h: sum(s[i, x] for i, x in enumerate(h, 1))  # noqa: B023, E731
            assert abs(value(trees.mst(s)[1:]) - max(map(value, all_))) < 1e-9
            assert abs(value(trees.eisner(s)[1:]) - max(value(h) for h in all_ if flat(h))) < 1e-9


def test_decoder_goldens():
    s = [[-11.9436, -13.1464, -6.4789, -13.8917], [-60.6957, -60.2866, -48.6457, -63.8125], [-38.1747, -49.9296, -45.2733, -49.5571], [-19.7504, -23.9066, -9.9139, -16.2088]]
    assert trees.mst(s) == [0, 2, 0, 2]
    s = [[-13.5026, -18.3700, -13.0033, -16.6809], [-36.5235, -28.6344, -28.4696, -31.6750], [-2.9084, -7.4825, -1.4861, -6.8709], [-29.4880, -27.6905, -26.1498, -27.0233]]
    assert trees.eisner(s) == [0, 2, 0, 2]


def test_hashes():
    assert fasttext_hash(b"hello") == 0x4F9F2CAB
    assert fasttext_hash(b"") == 2166136261
    assert fasttext_hash("é".encode()) != fasttext_hash(b"e")


def test_sql_functions(spark):
    sql.register(spark)
    r = spark.sql("SELECT vi_remove_tone('Hà Nội') a, strip_marks('Đà Nẵng') b, sent_tokenize('A đi. Rồi về.') c, regex_tokenize('đi, về') d").first()
    assert (r.a, r.b, r.c, r.d) == ("Ha Noi", "Da Nang", ["A đi.", "Rồi về."], ["đi", ",", "về"])
    got = spark.sql("SELECT t.token, t.cls FROM VALUES ('Giá 3,5') AS d(text), LATERAL tokens(d.text) t").collect()
    assert [tuple(x) for x in got] == [("Giá", "word"), ("3,5", "number")]

    def shout(x: str) -> str:
        return x.upper() + "!"

    sql.register_function(spark, shout)
    assert spark.sql("SELECT shout('a')").first()[0] == "A!"
    assert sql.sql_type(list[int]) == "array<bigint>" or sql.sql_type(list[int]) == "array<long>"
    assert sql.ascii_table([["a", 1]], ["x", "yy"]).splitlines()[3] == "| a | 1  |"


def test_files(spark, tmp_path):
    from loomtext.sources import corpora as C

    (tmp_path / "one.txt").write_text("a\n\nb")
    (tmp_path / "x.conll").write_text("a\tN\nb\tV\n\n\nc\tN\n")
    assert sorted((r.doc_id, r.line_no, r.line) for r in C.read_text_folder(spark, str(tmp_path), "*.txt").collect()) == [("one", 0, "a"), ("one", 1, ""), ("one", 2, "b")]
    assert sorted(r.body for r in C.read_blocks(spark, str(tmp_path / "x.conll")).collect()) == ["a\tN\nb\tV", "c\tN"]
    (tmp_path / "v.txt").write_text("a 1 2.5\n")
    assert C.read_embeddings(spark, str(tmp_path / "v.txt")).first().vector == [1.0, 2.5]
    d = spark.createDataFrame([("k", ["x", "y"])], "doc_id string, lines array<string>")
    C.write_text_folder(d, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 2


def test_search_and_links(spark):
    from loomtext.operators import knowledge as K

    d = spark.createDataFrame([("a", "# Tiêu đề\nXin chào các bạn"), ("b", "không")], "name string, text string")
    got = K.search(d, "text", ["chào", "bạn"]).collect()
    assert [(r.name, r.score) for r in got] == [("a", 2)]
    assert d.select(K.first_heading("text", F.col("name"))).first()[0] == "Tiêu đề"
    h = spark.createDataFrame([("<h1> T </h1><p>a <b>x</b> <a href=\"u\">l</a></p><ul><li>i</li></ul>&amp;<script>no</script>",)], "h string")
    assert h.select(K.html_to_markdown("h")).first()[0] == "# T\n\na **x** [l](u)\n\n- i&"


def test_likelihood_training_meets_the_gradient(spark):
    import numpy as np

    from loomtext.operators import crf

    rng = np.random.default_rng(0)
    ids, counts, gold = np.array([0, 1, 2, 0, 2]), np.array([1, 2, 2]), np.array([0, 1, 1])
    w = rng.standard_normal(3 * 2 + 4)

    def f(x):
        gs, gt = np.zeros((3, 2)), np.zeros((2, 2))
        v = crf.gradient(ids, counts, np.array([3]), gold, x[:6].reshape(3, 2), x[6:].reshape(2, 2), gs, gt)
        return v, np.concatenate([gs.ravel(), gt.ravel()])

    g = f(w)[1]
    for i in range(len(w)):
        d = np.eye(len(w))[i] * 1e-6
        assert abs((f(w + d)[0] - f(w - d)[0]) / 2e-6 - g[i]) < 1e-5
    x = crf.minimise(lambda z: (float(((z - 3) ** 4).sum()), 4 * (z - 3) ** 3), np.zeros(5), 200)
    assert np.abs(x - 3).max() < 0.1
    d = spark.createDataFrame([([["a"], ["b"]], ["X", "Y"]), ([["b"], ["a"]], ["Y", "X"])] * 4, "f array<array<string>>, y array<string>")
    m = crf.train(d, "f", "y", 0.1)
    assert m.decode([["a"], ["b"], ["a"]])[0] == ["X", "Y", "X"]


def test_fasttext_line():
    import numpy as np

    from loomtext.operators.training import fasttext_features, fasttext_predict

    ids = fasttext_features(["ab", "zz"], {"ab": 0, "</s>": 1}, 10, 3, 3, 2)
    assert ids[0] == 0 and 1 in ids and max(ids) < 12
    p = fasttext_predict(ids, np.ones((12, 2)), np.array([[1.0, 0.0], [0.0, 2.0]]), ["a", "b"], 2)
    assert [x[0] for x in p] == ["b", "a"] and abs(sum(x[1] for x in p) - 1) < 1e-12


def test_folder_tree_and_articles(spark, tmp_path):
    from loomtext.sources import corpora as C

    (tmp_path / "a" / "b").mkdir(parents=True)
    for name, text in (("x.md", "one"), ("a/y.txt", "two"), ("a/b/z.md", "three"), ("a/.hid.md", ""), ("a/w.bin", "-")):
        (tmp_path / name).write_text(text)
    tree = C.folder_tree(spark, str(tmp_path))
    top = [(r.name, r.is_dir, r.size) for r in C.list_directory(tree).collect()]
    assert top == [("a/", True, None), ("x.md", False, 3)]
    assert [r.name for r in C.list_directory(tree, "a").collect()] == ["b/", "y.txt"]
    pages = spark.createDataFrame([(1, "T", None, "t1"), (2, None, "u", None)], "id long, title string, url string, text string").coalesce(1)
    C.write_articles(pages, str(tmp_path / "out"), most=1)
    parts = sorted(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert len(parts) == 2 and parts[0].startswith('<doc id="1" url="" title="T">\nT\n\nt1\n</doc>')


def test_token_rows_leave_in_bounded_batches(spark, monkeypatch):
    """The tokens of ``tokenize``, in order, of whatever batches; a single longer text is whole."""
    monkeypatch.setattr(X, "TOKENIZED", 60)
    texts = [None, "", "of the end, de la 1.500", "word " * 50, *["a b, c."] * 30]
    d = spark.createDataFrame([(i, "k", t) for i, t in enumerate(texts)], "id int, kept string, t string").coalesce(1)
    got = sorted(tuple(r) for r in X.regex_token_rows(d, "t", ("of the", "de la")).collect())
    assert got == [(i, "k", k, t, c) for i, x in enumerate(texts) for k, (t, c) in enumerate(X.tokenize(x, ("of the", "de la")))]
    assert [r[3:] for r in got if r[0] == 2][:2] == [("of the", "fixed_words"), ("end", "word")]
