"""Writers, catalogues, line features and tool schemas on small fixtures; streams that go on."""

import json
from typing import Literal

import duckdb
import pytest
from pyspark.sql import functions as F

from loomtext.operators import agentlog as A
from loomtext.operators import lexicon as L
from loomtext.operators import metrics as M
from loomtext.operators import toolschema as TS
from loomtext.operators import training as TR
from loomtext.plans import load_all
from loomtext.plans.catalog import ORACLES, QUERIES
from loomtext.sources import corpora as C
from loomtext.streaming import windows as S
from tests.compare import duck_rows, spark_rows

load_all()


def brute_hash(data):
    h = 2166136261
    for b in data:
        h = ((h ^ (b - 256 if b > 127 else b) & 0xFFFFFFFF) * 16777619) % 2**32
    return h


def brute_features(words, known, buckets, low, high, ngrams):
    out = []
    for w in words:
        out += [known[w]] if w in known else []
        x = f"<{w}>"
        for n in range(low, high + 1) if w != "</s>" else ():
            for i in range(len(x) - n + 1):
                if x[i : i + n] != x or i:
                    out.append(len(known) + brute_hash(x[i : i + n].encode()) % buckets)
    ids = [known[w] for w in words if w in known]
    for i in range(len(ids)):
        h = ids[i]
        for v in ids[i + 1 : i + ngrams]:
            h = (h * 116049371 + v) % 2**64
            assert h < 2**63
            out.append(len(known) + h % buckets)
    return out + ([known["</s>"]] if "</s>" in known else [])


def test_line_features(spark):
    known = {"</s>": 0, "đi": 1, "tôi": 2, "a": 3}
    texts = ["tôi đi  chợ", "", None, "a a </s> tôi\nđi", "x" * 5000]
    d = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    for low, high, ngrams in ((2, 4, 2), (3, 6, 1), (1, 3, 2)):
        got = {r.id: r.x for r in d.select("id", TR.line_features("t", known, 97, low, high, ngrams).alias("x")).collect()}
        assert got == {i: None if t is None else brute_features(t.split(), known, 97, low, high, ngrams) for i, t in enumerate(texts)}
    kept = {5: 0, 7: 1}
    assert set(TR.fasttext_features(["tôi", "chợ"], known, 11, 2, 3, 1, kept)) <= {0, 2, 4, 5}


def test_line_features_leave_in_bounded_batches(spark, monkeypatch, tmp_path):
    """The same ids as of the column operator; a batch of Spark's is cut by ids, and pairs wrap around 64 bits with their sign."""
    monkeypatch.setattr(TR, "LINE_IDS", 300)
    known = {"</s>": 0, "đi": 2**40 + 7, "tôi": 2, "a": 3}
    texts = ["tôi đi  chợ", "", None, "a a </s> tôi\nđi", "x" * 5000, *["đi tôi đi a chợ"] * 40]
    d = spark.createDataFrame(list(enumerate(texts)), "id int, t string").coalesce(1)
    for low, high, ngrams in ((2, 4, 2), (3, 6, 1), (1, 3, 4)):
        rows = TR.line_feature_rows(d, "t", "x", known, 97, low, high, ngrams)
        assert {r.id: r.x for r in rows.collect()} == {i: None if t is None else TR.fasttext_features(t.split(), known, 97, low, high, ngrams) for i, t in enumerate(texts)}


def test_tool_schema_and_calls():
    def f(a: int, b: list[str], c: Literal["x", 1] = "x", d: int | str | None = None, e: dict[str, float] | None = None, g=object):
        """
        Does it.

        Parameters
            a - first
              line two

            e: last one
        Returns
        """
        return [a, b]

    p = TS.tool_schema(f)
    assert (p["name"], p["description"]) == ("f", "Does it.")
    q = p["parameters"]["properties"]
    assert p["parameters"]["required"] == ["a", "b"]
    assert q["a"] == {"type": "integer", "description": "first line two"}
    assert q["b"] == {"type": "array", "items": {"type": "string"}, "description": "Parameter b"}
    assert q["c"] == {"type": "string", "enum": ["x", 1], "description": "Parameter c", "default": "x"}
    assert q["d"]["type"] == "integer" and q["d"]["default"] is None
    assert q["e"]["additionalProperties"] == {"type": "number"} and q["e"]["description"] == "last one"
    assert "default" not in q["g"] and q["g"]["type"] == "string"
    tools = {"f": f}
    assert json.loads(TS.call_tool(tools, "f", '{"a": 1, "b": ["é"]}')) == [1, ["é"]]
    for name, args in (("h", "{}"), ("f", "{"), ("f", None)):
        assert "error" in json.loads(TS.call_tool(tools, name, args))


def test_conll_choices_and_blocks(spark, tmp_path):
    row = lambda i, h: "\t".join([str(i), "w", *["_"] * 4, str(h), *["_"] * 3])
    tree = lambda hs: "\n".join(row(i, h) for i, h in enumerate(hs, 1))
    d = spark.createDataFrame([(1, "# x = 1\n" + tree([2, 0, 2])), (2, tree([3, 4, 0, 3])), (3, tree([0])), (4, ""), (5, None)], "block int, body string")
    of = lambda **k: {r.block for r in C.conll_tokens(d, **k).collect()}
    assert of() == {1, 2, 3} and of(projective=True) == {1, 3} and of(shorter_than=3) == {3} and of(shorter_than=4) == {1, 3}
    C.write_blocks(d.where("block < 4").coalesce(1), str(tmp_path / "b"))
    assert sorted(r.body for r in C.read_blocks(spark, str(tmp_path / "b")).collect()) == sorted(r.body for r in d.where("block < 4").collect())


def test_small_imports(spark, tmp_path):
    d = spark.createDataFrame([(0, "a "), (1, " POS"), (2, "b"), (3, "NEG"), (4, "open")], "n int, l string")
    assert sorted(map(tuple, C.alternating(d, "n", "l").collect())) == [(0, "a", "POS"), (2, "b", "NEG")]
    t = spark.createDataFrame([(0, "♪\n la ♪ la \n\n♪♪x"), (1, None), (2, "")], "id int, t string")
    assert [r.x for r in t.orderBy("id").select(C.sung_lines("t").alias("x")).collect()] == [["la  la", "x"], None, []]
    (tmp_path / "c.yaml").write_text("A:\n  type: t\n  license: Close\n  year: 2013\nB:\n  type: t\n  license: Open\n  year: 2020\n")
    assert [(r.name, r.license) for r in C.read_catalogue(spark, str(tmp_path / "c.yaml")).collect()] == [("B", "Open"), ("A", "Close*")]
    assert [r.name for r in C.read_catalogue(spark, str(tmp_path / "c.yaml"), False).collect()] == ["B"]
    C.write_dictionary(spark.createDataFrame([("từ", "s")], "text string, source string"), str(tmp_path / "d"))
    assert [tuple(r) for r in C.read_dictionary(spark, str(tmp_path / "d")).collect()] == [("từ", "s")]
    C.write_traces(spark.createDataFrame([("1", "n")], "trace_id string, name string"), str(tmp_path / "t"))
    assert [r.name for r in C.read_traces(spark, str(tmp_path / "t")).collect()] == ["n"]


def test_checks_and_progress(spark):
    senses = spark.createDataFrame([("a", "N"), ("b", "?"), ("b", "N")], "word string, tag string")
    tags = spark.createDataFrame([("N",)], "tag string")
    assert {tuple(r) for r in L.tag_problems(senses, tags, 2).collect()} == {("b", "?", "tag")}
    assert {r.problem for r in L.tag_problems(senses, tags, 3).collect()} == {"tag", "words"}
    d = spark.createDataFrame([([[0.1, 0.9], [0.5, 0.5], [1.0, 0.0]], [0, -100, 1])], "s array<array<double>>, g array<int>")
    assert [tuple(x) for x in d.select(M.aligned(F.col("s"), F.col("g"), ["O", "B"]).alias("x")).first().x] == [("B", "O"), ("O", "B")]
    part = lambda i, s: {"id": i, "status": s}
    raws = [json.dumps({"task": "t", "subtasks": x}) for x in ([part(1, "completed"), part(2, "pending"), part(3, "pending")], [part(1, "skipped")], [])] + ["{", None]
    got = spark.createDataFrame(list(enumerate(raws)), "i int, raw string").orderBy("i").select(*A.progress("raw")).collect()
    assert [(r.next_pending, r.complete) for r in got] == [(2, False), (None, True), (None, True), (None, None), (None, None)]


def test_streams_go_on_and_drop_late_rows(spark, tmp_path):
    root = str(tmp_path)
    row = lambda k, t: (k, f"2024-01-01 {t}")
    out = None
    for rows in ([row("a", "10:00:00"), row("a", "10:01:00"), row("b", "12:00:00")], [row("c", "11:00:00"), row("d", "11:55:00"), row("b", "12:01:00")]):
        spark.createDataFrame(rows, "k string, at string").select("k", F.to_timestamp("at").alias("at")).coalesce(1).write.mode("append").parquet(f"{root}/in")
        s = S.stream_of(spark, f"{root}/in", "k string, at timestamp")
        out = S.run_to_files(S.distinct_events(s, "at", ["k"], "10 minutes"), folder=f"{root}/run")
    assert sorted(r.k for r in out.collect()) == ["a", "b", "d"]
    empty = S.stream_of(spark, f"{root}/in", spark.read.parquet(f"{root}/in").schema, file_name="none.parquet")
    assert S.run_to_files(empty.groupBy("k").count(), "complete").columns == ["k", "count"]


def test_articles_by_bytes(spark, tmp_path):
    """No file above the bound but those of one longer block; all blocks, in order."""
    import random

    from pyspark.sql import functions as F

    from loomtext.sources import corpora as C

    rng = random.Random(1)
    rows = [(i, "t" * rng.randint(0, 9), None, "é" * rng.choice([0, 3, 40, 200, 900])) for i in range(300)]
    d = spark.createDataFrame(rows, "id long, title string, url string, text string").repartition(5)
    C.write_articles_by_bytes(d, str(tmp_path / "out"), 1500)
    want = [r.value for r in C.article_blocks(d).orderBy("id").collect()]
    folders = sorted((tmp_path / "out").glob("file=*"), key=lambda p: int(p.name[5:]))
    assert [int(p.name[5:]) for p in folders] == list(range(len(folders))) and 20 < len(folders) < 300
    texts = []
    for p in folders:
        files = list(p.glob("part-*"))
        assert len(files) == 1
        texts.append(files[0].read_text())
        assert len(texts[-1].encode()) <= 1500 or texts[-1].count("<doc ") == 1
    assert "".join(texts) == "".join(want)
    assert C.file_numbers(d.where("false"), "id", F.lit(1), 10).count() == 0


def test_two_ingests_of_one_folder(spark):
    """Nothing is lost and no name is given twice, also for names that end in numbers."""
    from loomtext.operators import knowledge as K

    names = ["a.md", "a.md", "a-1.md", "a-1.md", "b", "b", "c-7.txt", "c.txt", "c.txt", "d.e.md", "-3", "a-1"]
    new = spark.createDataFrame([(i, n, f"text {i}") for i, n in enumerate(names)], "i int, name string, text string").repartition(3)
    first = K.ingested(new.select("name").where("false"), new, "i").collect()
    assert len({r.name for r in first}) == len(first) == len(names) and {r.text for r in first} == {f"text {i}" for i in range(len(names))}
    assert [r.name for r in sorted(first)][:1] == ["a.md"]
    second = K.ingested(spark.createDataFrame([(r.name,) for r in first], "name string"), new, "i").collect()
    assert len({r.name for r in first} | {r.name for r in second}) == 2 * len(names)


def test_classifier_round_trip(spark, tmp_path):
    from loomtext.operators.classifier import Settings, TextClassifier

    docs = spark.createDataFrame([(i, f"{'good fine' if i % 2 else 'bad poor'} w{i % 5} common") for i in range(40)] + [(99, None), (100, "")], "doc_id long, text string")
    labels = docs.where("doc_id < 30").selectExpr("doc_id", "IF(doc_id % 2 = 1, 'pos', 'neg') AS label")
    m = TextClassifier.fit(docs, labels, Settings(lower=True, most=50))
    m.save(str(tmp_path / "m"))
    got = TextClassifier.load(spark, str(tmp_path / "m"))
    assert got.settings == m.settings
    a, b = ({r.doc_id: (r.label, r.margin) for r in x.predict(docs).collect()} for x in (m, got))
    assert a.keys() == b.keys() == set(range(40)) and all(a[i][0] == b[i][0] and abs(a[i][1] - b[i][1]) < 1e-12 for i in a)
    assert all(y == ("pos" if i % 2 else "neg") for i, (y, _) in a.items())


@pytest.mark.parametrize("files", [1, 3])
@pytest.mark.parametrize("name", ["stream_pairs", "stream_vocabulary"])
def test_streams_of_a_file_and_of_a_folder_of_files(spark, sf, tmp_path, name, files):
    """A table is one file or a folder of files, which are read as one batch."""
    made, folder = tmp_path / "made", tmp_path / "events.parquet"
    spark.read.parquet(f"{sf}/events.parquet").repartition(files).write.parquet(str(made))
    parts = sorted(made.glob("part-*"))
    assert len(parts) == files
    if files == 1:
        parts[0].rename(folder)
    else:
        made.rename(folder)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{folder}{'/*.parquet' if files > 1 else ''}')")
    got, want = spark_rows(QUERIES[name](spark, str(tmp_path))), duck_rows(con, ORACLES[name])
    assert got == want and len(got[1]) > 3


def test_pairs_at_the_timeout_and_without_times(spark, tmp_path):
    """A start whose timeout is the watermark, to the millisecond, goes out; rows without a time don't count."""
    rows = [
        (1, "10:00:00.000123", "view"), (2, "10:00:00.000999", "view"), (3, "10:00:00.001", "view"), (4, "09:59:59.999999", "view"), (5, "11:10:00.0005", "purchase"),
        (6, None, "view"), (6, "09:00:00", "purchase"), (7, "09:00:00", "view"), (7, None, "purchase"), (8, "08:00:00", "view"), (8, "11:00:00", "purchase"), (None, "08:30:00", "view"),
    ]
    con = duckdb.connect()
    con.execute("CREATE TABLE events (user_id BIGINT, ts TIMESTAMP, event_type VARCHAR)")
    con.executemany("INSERT INTO events VALUES (?, ?::TIMESTAMP, ?)", [(u, t and f"2024-01-01 {t}", k) for u, t, k in rows])
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    got, want = spark_rows(QUERIES["stream_pairs"](spark, str(tmp_path))), duck_rows(con, ORACLES["stream_pairs"])
    assert got == want and {r[2] for r in got[1]} == {"1", "2", "4", "7", "8", "NULL"}
