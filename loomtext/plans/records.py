"""Imports, writers, catalogues, tag checks, aligned labels, progress and tool schemas over whole tables."""

from __future__ import annotations

from typing import Literal

from pyspark.sql import functions as F

from loomtext.functions import text as X
from loomtext.operators import agentlog as A
from loomtext.operators import lexicon as L
from loomtext.operators import metrics as M
from loomtext.operators import toolschema as TS
from loomtext.operators import training as TR
from loomtext.operators.written import new_folder
from loomtext.plans.catalog import query, table
from loomtext.sources import corpora as C

SP = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
RUNS = r"regexp_extract_all(text, '[\p{L}\p{N}_]+')"


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query(f"SELECT doc_id, unnest(list_filter(list_transform(string_split(replace(text, '♪', ''), chr(10)), lambda x: trim(x, {SP})), lambda x: x <> '')) AS sentence FROM documents")
def sung_lines(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.explode(C.sung_lines("text")).alias("sentence"))


@query(f"SELECT doc_id, unnest(list_transform(string_split(trim(text, {SP}), chr(10) || chr(10)), lambda p: '__label__' || lang || ' ' || p)) AS line FROM documents")
def labelled_paragraphs(spark, sf_dir):
    """Blank-line separated texts, labelled with their document's language."""
    return C.labelled_paragraphs(docs(spark, sf_dir), "text", "lang", "doc_id")


@query("""
SELECT a.conv_id, a.turn AS line_no, trim(a.text) AS text, trim(b.text) AS label FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.turn % 2 = 0""")
def alternating_turns(spark, sf_dir):
    """Turns as lines of a file: each even one a text, the next its label."""
    return C.alternating(table(spark, sf_dir, "conversations"), "turn", "text", "conv_id")


@query(rf"SELECT doc_id, i - 1 AS pos, {RUNS}[i] AS word, string_split(text, ' ')[i] AS piece FROM (SELECT doc_id, text, unnest(range(1, least(len({RUNS}), len(string_split(text, ' '))) + 1)) AS i FROM documents)")
def positional_zip(spark, sf_dir):
    """Two cuts of a text side by side, as far as both go."""
    z = C.zipped(X.simple_tokens("text"), F.split("text", " "))
    return docs(spark, sf_dir).select("doc_id", F.posexplode(z).alias("pos", "x")).select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("x.a").alias("word"), F.col("x.b").alias("piece"))


@query("SELECT doc_id AS id, text, lang, NULL::BIGINT AS item FROM documents UNION ALL SELECT NULL, text, NULL, item_id FROM benchmark")
def stacked_splits(spark, sf_dir):
    """Two splits of which each lacks columns of the other."""
    a = docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "text", "lang")
    return C.stacked(a, table(spark, sf_dir, "benchmark").select("text", F.col("item_id").alias("item")))


@query("""
SELECT p_name AS name, p_type AS type, p_brand AS license, p_size AS year, p_partkey::VARCHAR AS directory, row_number() OVER (ORDER BY p_size DESC, p_type DESC, p_name DESC, p_partkey::VARCHAR DESC) - 1 AS place
FROM part WHERE p_brand IS DISTINCT FROM 'Brand#13'""")
def open_catalogue(spark, sf_dir):
    """Parts as a catalogue in which one brand is closed, with their places in its order."""
    p = table(spark, sf_dir, "part")
    shown = F.when(F.col("p_brand") == "Brand#13", "Close").otherwise(F.col("p_brand"))
    d = C.catalogue(p.select(F.col("p_name").alias("name"), F.col("p_type").alias("type"), shown.alias("license"), F.col("p_size").alias("year"), F.col("p_partkey").cast("string").alias("directory")))
    return L.dense_ids(d.withColumn("at", F.monotonically_increasing_id()), ["at"]).withColumnRenamed("rank", "place").drop("at")


@query("SELECT source, count(*) AS n, sum(length(b))::BIGINT AS chars FROM (SELECT source, unnest(string_split(text, chr(10))) AS b FROM documents) WHERE length(b) > 10 AND trim(b) <> '' GROUP BY source")
def joined_blocks(spark, sf_dir):
    """A folder of blocks a source, here the documents' lines, put together but for blocks of ten characters or fewer."""
    folder = new_folder(spark)
    docs(spark, sf_dir).select("source", F.concat(F.replace("text", F.lit("\n"), F.lit("\n\n")), F.lit("\n")).alias("value")).write.partitionBy("source").text(folder)
    b = C.read_blocks(spark, f"{folder}/*", over=10)
    return b.groupBy(F.regexp_extract("path", "source=([^/]+)", 1).alias("source")).agg(F.count("*").alias("n"), F.sum(F.length("body")).alias("chars"))


@query("SELECT source AS value, max(lang) AS lang FROM documents WHERE source IS NOT NULL GROUP BY source")
def reversed_index(spark, sf_dir):
    """Languages with their sources, turned around: a source's last language."""
    per = docs(spark, sf_dir).groupBy("lang").agg(F.collect_set("source").alias("sources"))
    return L.reversed_index(per, "lang", "sources", "lang")


@query(r"""
WITH w AS (SELECT DISTINCT lower(w) AS word, CASE WHEN regexp_full_match(w, '[0-9]+') THEN 'M' WHEN regexp_full_match(w, '[A-Z]+') THEN 'X' ELSE 'N' END AS tag
  FROM (SELECT unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS w FROM documents))
SELECT word, tag, 'tag' AS problem FROM w WHERE tag = 'X' UNION ALL SELECT NULL, NULL, 'words' FROM w HAVING count(DISTINCT word) < 100000""")
def tag_problems(spark, sf_dir):
    """Words with a tag that isn't allowed; and where there are under 100,000 words, that."""
    w = docs(spark, sf_dir).select(F.explode(X.simple_tokens("text")).alias("w"))
    tag = F.when(F.col("w").rlike("^[0-9]+$"), "M").when(F.col("w").rlike("^[A-Z]+$"), "X").otherwise("N")
    senses = w.select(F.lower("w").alias("word"), tag.alias("tag")).distinct()
    return L.tag_problems(senses, spark.createDataFrame([("M",), ("N",)], "tag string"), 100_000)


@query(rf"SELECT doc_id, unnest(list_transform({RUNS}, lambda w: w || '/B-' || CASE WHEN regexp_full_match(w, '[0-9]+') THEN 'M' ELSE 'N' END)) AS tagged FROM documents")
def prefixed_tags(spark, sf_dir):
    """Tags led by B-."""
    tag = lambda w: F.concat(F.lit("B-"), F.when(w.rlike("^[0-9]+$"), "M").otherwise("N"))
    return docs(spark, sf_dir).select("doc_id", F.explode(F.transform(X.simple_tokens("text"), lambda w: F.concat(w, F.lit("/"), tag(w)))).alias("tagged"))


@query(rf"""
WITH t AS (SELECT unnest({RUNS}) AS w FROM documents),
k AS (SELECT CASE WHEN length(w) % 3 = 0 THEN 'c' WHEN length(w) % 3 = 1 THEN 'a' ELSE 'b' END AS pred, CASE WHEN length(w) > 6 THEN 'c' WHEN length(w) > 3 THEN 'b' ELSE 'a' END AS gold FROM t WHERE NOT regexp_full_match(w, '[0-9]+'))
SELECT pred, gold, count(*) AS n FROM k GROUP BY ALL""")
def aligned_labels(spark, sf_dir):
    """Best-scored labels against gold ones, without the pieces that aren't scored (numbers)."""
    w = X.simple_tokens("text")
    scores = F.transform(w, lambda x: F.array(*[(F.length(x) % 3 == k).cast("double") for k in (1, 2, 0)]))
    gold = F.transform(w, lambda x: F.when(x.rlike("^[0-9]+$"), F.lit(-100)).when(F.length(x) > 6, F.lit(2)).when(F.length(x) > 3, F.lit(1)).otherwise(F.lit(0)))
    return docs(spark, sf_dir).select(F.explode(M.aligned(scores, gold, ["a", "b", "c"])).alias("x")).groupBy("x.pred", "x.gold").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, '# doc_url = ' || source || chr(10) || '# lang = ' || lang || chr(10) || array_to_string(list_transform({RUNS}, lambda w, i: i || chr(9) || w || chr(9) || lower(w)), chr(10)) AS body FROM documents WHERE len({RUNS}) > 0")
def ud_write(spark, sf_dir):
    """Documents as blocks of headers and rows."""
    header = F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).alias("value")) for n, c in (("doc_url", "source"), ("lang", "lang"))])
    rows = F.transform(X.simple_tokens("text"), lambda w, i: F.array((i + 1).cast("string"), w, F.lower(w)))
    return docs(spark, sf_dir).where(F.size(X.simple_tokens("text")) > 0).select("doc_id", C.ud_body(header, rows).alias("body"))


@query("""
SELECT doc_id, unnest(['doc_url', 'date', 'sent_id', 'text', 'type']) AS name, unnest([source, lang, doc_id::VARCHAR, replace(text, chr(10), ' '), 'bronze']) AS value FROM documents""")
def raw_ud_blocks(spark, sf_dir):
    """Raw blocks (three headers and a text) read as headers."""
    line = lambda n, c: F.concat(F.lit(f"# {n} = "), F.col(c).cast("string"))
    raw = F.concat_ws("\n", line("doc_url", "source"), line("date", "lang"), line("sent_id", "doc_id"), F.replace("text", F.lit("\n"), F.lit(" ")))
    return docs(spark, sf_dir).select("doc_id", raw.alias("raw")).select("doc_id", F.explode(C.raw_ud_headers("raw")).alias("h")).select("doc_id", "h.*")


@query(f"""
WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text FROM documents)
SELECT doc_id, count(*) AS n_blocks, sum(len({RUNS}))::BIGINT AS n_tokens FROM s WHERE len({RUNS}) BETWEEN 1 AND 19 AND NOT (len({RUNS}) >= 4 AND len({RUNS}) % 3 = 0) GROUP BY doc_id""")
def conll_short_projective(spark, sf_dir):
    """Lines of documents as blocks in which each word hangs on the one before, or, where their number is divisible by three, the first two on the third and fourth,
    whose arcs cross: those stay out, and those of 20 words or more."""
    lines = docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    n = F.size(X.simple_tokens("line"))
    head = lambda i: F.when((i < 2) & (n >= 4) & (n % 3 == 0), i + 3).otherwise(i).cast("string")
    row = lambda w, i: F.concat_ws("\t", (i + 1).cast("string"), w, *[F.lit("_")] * 4, head(i), *[F.lit("_")] * 3)
    blocks = lines.select(F.struct("doc_id", "line_no").alias("block"), F.array_join(F.transform(X.simple_tokens("line"), row), "\n").alias("body"))
    t = C.conll_tokens(blocks, projective=True, shorter_than=20).groupBy("block").agg(F.count("*").alias("n"))
    return t.groupBy(F.col("block.doc_id").alias("doc_id")).agg(F.count("*").alias("n_blocks"), F.sum("n").alias("n_tokens"))


@query("""
SELECT conv_id::VARCHAR AS task, min(turn) FILTER (role = 'assistant') AS next_pending, count(*) FILTER (role = 'assistant') = 0 AS complete FROM conversations GROUP BY conv_id""")
def progress_state(spark, sf_dir):
    """Conversations as progress files: what was asked is done, answers are pending."""
    state = F.when(F.col("role") == "assistant", "pending").when(F.col("role") == "system", "skipped").otherwise("completed")
    part = F.struct(F.col("turn").cast("int").alias("id"), F.col("text").alias("description"), state.alias("status"))
    files = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(part)).alias("subtasks"))
    raw = files.select(F.to_json(F.struct(F.col("conv_id").cast("string").alias("task"), "subtasks")).alias("raw"))
    return raw.select(*A.progress("raw")).withColumn("next_pending", F.col("next_pending").cast("long"))


@query(f"SELECT doc_id, len({RUNS}) AS n, array_to_string(list_transform({RUNS}, lambda w: '[' || lower(w) || ']'), '') AS fields FROM documents")
def field_preprocess(spark, sf_dir):
    """Tokens in small letters, each as a list of its own."""
    each = X.wrapped(X.lower_tokens("text"))
    shown = F.array_join(F.transform(each, lambda x: F.concat(F.lit("["), F.array_join(x, ","), F.lit("]"))), "")
    return docs(spark, sf_dir).select("doc_id", F.size(each).cast("long").alias("n"), shown.alias("fields"))


def frequent_words(spark, sf_dir, share: int = 100_000) -> dict[str, int]:
    """Ids of the words that make up one in ``share`` words or more, so at most that many, and of the end mark, which comes first."""
    f = docs(spark, sf_dir).select(F.explode(X.space_tokens("text")).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    f = f.join(F.broadcast(f.agg(F.sum("n").alias("all")))).where(F.col("n") * share >= F.col("all"))
    return {w: i for i, w in enumerate(["</s>", *sorted(r.w for r in f.select("w").collect())])}


@query()
def line_feature_ids(spark, sf_dir):
    """Row ids of a text's words, subwords, pairs and end: how many, and a hash of them in order."""
    d = TR.line_feature_rows(docs(spark, sf_dir).select("doc_id", "text"), "text", "ids", frequent_words(spark, sf_dir), 2_000_000, 3, 6, 2)
    return d.select("doc_id", F.size("ids").alias("n"), F.xxhash64("ids").alias("hash"))


def find_words(text: str, kind: Literal["noun", "verb"], most: int = 5, tags: list[str] | None = None, weights: dict[str, float] | None = None, exact: bool | None = False):
    """Find words.

    Args:
        text: where to look,
            in order
        kind (str): part of speech
    """


@query("""
SELECT * FROM (VALUES ('exact', 'boolean', 'Parameter exact', false), ('kind', 'string', 'part of speech', true), ('most', 'integer', 'Parameter most', false),
('tags', 'array', 'Parameter tags', false), ('text', 'string', 'where to look, in order', true), ('weights', 'object', 'Parameter weights', false)) t(name, type, description, required)""")
def tool_schema(spark, sf_dir):
    """The parameters of a function as a tool."""
    p = TS.tool_schema(find_words)["parameters"]
    rows = [(n, s["type"], s["description"], n in p["required"]) for n, s in p["properties"].items()]
    return spark.createDataFrame(rows, "name string, type string, description string, required boolean")
