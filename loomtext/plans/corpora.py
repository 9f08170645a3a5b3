"""Corpus formats, written and read."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext.functions import text as X
from loomtext.plans.catalog import query, table
from loomtext.sources import corpora as C


def labelled(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    labels = F.array(F.concat(F.lit("q"), F.col("quality").cast("string")), F.concat(F.lit("t"), F.col("toxic").cast("string")))
    return d.select("doc_id", C.format_labelled(labels, F.col("text")).alias("line"))


@query("SELECT d.doc_id, '__label__q' || quality || ' __label__t' || toxic || ' ' || text AS line FROM documents d JOIN labels l USING (doc_id)")
def fasttext_label_format(spark, sf_dir):
    return labelled(spark, sf_dir)


@query("SELECT d.doc_id, 'q' || quality || ',t' || toxic AS labels, '  ' || text AS text FROM documents d JOIN labels l USING (doc_id)")
def fasttext_label_parse(spark, sf_dir):
    p = labelled(spark, sf_dir).select("doc_id", *C.parse_labelled("line"))
    return p.select("doc_id", F.array_join("labels", ",").alias("labels"), "text")


@query(r"""
WITH w AS (SELECT item_id, list_filter(string_split_regex(replace(text, 'th', '_'), '\s+'), lambda x: x <> '') AS w FROM benchmark),
p AS (SELECT item_id, k, list_filter(string_split(w[k], '_'), lambda x: x <> '') AS p FROM w, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS k))
SELECT item_id, p[j] AS token, CASE WHEN j = 1 THEN 'B-W' ELSE 'I-W' END AS tag, count(*) AS n FROM p, LATERAL (SELECT unnest(range(1, len(p) + 1)) AS j) GROUP BY ALL""")
def underscore_to_bio(spark, sf_dir):
    d = table(spark, sf_dir, "benchmark").select("item_id", F.replace("text", F.lit("th"), F.lit("_")).alias("t"))
    x = d.select("item_id", F.explode(C.underscore_bio("t")).alias("x")).select("item_id", "x.*")
    return x.groupBy("item_id", "token", "tag").agg(F.count("*").alias("n"))


@query(r"""
WITH t AS (SELECT item_id, regexp_extract_all(text, '[\p{L}\p{N}_]+') AS w FROM benchmark)
SELECT item_id, string_agg(k || chr(9) || w[k] || chr(9) || '_' || chr(9) || CASE WHEN length(w[k]) > 3 THEN 'N' ELSE 'E' END || repeat(chr(9) || '_', 6), chr(10) ORDER BY k) AS body FROM t, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS k) GROUP BY item_id""")
def to_conll(spark, sf_dir):
    t = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(X.simple_tokens("text")).alias("pos", "w")).withColumn("tag", F.when(F.length("w") > 3, "N").otherwise("E"))
    return C.to_conll(t, "item_id", "pos", "w", "tag")


@query(r"""
WITH t AS (SELECT item_id, regexp_extract_all(text, '[\p{L}\p{N}_]+') AS w FROM benchmark)
SELECT item_id, '<s>' || chr(10) || string_agg(w[k] || chr(9) || 'X' || chr(9) || lower(w[k]), chr(10) ORDER BY k) || chr(10) || '</s>' AS body FROM t, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS k) GROUP BY item_id""")
def vertical_text(spark, sf_dir):
    t = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(X.simple_tokens("text")).alias("pos", "w")).withColumn("tag", F.lit("X"))
    return C.vertical(t, "item_id", "pos", "w", "tag")


BLOCKS = [(1, "# sent_id = s1\n# text = Tôi đi\n1\tTôi\t_\tP\tP\t_\t2\tnsubj\t_\t_\n1-2\tx\t_\t_\t_\t_\t_\t_\t_\t_\n2\tđi\t_\tV\tV\t_\t0\troot\t_\t_"), (2, "1\tA\t_\tN\tN\t_\t0\troot\t_\t_"), (3, "x\tN\n \tV")]


def blocks(spark):
    return spark.createDataFrame(BLOCKS, "block int, body string")


@query("SELECT conv_id, string_agg('## ' || role || ' ' || turn || chr(10) || chr(10) || text || chr(10), chr(10) ORDER BY turn) AS body FROM conversations GROUP BY conv_id")
def session_markdown(spark, sf_dir):
    return C.session_markdown(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")


@query("SELECT conv_id, turn, role, text FROM conversations")
def session_parse(spark, sf_dir):
    """Sessions written as markdown and read back."""
    return C.parse_session(session_markdown(spark, sf_dir), "conv_id", "body")


@query("SELECT c.conv_id, m.turn, m.role, length(m.text)::BIGINT AS n_chars FROM (SELECT DISTINCT conv_id FROM conversations WHERE role = 'system') c JOIN conversations m USING (conv_id)")
def conversation_messages(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.join(c.where("role = 'system'").select("conv_id"), "conv_id", "left_semi").select("conv_id", "turn", "role", F.length("text").cast("long").alias("n_chars"))


@query("SELECT conv_id, count(*) AS n, sum((role = 'user')::INT)::BIGINT AS n_user, max(turn) AS last_turn FROM conversations GROUP BY conv_id")
def conversation_counts(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.sum((F.col("role") == "user").cast("long")).alias("n_user"), F.max("turn").alias("last_turn"))


@query("SELECT conv_id, left(text, 50) AS title FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE role = 'user') WHERE r = 1 AND n >= 2")
def conversation_title(spark, sf_dir):
    """The start of the first user turn, once there is a second."""
    u = table(spark, sf_dir, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("t"), F.count("*").alias("n"))
    return u.where("n >= 2").select("conv_id", F.substring("t", 1, 50).alias("title"))


@query("SELECT doc_id, lang FROM documents WHERE source = 'src3' ORDER BY doc_id LIMIT 10 OFFSET 20")
def article_page(spark, sf_dir):
    """The third page of ten of a collection."""
    return table(spark, sf_dir, "documents").where("source = 'src3'").select("doc_id", "lang").orderBy("doc_id").offset(20).limit(10)


@query("SELECT conv_id, max(turn) AS updated FROM conversations GROUP BY conv_id ORDER BY updated DESC, conv_id LIMIT 20")
def conversation_recent(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("updated")).orderBy(F.desc("updated"), "conv_id").limit(20)
