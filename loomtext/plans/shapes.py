"""Letters, sounds, markup, addresses of pages and logs, over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext.functions import tables as T
from loomtext.functions import text as X
from loomtext.operators import agentlog as A
from loomtext.operators import knowledge as K
from loomtext.operators import lexicon as L
from loomtext.operators import training as R
from loomtext.operators import wikitemplates as WT
from loomtext.operators import wikitext as W
from loomtext.plans.catalog import query, table
from loomtext.sources import corpora as C

WORDS = r"(SELECT DISTINCT unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS w FROM documents)"


def words(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.explode(X.simple_tokens("text")).alias("w")).distinct()


#: Capital and small letters as far as DuckDB's differ from Java's.
_UP = lambda x: f"replace(upper({x}), 'ẞ', 'SS')"


@query(f"""
SELECT w AS shape, CASE WHEN {_UP('w')} = w AND lower(w) <> w AND length(w) > 1 THEN 'HÀ' WHEN {_UP('left(w, 1)')} = left(w, 1) AND lower(left(w, 1)) <> left(w, 1) THEN 'Hà' ELSE 'hà' END AS out FROM {WORDS}""")
def match_case(spark, sf_dir):
    return words(spark, sf_dir).select(F.col("w").alias("shape"), X.match_case("w", F.lit("hà")).alias("out"))


@query(f"""
WITH x AS (SELECT DISTINCT lower(w) AS w FROM (SELECT unnest(regexp_extract_all(text, '[a-zA-Z]+')) AS w FROM benchmark)),
k AS (SELECT w, list_transform(string_split(w, ''), lambda c: nullif(strpos('{T.ALPHABET}', c), 0)) AS k FROM x)
SELECT row_number() OVER (ORDER BY k, w) - 1 AS r, w FROM k WHERE NOT list_contains(list_transform(k, lambda v: v IS NULL), true)""")
def vi_sort(spark, sf_dir):
    """Words of the alphabet's letters in its order."""
    d = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[a-zA-Z]+"), F.lit(0))).alias("w")).select(F.lower("w").alias("w")).distinct()
    d = d.withColumn("k", X.vi_sort_key("w")).where(F.forall("k", lambda v: v.isNotNull()))
    return L.dense_ids(d, ["k", "w"]).select(F.col("rank").alias("r"), "w")


_PLAIN, _WIDE = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_", "".join(chr(ord(c) + 0xFEE0) for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")
#: Letters of the documents whose width is ambiguous, which counts as full.
_AMBIGUOUS = "àáèéêíóúüß"


@query(f"SELECT translate(w, '{_PLAIN}', '{_WIDE}') AS w, regexp_full_match(w, '[{_PLAIN}{_AMBIGUOUS}]+') AS wide, w AS half FROM {WORDS}")
def full_width(spark, sf_dir):
    d = words(spark, sf_dir).select(F.translate("w", _PLAIN, _WIDE).alias("w"))
    return d.select("w", X.is_full_width("w").alias("wide"), X.half_width("w").alias("half"))


@query(rf"""
SELECT w, list_reduce(list_transform(range(1, length(hex(encode(w))) // 2 + 1), lambda i: ('0x' || hex(encode(w))[2 * i - 1 : 2 * i])::BIGINT),
  lambda h, b: xor(h, CASE WHEN b < 128 THEN b ELSE b + 4294967040 END) * 16777619 % 4294967296, 2166136261::BIGINT) AS h FROM {WORDS}""")
def fasttext_hash(spark, sf_dir):
    @F.udf("long")
    def run(w):
        return R.fasttext_hash(w.encode())

    return words(spark, sf_dir).select("w", run("w").alias("h"))


@query("SELECT label, round(sum(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x))), 6) AS l2, round(sum(list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE)))), 6) AS l1 FROM embeddings GROUP BY label")
def model_norms(spark, sf_dir):
    """Norms of each class's weights."""
    w = table(spark, sf_dir, "embeddings").select("label", F.explode(F.col("embedding").cast("array<double>")).alias("w"))
    return w.groupBy("label").agg(F.round(F.sum(F.col("w") * F.col("w")), 6).alias("l2"), F.round(F.sum(F.abs("w")), 6).alias("l1"))


@query(r"""
WITH t AS (SELECT item_id, list_transform(regexp_extract_all(text, '[a-zA-Z]+'), lambda w: lower(w)) AS w FROM benchmark)
SELECT item_id, array_to_string(list_transform(w, lambda x: CASE x WHEN 'the' THEN 'dh ax' WHEN 'and' THEN 'ae n d' ELSE array_to_string(string_split(x, ''), ' ') END), ' ') AS phones FROM t""")
def phoneme_tokens(spark, sf_dir):
    """Words by a lexicon, others letter by letter."""
    w = F.transform(F.regexp_extract_all("text", F.lit("[a-zA-Z]+"), F.lit(0)), lambda x: F.lower(x))
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(X.phonemes(w, {"the": "dh ax", "and": "ae n d"}), " ").alias("phones"))


@query()
def syllable_parts(spark, sf_dir):
    """Parts of all words that have a syllable's shape."""
    return words(spark, sf_dir).select("w", X.syllable_parts(F.lower("w")).alias("p")).where("p IS NOT NULL").select("w", "p.*")


@query()
def syllable_ipa(spark, sf_dir):
    return words(spark, sf_dir).select("w", X.syllable_ipa(F.lower("w"), eight=True).alias("ipa"))


@query()
def rhymes(spark, sf_dir):
    return words(spark, sf_dir).select("w", X.rhyme(F.lower("w")).alias("rhyme")).where("rhyme IS NOT NULL")


@query()
def social_preprocess(spark, sf_dir):
    return X.with_social_preprocess(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "out").select("doc_id", "out")


@query()
def fixed_word_tokens(spark, sf_dir):
    """Tokens of all texts, two of whose word pairs are kept together."""
    return X.regex_token_rows(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", ("of the", "de la"))


# --- markup -------------------------------------------------------------------------------------------------------------------


@query("SELECT p_partkey AS id, p_name || ' is ' || p_type || '.' || chr(10) || 'one ' || p_size || chr(10) || p_brand AS text FROM part")
def wiki_plain_text(spark, sf_dir):
    bold = F.concat(F.lit("'''"), F.col("p_name"), F.lit("''' is [["), F.col("p_brand"), F.lit("|"), F.col("p_type"), F.lit("]].{{Infobox|a={{b}}}}<ref>x</ref>\n"))
    rest = F.concat(F.lit("* one "), F.col("p_size").cast("string"), F.lit("\n* [http://a.b "), F.col("p_brand"), F.lit("]\n[[File:x.jpg|thumb|[[y]] z]]"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(bold, rest).alias("markup")).select("id", W.wiki_text("markup").alias("text"))


TEMPLATES = {"greet": "Hello {{{1|you}}}<noinclude>doc</noinclude>", "outer": "{{greet|{{{name}}}}}!"}


@query("""
SELECT p_partkey AS id, 'Hello ' || p_name || ' Hello ' || p_brand || '! ' || CASE WHEN p_size % 2 = 1 THEN 'odd' ELSE 'even' END || ' ' || upper(p_type) || ' ' || (2 * p_size + 1) || ' ' || lpad(p_size::VARCHAR, 3, '0')
 || ' ' || CASE p_size % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'one' ELSE 'more' END AS text FROM part""")
def wiki_templates(spark, sf_dir):
    size = F.col("p_size").cast("string")
    markup = F.concat(
        F.lit("{{Greet|"), F.col("p_name"), F.lit("}} {{outer|name="), F.col("p_brand"), F.lit("}} {{#ifeq:"), (F.col("p_size") % 2).cast("string"), F.lit("|1|odd|even}} {{uc:"), F.col("p_type"),
        F.lit("}} {{#expr: 2 * "), size, F.lit(" + 1}} {{padleft:"), size, F.lit("|3|0}} {{#switch:"), (F.col("p_size") % 3).cast("string"), F.lit("|0=none|1=one|more}}"),
    )
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), markup.alias("markup")).select("id", WT.expand_templates("markup", TEMPLATES).alias("text"))


@query("""
SELECT p_partkey AS id, '2401.' || lpad(p_partkey::VARCHAR, 5, '0') AS paper_id, CASE WHEN p_size % 2 = 0 THEN 'Title: ' || p_name ELSE '2401.' || lpad(p_partkey::VARCHAR, 5, '0') END AS title,
 CASE WHEN p_size % 2 = 0 THEN p_brand || ', C. D.' ELSE '' END AS authors, CASE WHEN p_size % 2 = 0 THEN p_type ELSE '' END AS abstract FROM part""")
def paper_metadata(spark, sf_dir):
    html = F.concat(F.lit('<h1 class="title mathjax"><span>Title:</span>'), F.col("p_name"), F.lit('</h1><div class="authors"><a>'), F.col("p_brand"), F.lit('</a>, <a>C. D.</a></div><blockquote class="abstract">\n'), F.col("p_type"), F.lit("</blockquote>"))
    url = F.concat(F.lit("https://arxiv.org/abs/2401."), F.lpad(F.col("p_partkey").cast("string"), 5, "0"))
    d = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), url.alias("url"), F.when(F.col("p_size") % 2 == 0, html).otherwise("<p>x</p>").alias("html"))
    got = d.select("id", *K.paper_fields("url", "html"))
    return got.withColumn("title", F.trim(F.regexp_replace("title", r"\s+", " "))).withColumn("abstract", F.trim(F.regexp_replace("abstract", r"\s+", " ")))


@query("""
WITH c AS (SELECT c_custkey AS id, lower(c_mktsegment) AS a, c_custkey % 3 > 0 AS post FROM customer)
SELECT id, CASE WHEN post THEN a END AS account, CASE WHEN post THEN id::VARCHAR END AS post_id, CASE WHEN post THEN a || '-' || id || '.md' END AS file_name FROM c""")
def post_metadata(spark, sf_dir):
    url = F.concat(F.lit("https://x.com/"), F.lower("c_mktsegment"), F.when(F.col("c_custkey") % 3 > 0, F.concat(F.lit("/status/"), F.col("c_custkey").cast("string"), F.lit("?s=1"))).otherwise(""))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), url.alias("url")).select("id", *K.post_fields("url"))


# --- logs ---------------------------------------------------------------------------------------------------------------------


@query("""
SELECT event_id, CASE WHEN event_id % 4 < 3 THEN user_id END AS input_tokens, CASE WHEN event_id % 4 < 3 THEN event_id END AS output_tokens,
 CASE event_id % 4 WHEN 0 THEN 3 * user_id WHEN 1 THEN user_id + event_id WHEN 2 THEN 5 END AS total_tokens FROM events""")
def extract_usage(spark, sf_dir):
    """Answers of several providers' shapes, and one without."""
    shapes = [
        F.format_string('{"usage":{"prompt_tokens":%d,"completion_tokens":%d,"total_tokens":%d}}', "user_id", "event_id", F.col("user_id") * 3),
        F.format_string('{"usage":{"input_tokens":%d,"output_tokens":%d}}', "user_id", "event_id"),
        F.format_string('{"usageMetadata":{"promptTokenCount":%d,"candidatesTokenCount":%d,"totalTokenCount":5}}', "user_id", "event_id"),
        F.lit("{}"),
    ]
    e = table(spark, sf_dir, "events").select("event_id", F.get(F.array(*shapes), (F.col("event_id") % 4).cast("int")).alias("raw"))
    return e.select("event_id", *A.usage("raw"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 3 THEN props ELSE '{}' END AS args, CASE WHEN event_id % 4 IN (1, 2) THEN 'not a JSON object' END AS error FROM events")
def json_args_edges(spark, sf_dir):
    """Arguments that are empty, a list, broken, or as they are."""
    raw = F.get(F.array(F.lit(""), F.concat(F.lit("["), F.col("props"), F.lit("]")), F.concat(F.lit("{"), F.col("props")), F.col("props")), (F.col("event_id") % 4).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", raw.alias("raw")).select("event_id", *A.tool_arguments("raw"))


@query("SELECT user_id, 'session_' || max(event_id) AS latest FROM events GROUP BY user_id")
def latest_handoff(spark, sf_dir):
    """By number, not by name."""
    d = table(spark, sf_dir, "events").select("user_id", F.concat(F.lit("session_"), F.col("event_id").cast("string")).alias("name"))
    return A.latest_numbered(d, "name", "user_id").withColumnRenamed("name", "latest")


@query("SELECT conv_id, to_json(list(struct_pack(role := role, content := coalesce(text, '')) ORDER BY turn))::VARCHAR AS body FROM conversations GROUP BY conv_id")
def message_roles(spark, sf_dir):
    return A.to_messages(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text", "roles")


@query("""
SELECT conv_id, CASE WHEN count(*) FILTER (role = 'system') > 0
   THEN to_json(struct_pack(contents := coalesce(list(struct_pack(role := CASE role WHEN 'assistant' THEN 'model' ELSE 'user' END, parts := [struct_pack(text := text)]) ORDER BY turn) FILTER (role <> 'system'), []),
     systemInstruction := struct_pack(parts := [struct_pack(text := string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'system'))])))::VARCHAR
   ELSE to_json(struct_pack(contents := list(struct_pack(role := CASE role WHEN 'assistant' THEN 'model' ELSE 'user' END, parts := [struct_pack(text := text)]) ORDER BY turn)))::VARCHAR END AS body
FROM conversations GROUP BY conv_id""")
def message_parts(spark, sf_dir):
    return A.to_messages(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text", "parts")


# --- files ----------------------------------------------------------------------------------------------------------------------


@query("""
WITH e AS (SELECT DISTINCT 'p' || page_id % 20 AS stem FROM pages WHERE page_id % 3 = 0),
n AS (SELECT page_id, 'p' || page_id % 30 AS stem, row_number() OVER (PARTITION BY page_id % 30 ORDER BY page_id) AS r FROM pages WHERE page_id % 3 <> 0)
SELECT page_id, CASE WHEN e.stem IS NULL AND r = 1 THEN n.stem || '.md' ELSE n.stem || '-' || (r - (e.stem IS NULL)::INT) || '.md' END AS name FROM n LEFT JOIN e USING (stem)""")
def kb_ingest(spark, sf_dir):
    """Two thirds of the pages come into a folder that has the others, under names of which many are taken."""
    p = table(spark, sf_dir, "pages")
    name = lambda k: F.concat(F.lit("p"), (F.col("page_id") % k).cast("string"), F.lit(".md")).alias("name")
    return K.ingested(p.where("page_id % 3 = 0").select(name(20)), p.where("page_id % 3 <> 0").select("page_id", name(30)), "page_id")


@query("""
WITH a AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'raw/' WHEN 1 THEN './raw/' ELSE 'wiki/' END || page_id || '.md' AS path FROM pages)
SELECT path, CASE WHEN page_id % 4 < 2 THEN 'protected' WHEN page_id % 4 = 2 THEN 'deleted' ELSE 'missing' END AS status FROM a""")
def kb_delete(spark, sf_dir):
    """Files of the protected branch stay, files that aren't there are named."""
    p = table(spark, sf_dir, "pages")
    file = F.concat(F.col("page_id").cast("string"), F.lit(".md"))
    tree = p.select(F.concat(F.when(F.col("page_id") % 4 < 2, "raw/").otherwise("wiki/"), file).alias("path")).where(F.col("page_id") % 4 < 3)
    asked = p.select(F.concat(F.when(F.col("page_id") % 4 == 0, "raw/").when(F.col("page_id") % 4 == 1, "./raw/").otherwise("wiki/"), file).alias("path"))
    return K.deletions(tree, asked)


@query("""
WITH s AS (SELECT doc_id, octet_length(encode(text)) AS n, octet_length(encode(text)) > 10000 AS big FROM documents),
b AS (SELECT doc_id, n, big, coalesce(sum(CASE WHEN big THEN 0 ELSE n END) OVER w, 0) AS small, coalesce(sum(big::INT) OVER w, 0) AS bigs FROM s WINDOW w AS (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT doc_id, n, dense_rank() OVER (ORDER BY bigs, big, CASE WHEN big THEN 0 ELSE small // 10000 END) - 1 AS file FROM b""")
def article_files(spark, sf_dir):
    """Documents in files of 20,000 bytes at the most."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("n"))
    return C.file_numbers(d, "doc_id", F.col("n"), 20_000)
