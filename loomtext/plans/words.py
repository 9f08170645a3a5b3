"""Word statistics, set operations and dictionary joins over the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext.functions import text as X
from loomtext.functions.tables import STOPWORDS
from loomtext.operators import lexicon as L
from loomtext.plans.catalog import query, table

TOK = r"SELECT doc_id, lang, lower(unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+'))) AS word FROM documents"
DW = f"SELECT doc_id, word, count(*) AS tf FROM ({TOK}) GROUP BY doc_id, word"
DIC = r"SELECT DISTINCT lower(w) AS word FROM (SELECT unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS w FROM benchmark)"


def toks(spark, sf_dir, *keep):
    return L.tokens(table(spark, sf_dir, "documents"), "text", *keep)


def dictionary(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.explode(X.lower_tokens("text")).alias("word")).distinct()


@query(f"SELECT doc_id, word, lang FROM ({TOK})")
def simple_tokens(spark, sf_dir):
    return toks(spark, sf_dir, "lang")


@query(f"SELECT word, count(*) AS n FROM ({TOK}) GROUP BY word")
def word_freq(spark, sf_dir):
    return L.frequencies(toks(spark, sf_dir))


@query(DW)
def doc_word_freq(spark, sf_dir):
    return L.document_counts(table(spark, sf_dir, "documents"), X.lower_tokens("text"))


@query(f"WITH d AS ({DW}) SELECT word, count(*) AS df, round(log10((SELECT count(*) FROM documents)::DOUBLE / count(*)), 9) AS idf FROM d GROUP BY word")
def idf_log10(spark, sf_dir):
    n = table(spark, sf_dir, "documents").count()
    return L.idf_log10(L.document_counts(table(spark, sf_dir, "documents"), X.lower_tokens("text")), n).withColumn("idf", F.round("idf", 9))


KL = f"""
WITH d AS ({DW}), len AS (SELECT doc_id, sum(tf) AS l FROM d GROUP BY doc_id), t AS (SELECT sum(tf) AS total FROM d),
p AS (SELECT word, sum(tf) AS f, sum(l) AS l_x FROM d JOIN len USING (doc_id) GROUP BY word)
SELECT word, f::BIGINT AS f, l_x::BIGINT AS l_x, round((f / l_x) * log2((f / l_x) / (f / total)), 9) AS score FROM p, t"""


@query(KL)
def kl_stopwords(spark, sf_dir):
    return L.kl_stopwords(table(spark, sf_dir, "documents")).withColumn("score", F.round("score", 9))


@query(f"SELECT word, score FROM ({KL}) ORDER BY score DESC, word LIMIT 70")
def top_stopwords(spark, sf_dir):
    return kl_stopwords(spark, sf_dir).select("word", "score").orderBy(F.desc("score"), "word").limit(70)


@query(f"""
WITH f AS (SELECT word, count(*) AS n FROM ({TOK}) GROUP BY word HAVING count(*) >= 5)
SELECT 0::BIGINT AS id, '<pad>' AS word, NULL::BIGINT AS n UNION ALL SELECT 1, '<unk>', NULL UNION ALL SELECT row_number() OVER (ORDER BY word) + 1, word, n FROM f""")
def vocab_build(spark, sf_dir):
    return L.vocabulary(L.frequencies(toks(spark, sf_dir)), 5)


@query(f"SELECT word, n FROM (SELECT word, count(*) AS n FROM ({TOK}) GROUP BY word) WHERE word NOT IN ({DIC})")
def oov_words(spark, sf_dir):
    return L.frequencies(toks(spark, sf_dir)).join(dictionary(spark, sf_dir), "word", "left_anti")


@query(f"SELECT DISTINCT word, lang FROM ({TOK}) t WHERE NOT EXISTS (SELECT 1 FROM (SELECT d.word, 'en' AS lang FROM ({DIC}) d) k WHERE k.word = t.word AND k.lang = t.lang)")
def oov_candidates(spark, sf_dir):
    """(word, language) pairs that the dictionary, of one language, doesn't have."""
    known = dictionary(spark, sf_dir).withColumn("lang", F.lit("en"))
    return toks(spark, sf_dir, "lang").select("word", "lang").distinct().join(known, ["word", "lang"], "left_anti")


@query(f"SELECT b.word, c.n FROM ({DIC}) b LEFT JOIN (SELECT word, count(*) AS n FROM ({TOK}) GROUP BY word) c USING (word)")
def dict_lookup(spark, sf_dir):
    return dictionary(spark, sf_dir).join(L.frequencies(toks(spark, sf_dir)), "word", "left")


@query(f"""
WITH k AS (SELECT word, row_number() OVER (ORDER BY word) AS r FROM ({DIC}))
SELECT a.word, b.word AS next_word, (b.r - a.r)::BIGINT AS dist FROM k a JOIN k b ON b.r BETWEEN a.r + 1 AND a.r + 3""")
def dict_neighbours(spark, sf_dir):
    """The next three words of each word in sorted order: leads over an id order, no range join."""
    k = L.dense_ids(dictionary(spark, sf_dir), ["word"])
    near = k.select(F.explode(F.sequence(F.col("rank") - 3, F.col("rank") - 1)).alias("rank"), F.col("rank").alias("r2"), F.col("word").alias("next_word"))
    return k.join(near, "rank").select("word", "next_word", (F.col("r2") - F.col("rank")).alias("dist"))


@query(f"""
WITH a AS (SELECT DISTINCT word FROM ({TOK}) WHERE lang = 'fr'), b AS (SELECT DISTINCT word FROM ({TOK}) WHERE lang = 'es')
SELECT 'both' AS part, word FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'fr', word FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
UNION ALL SELECT 'es', word FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def vocab_setops(spark, sf_dir):
    """Intersection and both differences of two vocabularies in one pass over their union."""
    t = toks(spark, sf_dir, "lang").where(F.col("lang").isin("fr", "es")).groupBy("word").agg(F.bool_or(F.col("lang") == "fr").alias("a"), F.bool_or(F.col("lang") == "es").alias("b"))
    return t.select(F.when(F.col("a") & F.col("b"), "both").when(F.col("a"), "fr").otherwise("es").alias("part"), "word")


@query("SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def repeated_items(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("text").agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT s AS symbol, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS s FROM documents) WHERE s <> '' GROUP BY s")
def symbol_freq(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "")).alias("symbol")).where("symbol <> ''")
    return d.groupBy("symbol").agg(F.count("*").alias("n"))


@query(r"""
SELECT token, count(*) AS n FROM (SELECT lower(translate(unnest(string_split_regex(text, '\s+')), '.,!?;:"()%#*$&', '')) AS token FROM documents) WHERE token <> '' GROUP BY token""")
def stripped_token_freq(spark, sf_dir):
    t = F.transform(X.space_tokens("text"), lambda x: F.lower(F.translate(x, '.,!?;:"()%#*$&', "")))
    return table(spark, sf_dir, "documents").select(F.explode(t).alias("token")).where("token <> ''").groupBy("token").agg(F.count("*").alias("n"))


LM = r"""
WITH x AS (SELECT doc_id, regexp_extract_all(text, '[a-zA-ZÀ-ɏḀ-ỿ]+|[0-9]+') AS w, string_split_regex(text, '[a-zA-ZÀ-ɏḀ-ỿ]+|[0-9]+') AS g FROM documents),
t AS (SELECT doc_id, k AS pos, CASE WHEN regexp_full_match(w[k], '[0-9]+') THEN '<num>' ELSE lower(w[k]) END AS token, g[k] AS gap FROM x, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS k)),
v AS (SELECT *, token = '<num>' OR (length(token) <= 7 AND NOT regexp_matches(token, '[fjwz]')) AS ok, lead(token) OVER (PARTITION BY doc_id ORDER BY pos) AS w2, lead(gap) OVER (PARTITION BY doc_id ORDER BY pos) AS g2 FROM t),
u AS (SELECT token AS w, count(*) AS n FROM v WHERE ok GROUP BY token HAVING count(*) >= 5),
b AS (SELECT token AS w1, w2, count(*) AS n FROM v WHERE ok AND regexp_full_match(g2, '\s+') AND (w2 = '<num>' OR (length(w2) <= 7 AND NOT regexp_matches(w2, '[fjwz]'))) GROUP BY token, w2 HAVING count(*) >= 5)
"""


@query(LM + "SELECT w, n FROM u")
def ngram_lm(spark, sf_dir):
    return L.lm_counts(table(spark, sf_dir, "documents"))[0]


@query(LM + "SELECT w1, w2, n FROM b WHERE w1 IN (SELECT w FROM u) AND w2 IN (SELECT w FROM u)")
def bigram_counts(spark, sf_dir):
    return L.lm_counts(table(spark, sf_dir, "documents"))[1]


NG = r"""
WITH t AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '\s+'), lambda x: length(x) >= 2) AS w FROM documents),
g AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM t),
d AS (SELECT doc_id, term, count(*) AS tf FROM g GROUP BY doc_id, term),
n AS (SELECT count(*) AS n FROM documents),
v0 AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM d GROUP BY term HAVING count(*) >= 2 AND count(*) <= ceil(0.9 * (SELECT n FROM n))),
v1 AS (SELECT * FROM v0 ORDER BY cf DESC, term LIMIT 5000),
v AS (SELECT term, df, cf, ln(((SELECT n FROM n) + 1.0) / (df + 1)) + 1 AS idf, row_number() OVER (ORDER BY term) - 1 AS feature_id FROM v1)
"""


def gram_words():
    return F.filter(F.split(F.lower("text"), r"\s+"), lambda x: F.length(x) >= 2)


def grams(spark, sf_dir):
    return L.document_counts(table(spark, sf_dir, "documents"), gram_words(), name="term", high=2)


def tfidf_vocab_table(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return L.document_vocabulary(d, gram_words(), d.count(), 2, 0.9, 5000, high=2)


@query(NG + "SELECT doc_id, term, tf FROM d")
def word_ngrams(spark, sf_dir):
    return grams(spark, sf_dir)


@query("SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: length(x) >= 2)) AS token FROM documents")
def tfidf_tokens(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.explode(F.filter(F.split(F.lower("text"), r"\s+"), lambda x: F.length(x) >= 2)).alias("token"))


@query(NG + "SELECT term, df, cf, round(idf, 9) AS idf, feature_id FROM v")
def tfidf_vocab(spark, sf_dir):
    return tfidf_vocab_table(spark, sf_dir).withColumn("idf", F.round("idf", 9))


@query(NG + "SELECT feature_id, term, round(idf, 9) AS idf FROM v ORDER BY v.idf DESC, feature_id LIMIT 20")
def top_idf(spark, sf_dir):
    return tfidf_vocab_table(spark, sf_dir).orderBy(F.desc("idf"), "feature_id").limit(20).select("feature_id", "term", F.round("idf", 9).alias("idf"))


TFV = NG + """, x AS (SELECT doc_id, feature_id, tf * idf AS raw, term FROM d JOIN v USING (term)), m AS (SELECT doc_id, sqrt(sum(raw * raw)) AS norm FROM x GROUP BY doc_id)
"""


def tfidf_rows(spark, sf_dir):
    """Documents' vectors, made in their rows; the vocabulary, 5,000 terms at most, is shared with the tasks."""
    return L.document_vectors(table(spark, sf_dir, "documents"), gram_words(), tfidf_vocab_table(spark, sf_dir), high=2)


@query(TFV + "SELECT doc_id, feature_id, round(raw / norm, 6) AS value FROM x JOIN m USING (doc_id)")
def tfidf_vectors(spark, sf_dir):
    return tfidf_rows(spark, sf_dir).withColumn("value", F.round("value", 6))


@query(TFV + "SELECT doc_id, format('tfidf_{}={:.6f}', feature_id, raw / norm) AS feature FROM x JOIN m USING (doc_id)")
def tfidf_features(spark, sf_dir):
    return tfidf_rows(spark, sf_dir).select("doc_id", F.format_string("tfidf_%d=%.6f", "feature_id", "value").alias("feature"))


@query(rf"""
WITH t AS (SELECT lower(w) AS token, CASE WHEN regexp_full_match(w, '[0-9]+') THEN 'number' WHEN regexp_full_match(w, '[A-Z]+') THEN 'caps' ELSE 'word' END AS cls
  FROM (SELECT unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+')) AS w FROM documents))
SELECT token, cls, count(*) AS n FROM t GROUP BY token, cls""")
def token_class_freq(spark, sf_dir):
    w = table(spark, sf_dir, "documents").select(F.explode(X.simple_tokens("text")).alias("w"))
    c = F.when(F.col("w").rlike("^[0-9]+$"), "number").when(F.col("w").rlike("^[A-Z]+$"), "caps").otherwise("word")
    return w.groupBy(F.lower("w").alias("token"), c.alias("cls")).agg(F.count("*").alias("n"))


@query(rf"""
WITH t AS (SELECT DISTINCT lower(w) AS token, CASE WHEN regexp_full_match(w, '[0-9]+') THEN 'number' WHEN regexp_full_match(w, '[A-Z]+') THEN 'caps' ELSE 'word' END AS cls
  FROM (SELECT unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+')) AS w FROM benchmark))
SELECT token, string_agg(cls, ',' ORDER BY cls) AS classes FROM t GROUP BY token""")
def token_class_sets(spark, sf_dir):
    w = table(spark, sf_dir, "benchmark").select(F.explode(X.simple_tokens("text")).alias("w"))
    c = F.when(F.col("w").rlike("^[0-9]+$"), "number").when(F.col("w").rlike("^[A-Z]+$"), "caps").otherwise("word")
    return w.groupBy(F.lower("w").alias("token")).agg(F.array_join(F.array_sort(F.collect_set(c)), ",").alias("classes"))


@query(f"SELECT word, string_agg(lang, ',' ORDER BY lang) AS sources FROM (SELECT DISTINCT word, lang FROM ({TOK})) GROUP BY word")
def merge_sources(spark, sf_dir):
    """Dictionaries merged: each word with the set of its sources."""
    return toks(spark, sf_dir, "lang").groupBy("word").agg(F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("sources"))


@query("SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS chars, min(n_chars) AS low, max(n_chars) AS high, round(avg(n_chars), 6) AS mean FROM documents GROUP BY source")
def source_histogram(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.min("n_chars").alias("low"), F.max("n_chars").alias("high"), F.round(F.avg("n_chars"), 6).alias("mean"))


@query("SELECT lang AS label, count(*) AS n FROM documents GROUP BY lang")
def label_histogram(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("label")).agg(F.count("*").alias("n"))


@query("""
SELECT 'duplicate' AS kind, doc_id AS id FROM (SELECT doc_id % 700 AS doc_id FROM documents) GROUP BY doc_id HAVING count(*) > 1
UNION ALL SELECT 'missing', i FROM (SELECT unnest(range(0, (SELECT max(doc_id) + 1 FROM labels))) AS i) WHERE i NOT IN (SELECT doc_id FROM labels)""")
def id_gaps(spark, sf_dir):
    """Ids that stand twice, and ids missing from 0 to the largest."""
    d = table(spark, sf_dir, "documents").groupBy((F.col("doc_id") % 700).alias("id")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate").alias("kind"), "id")
    l = table(spark, sf_dir, "labels").select("doc_id")
    top = l.agg(F.max("doc_id")).first()[0]
    gaps = spark.range(0, (top if top is not None else -1) + 1).join(l, F.col("id") == F.col("doc_id"), "left_anti").select(F.lit("missing").alias("kind"), "id")
    return d.unionByName(gaps)


@query(f"""
WITH f AS (SELECT word, count(*) AS n FROM ({TOK}) GROUP BY word HAVING count(*) >= 20), v AS (SELECT word, row_number() OVER (ORDER BY word) + 1 AS id FROM f),
t AS (SELECT doc_id, (k - 1)::BIGINT AS pos, lower(w[k]) AS word FROM (SELECT doc_id, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+') AS w FROM documents), LATERAL (SELECT unnest(range(1, len(w) + 1)) AS k))
SELECT doc_id, pos, coalesce(id, 1)::BIGINT AS idx FROM t LEFT JOIN v USING (word)""")
def doc_to_index(spark, sf_dir):
    """All words of each document as ids; 1 is the unknown word, 0 would be padding."""
    v = L.dense_ids(L.frequencies(toks(spark, sf_dir)).where("n >= 20"), ["word"]).select("word", (F.col("rank") + 2).alias("id"))
    t = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.lower_tokens("text")).alias("pos", "word"))
    return t.join(v, "word", "left").select("doc_id", F.col("pos").cast("long").alias("pos"), F.coalesce("id", F.lit(1)).alias("idx"))


@query("SELECT source, dense_rank() OVER (ORDER BY first_id) - 1 AS code FROM (SELECT source, min(doc_id) AS first_id FROM documents GROUP BY source)")
def label_encode(spark, sf_dir):
    """Labels numbered in the order in which they are first seen."""
    first = table(spark, sf_dir, "documents").groupBy("source").agg(F.min("doc_id").alias("first_id"))
    return L.dense_ids(first, ["first_id", "source"]).select("source", F.col("rank").alias("code"))


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents) WHERE r <= floor(n * 0.3)")
def downsample_prefix(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    return L.first_share(d, "source", "doc_id", 0.3).select("doc_id", "source")


@query(f"SELECT d.doc_id, count(*) AS n_stop FROM ({TOK}) d WHERE word IN (SELECT unnest(['de', 'la', 'le', 'và', 'là', 'the', 'một', '10', '2'])) GROUP BY d.doc_id")
def stopword_counts(spark, sf_dir):
    """Counts of stop words, the built-in list's single words with a few others."""
    own = [w for w in STOPWORDS if w in ("và", "là", "một", "10", "2")] + ["de", "la", "le", "the"]
    return toks(spark, sf_dir).where(F.col("word").isin(own)).groupBy("doc_id").agg(F.count("*").alias("n_stop"))
