"""Classifiers, trees, hashes, buckets."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomtext.functions import text as X
from loomtext.operators import lexicon as L
from loomtext.operators import linear as N
from loomtext.operators import metrics as M
from loomtext.operators import subword as SW
from loomtext.operators import training as R
from loomtext.operators.classifier import Settings, TextClassifier
from loomtext.operators.written import new_folder
from loomtext.plans.catalog import query, table

CLS = r"""
WITH g AS (SELECT doc_id, unnest(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS term FROM documents),
d AS (SELECT doc_id, term, count(*) AS tf FROM g GROUP BY doc_id, term), n AS (SELECT count(*) AS n FROM documents),
v0 AS (SELECT term, count(*) AS df FROM d GROUP BY term HAVING count(*) >= 2 AND count(*) <= floor(0.9 * (SELECT n FROM n)) ORDER BY df DESC, term LIMIT 2000),
v AS (SELECT term, ln(((SELECT n FROM n) + 1.0) / (df + 1)) + 1 AS idf, row_number() OVER (ORDER BY df DESC, term) - 1 AS feature_id FROM v0),
t AS (SELECT doc_id, sum(tf) AS total FROM d JOIN v USING (term) GROUP BY doc_id),
x AS (SELECT doc_id, feature_id, tf / total * idf AS raw FROM d JOIN v USING (term) JOIN t USING (doc_id)), m AS (SELECT doc_id, sqrt(sum(raw * raw)) AS norm FROM x GROUP BY doc_id)
"""


def classifier_vectors(spark, sf_dir, most=2000):
    """Case kept, whitespace words; the most frequent terms by documents, ties alphabetical; rows of length 1."""
    docs = table(spark, sf_dir, "documents")
    n = docs.count()
    d = L.document_counts(docs, X.space_tokens("text"), name="term")
    v = d.groupBy("term").agg(F.count("*").alias("df")).where((F.col("df") >= 2) & (F.col("df") <= int(0.9 * n))).orderBy(F.desc("df"), "term").limit(most)
    v = v.withColumn("o", -F.col("df"))
    v = L.dense_ids(v, ["o", "term"]).select("term", F.col("rank").alias("feature_id"), (F.ln(F.lit(n + 1.0) / (F.col("df") + 1)) + 1).alias("idf"))
    x = d.join(v, "term").withColumn("raw", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("doc_id")))
    return x.select("doc_id", "feature_id", (F.col("raw") / norm).alias("value"))


@query(CLS + "SELECT doc_id, feature_id, round(raw / norm, 6) AS value FROM x JOIN m USING (doc_id)")
def clf_vectors(spark, sf_dir):
    return classifier_vectors(spark, sf_dir).withColumn("value", F.round("value", 6))


def trained(spark, sf_dir, label="lang", rows="doc_id % 4 = 0"):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("label")) if label == "lang" else table(spark, sf_dir, "labels").select("doc_id", F.col(label).cast("string").alias("label"))
    v = classifier_vectors(spark, sf_dir, 1000)
    return v, docs, R.train_one_vs_rest(v.join(docs.where(rows).select("doc_id"), "doc_id", "left_semi"), docs.where(rows))


@query()
def svm_train(spark, sf_dir):
    return trained(spark, sf_dir)[2].groupBy("class").agg(F.count("*").alias("n"), F.sum(F.col("w") * F.col("w")).alias("l2"), F.sum(F.abs("w")).alias("l1"))


def predicted(spark, sf_dir, label="lang"):
    v, docs, w = trained(spark, sf_dir, label)
    bias = w.where("feature_id = -1").select("class", F.col("w").alias("b"))
    s = N.scores(v.withColumnRenamed("feature_id", "term"), w.where("feature_id >= 0").withColumnRenamed("feature_id", "term"), bias)
    return N.best(s), docs


@query()
def classify(spark, sf_dir):
    """Language by a trained one-against-rest classifier, saved and read again with its vocabulary, scored on held-out documents."""
    d = table(spark, sf_dir, "documents")
    docs, path = d.select("doc_id", F.col("lang").alias("label")), new_folder(spark)
    TextClassifier.fit(d.select("doc_id", "text"), docs.where("doc_id % 4 = 0"), Settings(most=1000)).save(path)
    p = TextClassifier.load(spark, path).predict(d.select("doc_id", "text"))
    held = p.join(docs, "doc_id", "inner").where("doc_id % 4 <> 0")
    return M.classification_report(held.withColumnRenamed("label", "pred").toDF(*["doc_id", "pred", "margin", "confidence", "gold"]), "gold", "pred")


@query()
def sentiment(spark, sf_dir):
    """Quality labels as polarity, with the sigmoid of the margin."""
    p, _ = predicted(spark, sf_dir, "quality")
    return p.select("doc_id", F.concat(F.lit("quality#"), F.when(F.col("label") == "1", "positive").otherwise("negative")).alias("label"), F.round("confidence", 6).alias("confidence"))


WORDS = ("the", "and", "le", "la", "der", "die", "el", "en", "de", "of")
WEIGHTS = {"en": (1.2, 1.0, -0.5, -0.4, -0.6, -0.7, -0.5, -0.3, -0.8, 1.1), "fr": (-0.7, -0.4, 1.3, 0.9, -0.5, -0.4, -0.2, 0.2, 0.5, -0.6), "de": (-0.9, -0.5, -0.4, -0.6, 1.4, 1.3, -0.7, -0.2, -0.9, -0.8), "es": (-0.8, -0.3, -0.6, 0.7, -0.6, -0.5, 1.2, 0.8, 0.4, -0.9)}
_W = "(VALUES " + ", ".join(f"('{c}', '{t}', {w})" for c, ws in WEIGHTS.items() for t, w in zip(WORDS, ws)) + ") w(class, term, w)"
LIN = rf"""
WITH f AS (SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+'))) AS term FROM documents), k AS (SELECT * FROM f WHERE term IN {WORDS}),
s AS (SELECT doc_id, class, sum(w) + 0.1 AS score FROM k JOIN {_W} USING (term) GROUP BY doc_id, class)
"""


def linear_scores(spark, sf_dir):
    """Presence of ten words under hand-made weights."""
    f = L.tokens(table(spark, sf_dir, "documents")).where(F.col("word").isin(*WORDS)).distinct().select("doc_id", F.col("word").alias("term"), F.lit(1.0).alias("value"))
    w = spark.createDataFrame([(c, t, x) for c, xs in WEIGHTS.items() for t, x in zip(WORDS, xs)], "class string, term string, w double")
    return N.scores(f, w, spark.createDataFrame([(c, 0.1) for c in WEIGHTS], "class string, b double"))


@query(LIN + "SELECT doc_id, class AS label FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, class) AS r FROM s) WHERE r = 1")
def svm_predict(spark, sf_dir):
    return N.best(linear_scores(spark, sf_dir).withColumn("score", F.round("score", 9))).select("doc_id", "label")


@query(LIN + "SELECT doc_id, round(1 / (1 + exp(-max(score))), 6) AS confidence FROM s GROUP BY doc_id")
def svm_confidence(spark, sf_dir):
    return N.best(linear_scores(spark, sf_dir)).select("doc_id", F.round("confidence", 6).alias("confidence"))


@query(LIN + ", e AS (SELECT doc_id, class, exp(score - max(score) OVER (PARTITION BY doc_id)) AS e FROM s), p AS (SELECT doc_id, class, round(e / sum(e) OVER (PARTITION BY doc_id), 9) AS prob FROM e) SELECT doc_id, class, prob, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY prob DESC, class) AS rank FROM p) WHERE rank <= 2")
def topk_classes(spark, sf_dir):
    return N.ranked(linear_scores(spark, sf_dir).withColumn("score", F.round("score", 9)), 2).withColumn("prob", F.round("prob", 9)).select("doc_id", "class", "prob", F.col("rank").cast("long").alias("rank"))


@query(LIN + ", e AS (SELECT doc_id, class, exp(score - max(score) OVER (PARTITION BY doc_id)) AS e FROM s) SELECT doc_id, class, round(e / sum(e) OVER (PARTITION BY doc_id), 9) AS prob FROM e")
def lr_predict(spark, sf_dir):
    return N.ranked(linear_scores(spark, sf_dir), 10).select("doc_id", "class", F.round("prob", 9).alias("prob"))


@query()
def lr_train(spark, sf_dir):
    """A multinomial regression of the embeddings' labels, with its accuracy on other rows."""
    from pyspark.ml.functions import array_to_vector

    d = table(spark, sf_dir, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("x"), F.col("label").cast("double").alias("y"))
    m = R.logistic_regression(d.where("vec_id % 2 = 0"), "x", "y", rounds=20)
    return m.transform(d.where("vec_id % 2 = 1")).agg(F.count("*").alias("n"), F.avg((F.col("prediction") == F.col("y")).cast("double")).alias("accuracy"))


@query("SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * ((i - 1) % 7 - 3))) + 0.5, 6) AS score, list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * ((i - 1) % 7 - 3))) + 0.5 > 0 AS positive FROM embeddings")
def dense_linear_score(spark, sf_dir):
    w = F.array(*[F.lit(float(i % 7 - 3)) for i in range(64)])
    s = N.dot(F.col("embedding"), w) + 0.5
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(s, 6).alias("score"), (s > 0).alias("positive"))


#: Words and buckets of the language model: rows of its input matrix.
LANG_WORDS, LANG_BUCKETS = 2000, 1 << 14


def language_model(spark, sf_dir):
    """A subword model learned from even documents: each feature's row is its log share in every language less its mean, the output is the identity.

    A feature is a frequent word, or a bucket of character n-grams of two to four letters.
    """
    learn = table(spark, sf_dir, "documents").where("doc_id % 2 = 0 AND lang IS NOT NULL").select("text", "lang")
    words = [r.w for r in learn.select(F.explode(X.space_tokens("text")).alias("w")).groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(LANG_WORDS).collect()]
    known = {w: i for i, w in enumerate(words)}
    ids = SW.feature_counts(learn, "text", "lang", known, LANG_BUCKETS, 2, 4).toArrow()  # a row a language and feature
    langs = sorted(set(ids.column("label").to_pylist()))
    n = np.ones((len(words) + LANG_BUCKETS, len(langs)))
    np.add.at(n, (ids.column("i").to_numpy(), [langs.index(y) for y in ids.column("label").to_pylist()]), ids.column("n").to_numpy())
    share = np.log(n / n.sum(axis=0))
    return SW.SubwordModel(known, langs, [1] * len(langs), SW.Dense((share - share.mean(axis=1, keepdims=True)).astype(np.float32)), SW.Dense(np.eye(len(langs), dtype=np.float32) * 50), buckets=LANG_BUCKETS, low=2, high=4)


@query()
def lang_detect(spark, sf_dir):
    """The likeliest language of every whole text by words and subwords; ``seen`` are the documents learned from."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    got = SW.predict_labels(d, language_model(spark, sf_dir)).select("doc_id", "lang", F.get("labels", F.lit(0)).alias("x"))
    return got.select("doc_id", "lang", (F.col("doc_id") % 2 == 0).alias("seen"), F.col("x.label").alias("label"), F.round("x.p", 6).alias("p"))


@query("SELECT doc_id, CASE WHEN ('0x' || substr(md5(doc_id::VARCHAR), 1, 6))::BIGINT % 10 = 0 THEN 'dev' ELSE 'train' END AS split FROM documents")
def hash_split(spark, sf_dir):
    """A fixed 90/10 split by a hash of the id."""
    h = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 6), 16, 10).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", F.when(h % 10 == 0, "dev").otherwise("train").alias("split"))


HEADS = [(0, [2, 0, 2]), (1, [3, 0, 0, 3]), (2, [2, 1, 0]), (3, [2, 3, 1, 0]), (4, [3, 4, 0, 3]), (5, [1, 0]), (6, [2, -1, 1]), (7, [3, -1, 2])]


def heads(spark):
    return spark.createDataFrame(HEADS, "id int, heads array<int>")


SCORES = [[0.0, 0.0, 0.0, 0.0], [1.0, 0.0, 9.0, 2.0], [3.0, 8.0, 0.0, 1.0], [2.0, 1.0, 7.0, 0.0]]


@query("""
WITH t AS (SELECT conv_id, turn, greatest(turn - 1, 0) AS head, CASE WHEN turn % 3 = 0 THEN 0 ELSE greatest(turn - 1, 0) END AS gold, role AS rel, CASE WHEN length(text) % 2 = 0 THEN role ELSE 'x' END AS gold_rel FROM conversations),
p AS (SELECT conv_id, count(*) AS n, sum((head = gold)::INT) AS a, sum((head = gold AND rel = gold_rel)::INT) AS r, bool_and(head = gold) AS ua, bool_and(head = gold AND rel = gold_rel) AS la FROM t GROUP BY conv_id)
SELECT round(sum(a) / (sum(n) + 1e-8), 9) AS uas, round(sum(r) / (sum(n) + 1e-8), 9) AS las, round(sum(ua::INT) / (count(*) + 1e-8), 9) AS ucm, round(sum(la::INT) / (count(*) + 1e-8), 9) AS lcm FROM p""")
def attachment_scores(spark, sf_dir):
    before = F.greatest(F.col("turn") - 1, F.lit(0))
    c = table(spark, sf_dir, "conversations").select("conv_id", before.alias("head"), F.when(F.col("turn") % 3 == 0, F.lit(0)).otherwise(before).alias("gold_head"), F.col("role").alias("rel"), F.when(F.length("text") % 2 == 0, F.col("role")).otherwise("x").alias("gold_rel"))
    return M.attachment(c, ["conv_id"]).select(*[F.round(x, 9).alias(x) for x in ("uas", "las", "ucm", "lcm")])


@query()
def length_buckets(spark, sf_dir):
    """Documents in eight buckets of like length, by one-dimensional clustering."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    d = table(spark, sf_dir, "documents").select("doc_id", array_to_vector(F.array(F.col("n_chars").cast("double"))).alias("x"), "n_chars")
    m = KMeans(k=8, seed=1, featuresCol="x", predictionCol="bucket").fit(d)
    return m.transform(d).groupBy("bucket").agg(F.count("*").alias("n"), F.min("n_chars").alias("low"), F.max("n_chars").alias("high"))


@query("""
SELECT lang, batch, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM (SELECT lang, n_chars, floor((sum(n_chars) OVER (PARTITION BY lang ORDER BY n_chars, doc_id) - n_chars) / 50000)::BIGINT AS batch FROM documents) GROUP BY lang, batch""")
def token_batches(spark, sf_dir):
    """Batches of like length under a budget of characters."""
    d = L.sums_before(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "lang", ["n_chars", "doc_id"], F.col("n_chars"))
    d = d.select("lang", "n_chars", F.floor(F.col("before") / 50000).alias("batch"))
    return d.groupBy("lang", "batch").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
