"""Sequence labelling: features, decoding, islands, metrics, marks restored."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomtext.functions import text as X
from loomtext.operators import lexicon as L
from loomtext.operators import metrics as M
from loomtext.operators import perceptron as P
from loomtext.operators import sequence as S
from loomtext.operators import tagger as T
from loomtext.operators.written import written
from loomtext.plans.catalog import query, table

TK = r"SELECT doc_id, (k - 1)::BIGINT AS pos, w[k] AS w FROM (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}_]+') AS w FROM documents), LATERAL (SELECT unnest(range(1, len(w) + 1)) AS k)"


def tokens(spark, sf_dir):
    """All words of each document, with their places."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.simple_tokens("text")).alias("pos", "w"))
    return d.select("doc_id", F.col("pos").cast("long").alias("pos"), "w")


TEMPLATES = ["T[0]", "T[-1]", "T[1]", "T[-1,0]", "T[0,1]", "T[0].lower", "T[0].isdigit", "T[-1].istitle", "T[0].is_in_dict", "T[-2,-1]"]


@query(f"""
WITH t AS ({TK}), c AS (SELECT *, lag(w) OVER o AS p1, lag(w, 2) OVER o AS p2, lead(w) OVER o AS n1 FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY pos))
SELECT doc_id, pos, 'T[0]=' || w AS f0, 'T[-1]=' || coalesce(p1, 'BOS') AS f1, 'T[1]=' || coalesce(n1, 'EOS') AS f2, 'T[-1,0]=' || coalesce(p1 || ' ' || w, 'BOS') AS f3, 'T[0,1]=' || coalesce(w || ' ' || n1, 'EOS') AS f4,
 'T[0].lower=' || lower(w) AS f5, 'T[0].isdigit=' || CASE WHEN regexp_full_match(w, '[0-9]+') AND TRY_CAST(w AS BIGINT) <= 2147483647 THEN 'True' ELSE 'False' END AS f6,
 'T[-1].istitle=' || CASE WHEN p1 IS NULL THEN 'BOS' WHEN left(p1, 1) = upper(left(p1, 1)) AND left(p1, 1) <> 'ß' THEN 'True' ELSE 'False' END AS f7,
 'T[0].is_in_dict=' || CASE WHEN lower(w) IN ('the', 'de', 'der') THEN 'True' ELSE 'False' END AS f8, 'T[-2,-1]=' || coalesce(p2 || ' ' || p1, 'BOS') AS f9
FROM c""")
def context_features(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", X.simple_tokens("text").alias("w"))
    return S.array_features(d, TEMPLATES, ["w"], ["the", "de", "der"]).select("doc_id", "pos", *[f"f{k}" for k in range(len(TEMPLATES))])


def tagged(spark, sf_dir):
    """Tags that follow from the words: a capital opens a word."""
    return tokens(spark, sf_dir).withColumn("tag", F.when(F.substring("w", 1, 1) == F.upper(F.substring("w", 1, 1)), "B-W").otherwise("I-W"))


BIO = f"WITH t AS ({TK}), g AS (SELECT *, CASE WHEN left(w, 1) = upper(left(w, 1)) AND left(w, 1) <> 'ß' THEN 'B-W' ELSE 'I-W' END AS tag FROM t)"


@query(BIO + """, r AS (SELECT *, sum(CASE WHEN tag = 'B-W' OR rn = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS word_no FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rn FROM g))
SELECT doc_id, word_no::BIGINT AS word_no, string_agg(w, ' ' ORDER BY pos) AS word FROM r GROUP BY doc_id, word_no""")
def bio_merge(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", X.simple_tokens("text").alias("w"))
    capital = lambda t: F.substring(t, 1, 1) == F.upper(F.substring(t, 1, 1))
    d = d.select("doc_id", F.posexplode(S.merged(F.col("w"), capital)).alias("word_no", "word"))
    return d.select("doc_id", F.col("word_no").cast("long").alias("word_no"), "word")


STATE = [("w=a", "B-W", 1.0), ("w=a", "I-W", 0.2), ("w=b", "I-W", 0.7), ("w=c", "B-W", 0.1)]
TRANS = [("B-W", "I-W", 0.5), ("I-W", "I-W", -0.2), ("B-W", "B-W", -0.3)]


def toy(spark):
    s = spark.createDataFrame(STATE, "attr string, label string, w double")
    return s, spark.createDataFrame(TRANS, "src string, dst string, w double")


def sequences(spark):
    return spark.createDataFrame([(0, [["w=a"], ["w=b"], ["w=c"]]), (1, [["w=c", "w=zz"], ["w=a"]]), (2, [])], "sent int, feats array<array<string>>")


@query(BIO + """, l AS (SELECT *, lag(tag) OVER (PARTITION BY doc_id ORDER BY pos) AS src FROM g),
e AS (SELECT doc_id, CASE WHEN tag = 'B-W' THEN 1.0 / length(w) ELSE 0.25 END + CASE WHEN src = 'B-W' AND tag = 'I-W' THEN 0.5 WHEN src = 'I-W' AND tag = 'I-W' THEN -0.2 WHEN src = 'B-W' AND tag = 'B-W' THEN -0.3 ELSE 0 END AS v FROM l WHERE length(w) <= 8)
SELECT doc_id, round(sum(v), 6) AS score FROM (SELECT doc_id, v FROM e UNION ALL SELECT doc_id, CASE WHEN src = 'B-W' AND tag = 'I-W' THEN 0.5 WHEN src = 'I-W' AND tag = 'I-W' THEN -0.2 WHEN src = 'B-W' AND tag = 'B-W' THEN -0.3 ELSE 0 END FROM l WHERE length(w) > 8) GROUP BY doc_id""")
def crf_sequence_score(spark, sf_dir):
    """Scores of given labellings under a model with word-length weights up to 8 letters."""
    t = tagged(spark, sf_dir).select("doc_id", "pos", F.col("tag").alias("label"), F.array(F.concat(F.lit("n="), F.length("w").cast("string"))).alias("attrs"))
    state = spark.createDataFrame([x for n in range(1, 9) for x in ((f"n={n}", "B-W", 1.0 / n), (f"n={n}", "I-W", 0.25))], "attr string, label string, w double")
    return S.labelling_score(t, state, toy(spark)[1], ["doc_id"], "pos").withColumn("score", F.round("score", 6))


def sentence_words(spark, sf_dir):
    """(doc_id, sentences): the words of each sentence of whole texts, an array a document. Texts are cut at white space, which is in no word."""
    cut = F.transform(F.split("text", r"(?<=[.!?…])\s+|\n+"), lambda x: X.simple_tokens(x))
    return table(spark, sf_dir, "documents").select("doc_id", F.filter(cut, lambda w: F.size(w) > 0).alias("sentences"))


def pos_sentences(spark, sf_dir):
    """(doc_id, sent, words, gold): sentences with the parts of speech that the pipeline gives their words."""
    d = T.tag(sentence_words(spark, sf_dir).select("doc_id", F.posexplode("sentences").alias("sent", "s")), "s", 2)
    return d.select("doc_id", "sent", F.transform("tagged", lambda x: x["word"]).alias("words"), F.transform("tagged", lambda x: x["pos_tag"]).alias("gold"))


def word_features():
    """Features of ``words`` as of the templates T[0].lower, T[-1].lower, T[1].lower, T[0].istitle and the last two and three letters; parts of speech are none of them."""
    low = lambda v: F.lower(v)
    return F.transform("words", lambda x, i: F.array(
        F.concat(F.lit("T[0].lower="), low(x)),
        F.concat(F.lit("T[-1].lower="), F.coalesce(low(F.get("words", i - 1)), F.lit("BOS"))),
        F.concat(F.lit("T[1].lower="), F.coalesce(low(F.get("words", i + 1)), F.lit("EOS"))),
        F.concat(F.lit("T[0].istitle="), F.when(X.is_title(x), "True").otherwise("False")),
        F.concat(F.lit("end2="), F.right(low(x), F.lit(2))),
        F.concat(F.lit("end3="), F.right(low(x), F.lit(3))),
    ))


def training_rows(spark, sf_dir):
    """(doc_id, sent, words, gold, feats): tagged sentences with their words' features."""
    return featured(pos_sentences(spark, sf_dir))


def featured(sentences):
    """``feats`` of ``words``: several times as large as they are, so made where they are read rather than written."""
    return sentences.withColumn("feats", word_features())


def share_right(got):
    """Sentences, words, and the share of words whose ``tags`` are as ``gold`` says."""
    right = F.size(F.filter(F.zip_with("gold", "tags", lambda a, b: a == b), lambda x: x))
    return got.agg(F.count("*").alias("sentences"), F.sum(F.size("gold")).alias("words"), (F.sum(right) / F.sum(F.size("gold"))).alias("accuracy"))


def scored_tags(rows, model):
    """``share_right`` of rows tagged by a chain."""
    return share_right(S.decode(rows.select("feats", "gold"), model))


@query()
def crf_train(spark, sf_dir):
    """Parts of speech learned from the tagged words of even documents by a perceptron, scored on odd ones."""
    rows = P.in_parts(pos_sentences(spark, sf_dir).select("doc_id", "words", "gold"))
    model = P.train_perceptron(rows.where("doc_id % 2 = 0"), word_features(), "gold", 2)
    return share_right(P.decode(rows.where("doc_id % 2 = 1"), word_features(), model, ["gold"]))


def tagged_words(spark, sf_dir, depth):
    """(doc_id, word_no, word, tags): whole texts, sentence by sentence, through the pipeline's first ``depth`` taggers. Words are numbered where they are."""
    d = T.tag(sentence_words(spark, sf_dir), "sentences", depth)
    d = d.select("doc_id", F.posexplode("tagged").alias("word_no", "x"))
    return d.select("doc_id", F.col("word_no").cast("long").alias("word_no"), F.replace("x.word", F.lit(" "), F.lit("_")).alias("word"), *[F.col(f"x.{t}") for t in T.FIELDS[1:depth]])


@query()
def word_segment(spark, sf_dir):
    """Words of whole texts, the spaces inside them as underscores, by a chain trained on the tagged sentences."""
    return tagged_words(spark, sf_dir, 1)


@query()
def pos_tag(spark, sf_dir):
    """(word, pos) of segmented words."""
    return tagged_words(spark, sf_dir, 2)


@query()
def chunk(spark, sf_dir):
    """(word, pos, chunk)."""
    return tagged_words(spark, sf_dir, 3)


@query()
def ner(spark, sf_dir):
    """(word, pos, chunk, entity)."""
    return tagged_words(spark, sf_dir, 4)


GP = f"""WITH t AS ({TK}), x AS (SELECT doc_id, pos, w, CASE WHEN length(w) % 4 = 0 THEN 'B-X' WHEN length(w) % 4 = 1 THEN 'I-X' WHEN length(w) % 4 = 2 THEN 'B-Y' ELSE 'O' END AS gold,
 CASE WHEN length(w) % 4 = 0 AND length(w) < 8 THEN 'B-X' WHEN length(w) % 4 = 1 THEN 'I-X' WHEN length(w) % 5 = 2 THEN 'B-Y' ELSE 'O' END AS pred FROM t)"""


def gold_tag(w):
    n = F.length(w)
    return F.when(n % 4 == 0, "B-X").when(n % 4 == 1, "I-X").when(n % 4 == 2, "B-Y").otherwise("O")


def pred_tag(w):
    n = F.length(w)
    return F.when((n % 4 == 0) & (n < 8), "B-X").when(n % 4 == 1, "I-X").when(n % 5 == 2, "B-Y").otherwise("O")


def gold_and_pred(spark, sf_dir):
    return tokens(spark, sf_dir).withColumn("gold", gold_tag("w")).withColumn("pred", pred_tag("w"))


def doc_entities(spark, sf_dir, tags):
    """(doc_id, type, first, last) of the entities that ``gold`` or ``pred`` names, found in each document's array."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.transform(X.simple_tokens("text"), lambda w: gold_tag(w) if tags == "gold" else pred_tag(w)).alias("tags"))
    return d.select("doc_id", F.explode(S.entity_spans(F.col("tags"))).alias("x")).select("doc_id", "x.*")


def _ent_sql(c):
    return f"""(SELECT doc_id, substr({c}, 3) AS type, g, min(pos) AS first, max(pos) AS last FROM (SELECT *, sum(CASE WHEN {c} LIKE 'B-%' OR ({c} LIKE 'I-%' AND (p IS NULL OR p = 'O' OR substr(p, 3) <> substr({c}, 3))) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS g
    FROM (SELECT *, lag({c}) OVER (PARTITION BY doc_id ORDER BY pos) AS p FROM x)) WHERE {c} <> 'O' GROUP BY doc_id, substr({c}, 3), g)"""


@query(GP + f""", a AS {_ent_sql('pred')}, b AS {_ent_sql('gold')}, j AS (SELECT coalesce(a.type, b.type) AS type, a.g IS NOT NULL AS p, b.g IS NOT NULL AS q FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.type = b.type AND a.first = b.first AND a.last = b.last)
SELECT type, sum((p AND q)::INT)::BIGINT AS tp, sum(p::INT)::BIGINT AS np, sum(q::INT)::BIGINT AS ng, round(sum((p AND q)::INT) / sum(p::INT), 9) AS precision, round(sum((p AND q)::INT) / sum(q::INT), 9) AS recall, round(2.0 * sum((p AND q)::INT) / (sum(p::INT) + sum(q::INT)), 9) AS f1 FROM j GROUP BY type""")
def entity_f1(spark, sf_dir):
    side = lambda c: doc_entities(spark, sf_dir, c)
    r = M.bags(side("pred"), side("gold"), ["doc_id", "type", "first", "last"], ["type"])
    return r.select("type", "tp", "np", "ng", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query(GP + " SELECT round(avg((gold = pred)::INT), 9) AS accuracy, (SELECT round(avg(ok::INT), 9) FROM (SELECT doc_id, bool_and(gold = pred) AS ok FROM x GROUP BY doc_id)) AS sentence_accuracy FROM x")
def token_accuracy(spark, sf_dir):
    per = gold_and_pred(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum((F.col("gold") == F.col("pred")).cast("long")).alias("ok"))
    return per.agg(F.round(F.sum("ok") / F.sum("n"), 9).alias("accuracy"), F.round(F.avg((F.col("ok") == F.col("n")).cast("double")), 9).alias("sentence_accuracy"))


BRACKETS = GP + f""", a AS {_ent_sql('pred')}, b AS {_ent_sql('gold')}, u AS (SELECT doc_id, first, last, type, 1 AS p, 0 AS g FROM a UNION ALL SELECT doc_id, first, last, type, 0, 1 FROM b),
l AS (SELECT doc_id, first, last, type, sum(p) AS p, sum(g) AS g FROM u GROUP BY ALL), n AS (SELECT doc_id, first, last, sum(p) AS p, sum(g) AS g FROM u GROUP BY ALL)"""


def _prf_sql(rows):
    return f"SELECT round(sum(least(p, g)) / (sum(p) + 1e-5), 6) AS precision, round(sum(least(p, g)) / (sum(g) + 1e-5), 6) AS recall, round(2 * sum(least(p, g)) / (sum(p) + sum(g) + 1e-5), 6) AS f1 FROM {rows}"


@query(BRACKETS + f""" SELECT 'labelled' AS kind, * FROM ({_prf_sql('l')}) UNION ALL SELECT 'unlabelled', * FROM ({_prf_sql('n')})
UNION ALL SELECT 'exact', x, x, x FROM (SELECT round(avg(ok::INT), 6) AS x FROM (SELECT doc_id, bool_and(p = g) AS ok FROM l GROUP BY doc_id))""")
def bracket_f1(spark, sf_dir):
    """Bags of brackets (first, last, label) a document, labelled and without labels; exact: documents with all brackets right."""
    pred, gold = (doc_entities(spark, sf_dir, c) for c in ("pred", "gold"))
    side = lambda kind, keys: M.bags(pred, gold, ["doc_id", *keys], eps=1e-5).select(F.lit(kind).alias("kind"), *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])
    exact = M.exact_bags(pred, gold, ["doc_id"], ["first", "last", "type"]).select(F.lit("exact").alias("kind"), *[F.round("exact", 6).alias(c) for c in ("precision", "recall", "f1")])
    return side("labelled", ["first", "last", "type"]).unionByName(side("unlabelled", ["first", "last"])).unionByName(exact)


@query(BRACKETS + " " + _prf_sql("(SELECT least(p, 1) AS p, least(g, 1) AS g FROM l)"))
def span_f1(spark, sf_dir):
    """Sets of spans (first, last, label) a document."""
    pred, gold = (doc_entities(spark, sf_dir, c).distinct() for c in ("pred", "gold"))
    r = M.bags(pred, gold, ["doc_id", "first", "last", "type"], eps=1e-5)
    return r.select(*[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("""
WITH p AS (SELECT quality AS g, CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END AS p FROM labels JOIN documents USING (doc_id)),
c AS (SELECT c::VARCHAR AS class, sum((g = c)::INT)::BIGINT AS support, sum((p = c)::INT) AS np, sum((g = c AND p = c)::INT) AS tp FROM p, (VALUES (0), (1)) v(c) GROUP BY c),
e AS (SELECT class, support, tp / np AS precision, tp / support AS recall, 2 * tp / (np + support) AS f1, tp FROM c)
SELECT class, support, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM e UNION ALL SELECT 'all', sum(support)::BIGINT, round(sum(tp) / sum(support), 9), round(sum(tp) / sum(support), 9), round(sum(f1 * support) / sum(support), 9) FROM e""")
def classification_report(spark, sf_dir):
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    r = M.classification_report(d.withColumn("p", (F.col("n_chars") > 1000).cast("int")), "quality", "p")
    return r.select("class", "support", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query()
def restore_diacritics(spark, sf_dir):
    """Marks restored on all stripped texts, with counts of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    uni, bi = L.lm_counts(docs)
    model = S.restorer(uni, written(bi))
    return S.restore_marks(docs.select("doc_id", X.remove_tone("text").alias("bare")), model, "bare", "restored").select("doc_id", "restored")


@query(rf"""
WITH t AS (SELECT lower(unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+'))) AS w FROM documents), c AS (SELECT w, count(*) AS n, translate(w, '{X._tone_pairs()[0]}', '{X._tone_pairs()[1]}') AS key FROM t GROUP BY w)
SELECT key, w AS restored, n FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, w) AS r FROM c) WHERE r = 1""")
def restore_unigram(spark, sf_dir):
    """The most frequent spelling of each bare word."""
    c = L.frequencies(L.tokens(table(spark, sf_dir, "documents"))).withColumn("key", X.remove_tone("word"))
    top = c.groupBy("key").agg(F.min_by(F.struct("word", "n"), F.struct(-F.col("n"), F.col("word"))).alias("x"))
    return top.select("key", F.col("x.word").alias("restored"), F.col("x.n").alias("n"))


@query(rf"""
WITH t AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+'))) AS w FROM documents), c AS (SELECT w, count(*) AS n, translate(w, '{X._tone_pairs()[0]}', '{X._tone_pairs()[1]}') AS key FROM t GROUP BY w),
m AS (SELECT key, w AS best FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, w) AS r FROM c) WHERE r = 1)
SELECT round(sum(n * (w = best)::INT) / sum(n), 9) AS accuracy FROM c JOIN m USING (key)""")
def syllable_accuracy(spark, sf_dir):
    c = L.frequencies(L.tokens(table(spark, sf_dir, "documents"))).withColumn("key", X.remove_tone("word"))
    m = restore_unigram(spark, sf_dir).select("key", "restored")
    return c.join(m, "key").agg(F.round(F.sum(F.when(F.col("word") == F.col("restored"), F.col("n")).otherwise(0)) / F.sum("n"), 9).alias("accuracy"))


@query()
def diacritic_chains(spark, sf_dir):
    """Runs of words and numbers, broken by anything else and by punctuation."""
    part = F.posexplode(F.filter(F.split(F.regexp_replace("text", r"([,;!?…]+)", " $1 "), r"\s+"), lambda x: x != ""))
    d = table(spark, sf_dir, "benchmark").select("item_id", part.alias("pos", "part"))
    edge = "\"'“”‘’.,!?;:()\\[\\]{}…\\-"
    core = F.regexp_replace("part", f"^[{edge}]+|[{edge}]+$", "")
    d = d.withColumn("ok", core.rlike("^([a-zA-ZÀ-ɏḀ-ỿ]+|[0-9]+([.,:][0-9]+)*)$")).withColumn("left", F.col("part").rlike(f"^[{edge}]")).withColumn("right", F.col("part").rlike(f"[{edge}]$"))
    w = Window.partitionBy("item_id").orderBy("pos")
    new = ~F.coalesce(F.lag("ok").over(w), F.lit(False)) | F.coalesce(F.lag("right").over(w), F.lit(True)) | F.col("left")
    d = d.withColumn("chain", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("ok")
    return d.groupBy("item_id", "chain").agg(F.count("*").alias("n"))


@query(r"""
WITH RECURSIVE x AS (SELECT item_id, regexp_extract_all(text, '[\p{L}\p{N}_]+') AS w FROM benchmark), t AS (SELECT item_id, k, length(w[k]) AS n FROM x, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS k)),
r AS (SELECT item_id, k, n, n AS s, (n > 40)::INT AS piece FROM t WHERE k = 1
  UNION ALL SELECT t.item_id, t.k, t.n, CASE WHEN r.s + t.n > 40 THEN t.n ELSE r.s + t.n END, r.piece + (r.s + t.n > 40)::INT FROM r JOIN t ON t.item_id = r.item_id AND t.k = r.k + 1)
SELECT item_id, piece, sum(n)::BIGINT AS chars, count(*) AS n FROM r GROUP BY item_id, piece""")
def length_budget_split(spark, sf_dir):
    """Tokens cut into pieces of at most 40 characters: a sum that starts again at each cut, folded over the array."""
    d = table(spark, sf_dir, "benchmark").select("item_id", X.simple_tokens("text").alias("w"))
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("piece"), F.array().cast("array<int>").alias("out"))

    def step(a, x):
        over = a["sum"] + F.length(x) > 40
        piece = a["piece"] + over.cast("int")
        return F.struct(F.when(over, F.length(x)).otherwise(a["sum"] + F.length(x)).alias("sum"), piece.alias("piece"), F.concat(a["out"], F.array(piece)).alias("out"))

    p = d.select("item_id", F.posexplode(F.arrays_zip("w", F.aggregate("w", start, step, lambda a: a["out"]).alias("piece"))).alias("pos", "x"))
    return p.groupBy("item_id", F.col("x.piece").alias("piece")).agg(F.sum(F.length("x.w")).alias("chars"), F.count("*").alias("n"))
