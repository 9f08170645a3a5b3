"""Queries over literal rows, with their answers: fixtures of the operators."""

# ruff: noqa: F401
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from loomtext.functions import text as X
from loomtext.operators import lexicon as L
from loomtext.operators import metrics as M
from loomtext.operators import sequence as S
from loomtext.operators import tagger as T
from loomtext.operators.written import written

from tests.literals import query, table


@query("SELECT * FROM (VALUES (0, 0, 'Hà Nội', 'B-LOC', 2), (0, 2, 'là', 'O', 3), (0, 3, 'embedding', 'B-MISC', 6)) t(sent, start, word, entity, last)")
def wordpiece_merge(spark, sf_dir):
    """Pieces that start with ## go on with the word before and move its end."""
    rows = [(0, 0, "Hà Nội", "B-LOC", 2), (0, 2, "là", "O", 3), (0, 3, "em", "B-MISC", 4), (0, 4, "##bed", "B-MISC", 5), (0, 5, "##ding", "I-MISC", 6)]
    d = spark.createDataFrame(rows, "sent int, start int, piece string, entity string, end int")
    w = Window.partitionBy("sent").orderBy("start")
    d = d.withColumn("g", F.sum((~F.col("piece").startswith("##")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    x = F.array_sort(F.collect_list(F.struct("start", F.regexp_replace("piece", "^##", "").alias("p"))))
    g = d.groupBy("sent", "g").agg(F.min("start").alias("start"), F.array_join(F.transform(x, lambda v: v["p"]), "").alias("word"), F.min_by("entity", "start").alias("entity"), F.max("end").alias("last"))
    return g.drop("g")


STATE = [("w=a", "B-W", 1.0), ("w=a", "I-W", 0.2), ("w=b", "I-W", 0.7), ("w=c", "B-W", 0.1)]


TRANS = [("B-W", "I-W", 0.5), ("I-W", "I-W", -0.2), ("B-W", "B-W", -0.3)]


def toy(spark):
    s = spark.createDataFrame(STATE, "attr string, label string, w double")
    return s, spark.createDataFrame(TRANS, "src string, dst string, w double")


def sequences(spark):
    return spark.createDataFrame([(0, [["w=a"], ["w=b"], ["w=c"]]), (1, [["w=c", "w=zz"], ["w=a"]]), (2, [])], "sent int, feats array<array<string>>")


@query("SELECT * FROM (VALUES (0, 'B-W I-W B-W'), (1, 'I-W B-W'), (2, '')) t(sent, tags)")
def crf_decode(spark, sf_dir):
    return S.decode(sequences(spark), S.load_chain(*toy(spark))).select("sent", F.array_join("tags", " ").alias("tags"))


@query("SELECT * FROM (VALUES (0, 3, 1.0), (1, 2, 1.0)) t(sent, n, total)")
def crf_marginals(spark, sf_dir):
    """Each token's marginals add up to 1."""
    m = S.marginals(sequences(spark).where("size(feats) > 0"), S.load_chain(*toy(spark)))
    total = F.aggregate("marginals", F.lit(0.0), lambda a, r: a + F.aggregate(r, F.lit(0.0), lambda s, v: s + v))
    return m.select("sent", F.size("marginals").alias("n"), F.round(total / F.size("marginals"), 9).alias("total"))
