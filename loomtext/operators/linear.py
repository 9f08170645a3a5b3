"""Linear models over sparse text features: training per class, scores as joins, probabilities as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def softmax(x: Column) -> Column:
    """Of an array of scores, shifted by the largest."""
    top = F.array_max(x)
    total = F.aggregate(x, F.lit(0.0), lambda a, v: a + F.exp(v - top))
    return F.transform(x, lambda v: F.exp(v - top) / total)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def scores(features: DataFrame, weights: DataFrame, biases: DataFrame) -> DataFrame:
    """(doc_id, class, score) from (doc_id, term, value), (class, term, w) and (class, b).

    Weights are a vocabulary times classes and are joined as AQE finds best; documents without known terms get the biases.
    """
    s = features.join(weights, "term").groupBy("doc_id", "class").agg(F.sum(F.col("value") * F.col("w")).alias("s"))
    every = features.select("doc_id").distinct().join(F.broadcast(biases))  # a row a class
    return every.join(s, ["doc_id", "class"], "left").select("doc_id", "class", (F.coalesce("s", F.lit(0.0)) + F.col("b")).alias("score"))


def best(scored: DataFrame) -> DataFrame:
    """(doc_id, label, margin, confidence): the largest score, ties to the class that sorts first."""
    top = scored.groupBy("doc_id").agg(F.min_by(F.struct("class", "score"), F.struct(-F.col("score"), F.col("class"))).alias("x"))
    return top.select("doc_id", F.col("x.class").alias("label"), F.col("x.score").alias("margin"), sigmoid(F.col("x.score")).alias("confidence"))


def ranked(scored: DataFrame, k: int) -> DataFrame:
    """(doc_id, class, prob, rank) of the k most probable classes."""
    w = Window.partitionBy("doc_id")
    e = scored.withColumn("e", F.exp(F.col("score") - F.max("score").over(w))).withColumn("prob", F.col("e") / F.sum("e").over(w))
    r = F.row_number().over(w.orderBy(F.desc("prob"), "class"))
    return e.withColumn("rank", r).where(F.col("rank") <= k).select("doc_id", "class", "prob", "rank")
