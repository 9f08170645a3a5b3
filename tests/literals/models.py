"""Queries over literal rows, with their answers: fixtures of the operators."""

# ruff: noqa: F401
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from loomtext.functions import text as X
from loomtext.operators import lexicon as L
from loomtext.operators import linear as N
from loomtext.operators import metrics as M
from loomtext.operators import subword as SW
from loomtext.operators import training as R
from loomtext.operators import trees as T

from tests.literals import query, table


WORDS = ("the", "and", "le", "la", "der", "die", "el", "en", "de", "of")


WEIGHTS = {"en": (1.2, 1.0, -0.5, -0.4, -0.6, -0.7, -0.5, -0.3, -0.8, 1.1), "fr": (-0.7, -0.4, 1.3, 0.9, -0.5, -0.4, -0.2, 0.2, 0.5, -0.6), "de": (-0.9, -0.5, -0.4, -0.6, 1.4, 1.3, -0.7, -0.2, -0.9, -0.8), "es": (-0.8, -0.3, -0.6, 0.7, -0.6, -0.5, 1.2, 0.8, 0.4, -0.9)}


_W = "(VALUES " + ", ".join(f"('{c}', '{t}', {w})" for c, ws in WEIGHTS.items() for t, w in zip(WORDS, ws)) + ") w(class, term, w)"


@query("SELECT sum(w * w) AS l2, sum(abs(w)) AS l1 FROM " + _W)
def model_norms(spark, sf_dir):
    w = spark.createDataFrame([(x,) for xs in WEIGHTS.values() for x in xs], "w double")
    return w.agg(F.sum(F.col("w") * F.col("w")).alias("l2"), F.sum(F.abs("w")).alias("l1"))


@query("SELECT * FROM (VALUES ('', 2166136261), ('hello', 1335831723)) t(s, h)")
def fasttext_hash(spark, sf_dir):
    @F.pandas_udf("long")
    def run(v: pd.Series) -> pd.Series:
        return v.map(lambda x: R.fasttext_hash(x.encode()))

    return spark.createDataFrame([("",), ("hello",)], "s string").select("s", run("s").alias("h"))


HEADS = [(0, [2, 0, 2]), (1, [3, 0, 0, 3]), (2, [2, 1, 0]), (3, [2, 3, 1, 0]), (4, [3, 4, 0, 3]), (5, [1, 0]), (6, [2, -1, 1]), (7, [3, -1, 2])]


def heads(spark):
    return spark.createDataFrame(HEADS, "id int, heads array<int>")


@query("SELECT * FROM (VALUES (0, ''), (1, ''), (2, '1,2'), (3, '1,2,3'), (4, ''), (5, ''), (6, ''), (7, '')) t(id, ring)")
def tree_cycles(spark, sf_dir):
    return heads(spark).select("id", F.array_join(T.in_cycle(F.col("heads")), ",").alias("ring"))


@query("SELECT * FROM (VALUES (0, true, true), (1, false, true), (2, false, false), (3, false, false), (4, true, true), (5, false, false), (6, false, false), (7, false, false)) t(id, one_root, multi_root)")
def is_tree(spark, sf_dir):
    return heads(spark).select("id", T.is_tree(F.col("heads")).alias("one_root"), T.is_tree(F.col("heads"), multiroot=True).alias("multi_root"))


@query("SELECT * FROM (VALUES (0, true), (1, false), (4, false), (6, false), (7, false)) t(id, projective)")
def is_projective(spark, sf_dir):
    return heads(spark).where("id IN (0, 1, 4, 6, 7)").select("id", T.is_projective(F.col("heads")).alias("projective"))


SCORES = [[0.0, 0.0, 0.0, 0.0], [1.0, 0.0, 9.0, 2.0], [3.0, 8.0, 0.0, 1.0], [2.0, 1.0, 7.0, 0.0]]


@query("SELECT * FROM (VALUES ('eisner', '0,2,0,2'), ('mst', '0,2,0,2')) t(kind, heads)")
def mst_decode(spark, sf_dir):
    d = spark.createDataFrame([(SCORES,)], "s array<array<double>>")
    both = [d.select(F.lit(k).alias("kind"), F.array_join(T.decode(F.col("s"), k), ",").alias("heads")) for k in ("eisner", "mst")]
    return both[0].unionByName(both[1])
