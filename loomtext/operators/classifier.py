"""A text classifier that travels with its preprocessor: vocabulary, inverse document frequencies, weights and settings in one folder."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtext.functions import text as X
from loomtext.operators import lexicon as L
from loomtext.operators import linear as N
from loomtext.operators.training import train_one_vs_rest

VERSION = 1


@dataclass(frozen=True)
class Settings:
    """Words are cut at white space; ``most`` terms, in ``least`` documents or more and in at most ``share`` of them; ``c`` prices the losses."""

    lower: bool = False
    least: int = 2
    share: float = 0.9
    most: int = 20_000
    c: float = 1.0


@dataclass(frozen=True)
class TextClassifier:
    settings: Settings
    #: (term, feature_id, idf)
    vocabulary: DataFrame
    #: (class, feature_id, w); feature -1 is the bias.
    weights: DataFrame

    @staticmethod
    def _terms(docs: DataFrame, settings: Settings) -> DataFrame:
        text = F.lower("text") if settings.lower else F.col("text")
        return L.document_counts(docs, X.space_tokens(text), name="term")

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> TextClassifier:
        """From (doc_id, text) and (doc_id, label); terms are counted over all of ``docs``, ties of frequency go to the term that sorts first."""
        d, n = cls._terms(docs, settings), docs.count()
        v = d.groupBy("term").agg(F.count("*").alias("df")).where((F.col("df") >= settings.least) & (F.col("df") <= int(settings.share * n)))
        v = L.dense_ids(v.orderBy(F.desc("df"), "term").limit(settings.most).withColumn("o", -F.col("df")), ["o", "term"])
        v = v.select("term", F.col("rank").alias("feature_id"), (F.ln(F.lit(n + 1.0) / (F.col("df") + 1)) + 1).alias("idf"))
        x = cls._vectors(d.join(labels.select("doc_id"), "doc_id", "left_semi"), v)
        return cls(settings, v, train_one_vs_rest(x, labels, settings.c))

    @staticmethod
    def _vectors(counts: DataFrame, vocabulary: DataFrame) -> DataFrame:
        x = counts.join(vocabulary, "term").withColumn("raw", F.col("tf") * F.col("idf"))
        norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("doc_id")))
        return x.select("doc_id", "feature_id", (F.col("raw") / norm).alias("value"))

    def predict(self, docs: DataFrame) -> DataFrame:
        """(doc_id, label, margin, confidence) of documents with known terms; ties go to the class that sorts first."""
        x = self._vectors(self._terms(docs, self.settings), self.vocabulary).withColumnRenamed("feature_id", "term")
        w = self.weights.withColumnRenamed("feature_id", "term")
        classes = self.weights.select("class").distinct().join(w.where("term = -1").select("class", F.col("w").alias("b")), "class", "left").na.fill({"b": 0.0})
        return N.best(N.scores(x, w.where("term >= 0"), classes))

    def save(self, path: str) -> None:
        """Tables, and last a mark that names the version; a folder without the mark isn't a model."""
        self.vocabulary.write.parquet(f"{path}/vocabulary")
        self.weights.write.parquet(f"{path}/weights")
        mark = json.dumps({"version": VERSION, "settings": asdict(self.settings)})
        self.vocabulary.sparkSession.createDataFrame([(mark,)], "value string").coalesce(1).write.text(f"{path}/model")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TextClassifier:
        """ValueError for a newer version."""
        mark = json.loads(spark.read.text(f"{path}/model").first()[0])
        if mark["version"] > VERSION:
            raise ValueError(f"model of version {mark['version']}, known up to {VERSION}")
        return cls(Settings(**mark["settings"]), spark.read.parquet(f"{path}/vocabulary"), spark.read.parquet(f"{path}/weights"))
