"""A corpus from documents to packed sequences, in stages that are written and read again.

Language ID drops documents that have no letters, or no language (``und``); SimHash keeps one document of each group;
secrets are cut out of the texts; sources are mixed to their target weights; packing gives the training pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm import langid, mixing, packing, queries, secrets, simhash
from loomtext.llm.common import materialize


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in which a learned language was found. Labels stay as they were."""
    own = tuple(f"__loomtext_{n}" for n in ("language", "score", "mixture"))
    got = langid.identify(docs, queries.learn_languages(docs), names=own)
    return got.where(F.col(own[0]) != langid.UNKNOWN).drop(*own)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicate(docs).select(*docs.columns)


def cut_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; n_chars follows the text."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language", identify_language),
    ("near_copies", drop_near_copies),
    ("secrets", cut_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
#: Fingerprints need XXH64 and packing a tokenizer: the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all stages over the table documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
