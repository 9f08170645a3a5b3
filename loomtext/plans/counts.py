"""Counting queries over words and documents."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomtext.plans.catalog import query, table

WORD = r"[\p{L}\p{N}_]+"


@query(
    """
WITH w AS (SELECT lang, lower(unnest(regexp_extract_all(text, '[\\p{L}\\p{N}_]+'))) AS word FROM documents),
c AS (SELECT lang, word, count(*) AS n FROM w GROUP BY lang, word)
SELECT lang, word, n FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS r FROM c) WHERE r <= 50
"""
)
def top_words(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("lang", F.explode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("w"))
    c = d.groupBy("lang", F.lower("w").alias("word")).agg(F.count("*").alias("n"))
    r = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    return c.withColumn("r", r).where("r <= 50").select("lang", "word", "n")
