"""Queries over literal rows, with their answers: fixtures of the operators."""

# ruff: noqa: F401
from __future__ import annotations

from pyspark.sql import functions as F
from loomtext.functions import text as X
from loomtext.operators import validate as V

from tests.literals import query, table


@query("SELECT * FROM (VALUES ('s1', 'FACILITIES'), ('s2', 'ROOMS'), ('s3', 'plain')) t(id, aspect)")
def aspect_labels(spark, sf_dir):
    d = spark.createDataFrame([("s1", "FACILITIES#QUALITY"), ("s2", "ROOMS#CLEAN#X"), ("s3", "plain")], "id string, label string")
    return d.select("id", F.split_part("label", F.lit("#"), F.lit(1)).alias("aspect"))


@query("SELECT * FROM (VALUES (0, 'nhà'), (2, 'đi')) t(pos, word)")
def content_words(spark, sf_dir):
    d = spark.createDataFrame([(0, "nhà", "N"), (1, "Hà Nội", "Np"), (2, "Đi", "V"), (3, ".", "CH")], "pos int, word string, tag string")
    return d.where(~F.col("tag").isin("Np", "CH")).select("pos", F.lower("word").alias("word"))


BLOCKS = [
    (1, "# sent_id = 1\n# text = Tôi đi học\nTôi\tB-W\nđi\tB-W\nhọc\tI-W"),
    (2, "# text = Không có mã\nKhông\tB-W\ncó mã\tB-W"),
    (3, "# sent_id = 3\n# text = x\nx\tB\n y\tB-W\nz"),
]


@query("SELECT * FROM (VALUES (2, 'sent_id')) t(block, missing)")
def validate_headers(spark, sf_dir):
    return V.missing_headers(spark.createDataFrame(BLOCKS, "block int, body string"))


@query("SELECT * FROM (VALUES (2, 1, 'tokens'), (3, 0, 'tag'), (3, 1, 'edge space'), (3, 2, 'columns')) t(block, row_no, kind)")
def validate_tokens(spark, sf_dir):
    """Rows with other than two columns, spaces at an edge, an unknown tag, or a token that tokenizes to something else."""
    return V.bad_rows(spark.createDataFrame(BLOCKS, "block int, body string"))
