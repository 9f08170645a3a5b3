"""Queries over literal rows, with their answers: fixtures of the operators."""

# ruff: noqa: F401
from __future__ import annotations

from pyspark.sql import functions as F
from loomtext.operators import agentlog as A
from loomtext.operators import knowledge as K
from loomtext.operators.written import new_folder
from loomtext.streaming import windows as S

from tests.literals import query, table


@query("SELECT * FROM (VALUES (0, '{}', NULL), (1, '{}', 'not a JSON object'), (2, '{}', 'not a JSON object'), (3, '{\"a\": 1}', NULL)) t(id, args, error)")
def json_args_edges(spark, sf_dir):
    d = spark.createDataFrame([(0, ""), (1, "[1]"), (2, "{bad"), (3, '{"a": 1}')], "id int, raw string")
    return d.select("id", *A.tool_arguments("raw"))


@query("SELECT * FROM (VALUES (0, 5, 7, 12), (1, 3, 4, 7), (2, 1, 2, 3), (3, NULL, NULL, NULL)) t(id, input_tokens, output_tokens, total_tokens)")
def extract_usage(spark, sf_dir):
    raw = ['{"usage":{"prompt_tokens":5,"completion_tokens":7,"total_tokens":12}}', '{"usage":{"input_tokens":3,"output_tokens":4}}', '{"usageMetadata":{"promptTokenCount":1,"candidatesTokenCount":2,"totalTokenCount":3}}', "{}"]
    return spark.createDataFrame(list(enumerate(raw)), "id int, raw string").select("id", *A.usage("raw"))


@query("SELECT * FROM (VALUES ('session_10')) t(latest)")
def latest_handoff(spark, sf_dir):
    """By number, not by name."""
    d = spark.createDataFrame([("session_9",), ("session_10",), ("session_2",)], "name string")
    return d.agg(F.max_by("name", F.regexp_extract("name", "([0-9]+)$", 1).cast("int")).alias("latest"))
