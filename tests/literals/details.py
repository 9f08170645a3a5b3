"""Queries over literal rows, with their answers: fixtures of the operators."""

# ruff: noqa: F401
from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from loomtext.functions import text as X
from loomtext.operators import agentlog as A
from loomtext.operators import knowledge as K
from loomtext.operators import subword as SW
from loomtext.operators import trees as T
from loomtext.operators import wikitemplates as W
from loomtext.sources import corpora as C

from tests.literals import query, table


@query("SELECT * FROM (VALUES (0, '2,-1,-1,-1'), (1, '-1,-1,2,3'), (2, ''), (3, '2,-1,-1,-1,4')) t(id, sibs)")
def next_siblings(spark, sf_dir):
    d = spark.createDataFrame([(0, [3, 3, 0, 3]), (1, [0, 1, 1, 1]), (2, []), (3, [3, 3, 0, 3, 3])], "id int, heads array<int>")
    return d.select("id", F.array_join(T.next_siblings(F.col("heads")), ",").alias("sibs"))


SPANS = [[0.0, 5.0, 1.0, 2.0], [0.0, 0.0, 1.0, 4.0], [0.0, 0.0, 0.0, 3.0], [0.0, 0.0, 0.0, 0.0]]


@query("SELECT * FROM (VALUES (0, '0-3,0-1,1-3,1-2,2-3'), (1, '0-1')) t(id, spans)")
def constituency_decode(spark, sf_dir):
    d = spark.createDataFrame([(0, SPANS), (1, [[0.0, 1.0], [0.0, 0.0]])], "id int, s array<array<double>>")
    return d.select("id", F.array_join(F.transform(T.constituents(F.col("s")), lambda x: F.concat_ws("-", x["start"], x["stop"])), ",").alias("spans"))


TEMPLATES = {"greet": "Hello {{{1|you}}}<noinclude>doc</noinclude>", "outer": "{{greet|{{{name}}}}}!", "loop": "x{{loop}}"}


MARKUP = [(0, "{{Greet|Bo}} {{outer|name=An}}"), (1, "{{#if: |a|b}}{{#ifeq:1|1.0|y|n}}"), (2, "{{#switch:b|a=1|b|c=2|3}}"), (3, "{{#expr: 2 * (3 + 4) ^ 2 mod 5}}"), (4, "{{uc:abc}}{{padleft:7|3|0}}{{Roman|1994}}"), (5, "[[A|b]] {{none}}{{{x|d}}}"), (6, None)]


@query("SELECT * FROM (VALUES (0, 'Hello Bo Hello An!'), (1, 'by'), (2, '2'), (3, '3'), (4, 'ABC007MCMXCIV'), (5, '[[A|b]] d'), (6, NULL)) t(id, text)")
def wiki_templates(spark, sf_dir):
    return spark.createDataFrame(MARKUP, "id int, markup string").select("id", W.expand_templates("markup", TEMPLATES).alias("text"))


@query("SELECT * FROM (VALUES (0, 'ABC１', false, 'ABC1'), (1, 'ＡＢ', true, 'AB'), (2, '한', true, '한')) t(id, w, wide, half)")
def full_width(spark, sf_dir):
    d = spark.createDataFrame([(0, "ABC１"), (1, "ＡＢ"), (2, "한")], "id int, w string")
    return d.select("id", "w", X.is_full_width("w").alias("wide"), X.half_width("w").alias("half"))


@query("""
SELECT * FROM (VALUES ('oà', 'oa'), ('òa', 'oa'), ('iếc', 'iêc'), ('iêc', NULL), ('ương', 'ương'), ('uyệt', 'uyêt'), ('ách', 'ach'), ('ach', NULL), ('nha', NULL),
('ưu', 'ưu'), ('oong', 'oong'), ('ă', NULL), ('ỳ', 'y'), ('uynh', 'uynh')) t(r, rhyme)""")
def rhymes(spark, sf_dir):
    d = spark.createDataFrame([(r,) for r in ("oà", "òa", "iếc", "iêc", "ương", "uyệt", "ách", "ach", "nha", "ưu", "oong", "ă", "ỳ", "uynh")], "r string")
    return d.select("r", X.rhyme("r").alias("rhyme"))


PAPER = '<h1 class="title mathjax"><span>Title:</span>On Words</h1><div class="authors"><a>A. B.</a>, <a>C. D.</a></div><blockquote class="abstract">\nShort.</blockquote>'


@query("SELECT * FROM (VALUES (0, '2401.01234', 'Title: On Words', 'A. B., C. D.', 'Short.'), (1, '2401.01235', '2401.01235', '', '')) t(id, paper_id, title, authors, abstract)")
def paper_metadata(spark, sf_dir):
    d = spark.createDataFrame([(0, "https://arxiv.org/abs/2401.01234", PAPER), (1, "https://arxiv.org/pdf/2401.01235", "<p>x</p>")], "id int, url string, html string")
    got = d.select("id", *K.paper_fields("url", "html"))
    return got.withColumn("title", F.trim(F.regexp_replace("title", r"\s+", " "))).withColumn("abstract", F.trim(F.regexp_replace("abstract", r"\s+", " ")))


@query("SELECT * FROM (VALUES (0, 'an', '12', 'an-12.md'), (1, NULL, NULL, NULL)) t(id, account, post_id, file_name)")
def post_metadata(spark, sf_dir):
    d = spark.createDataFrame([(0, "https://x.com/an/status/12?s=1"), (1, "https://x.com/an")], "id int, url string")
    return d.select("id", *K.post_fields("url"))
