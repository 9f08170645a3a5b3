"""Sibling relations, span trees, code trees, templates, predicates by script, directories, metadata."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from loomtext.functions import text as X
from loomtext.operators import agentlog as A
from loomtext.operators import subword as SW
from loomtext.plans.catalog import query, table
from loomtext.sources import corpora as C

WORDS = r"(SELECT DISTINCT unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS w FROM documents)"


def words(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.explode(X.simple_tokens("text")).alias("w")).distinct()


SPANS = [[0.0, 5.0, 1.0, 2.0], [0.0, 0.0, 1.0, 4.0], [0.0, 0.0, 0.0, 3.0], [0.0, 0.0, 0.0, 0.0]]


TREE_LABELS = ["news", "law", "talk", "verse", "code", "list", "letter", "notice"]
TREE_COUNTS = [900, 500, 300, 120, 119, 40, 8, 3]
TREE_WORDS = ["the", "and", "le", "la", "der", "die", "el", "en", "de", "of"]
#: Weights by rule: inner nodes and words in four components.
TREE_OUTPUT = [[((5 * i + 3 * j) % 7 - 3) / 2 for j in range(4)] for i in range(len(TREE_LABELS) - 1)]
TREE_INPUT = [[((7 * i + 2 * j) % 9 - 4) / 3 for j in range(4)] for i in range(len(TREE_WORDS))]


def _leaf_rows() -> str:
    turns = [(leaf, TREE_OUTPUT[node], right) for leaf, path in enumerate(SW.LabelTree(TREE_LABELS, TREE_COUNTS).leaves()) for node, right in path]
    return ", ".join(f"({leaf}, '{TREE_LABELS[leaf]}', {list(w)}::DOUBLE[], {right})" for leaf, w, right in turns)


@query(rf"""
WITH w AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+'))) AS w FROM documents),
v(w, x) AS (VALUES {", ".join(f"('{w}', {x}::DOUBLE[])" for w, x in zip(TREE_WORDS, TREE_INPUT))}),
h AS (SELECT doc_id, [avg(x[1]), avg(x[2]), avg(x[3]), avg(x[4])] AS h FROM w JOIN v USING (w) GROUP BY doc_id),
t(leaf, label, o, r) AS (VALUES {_leaf_rows()}),
s AS (SELECT doc_id, leaf, label, sum(ln(CASE WHEN r THEN 1 / (1 + exp(-list_dot_product(h, o))) ELSE 1 - 1 / (1 + exp(-list_dot_product(h, o))) END + 1e-5)) AS s FROM h, t GROUP BY doc_id, leaf, label)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY round(s, 9) DESC, leaf) - 1)::BIGINT AS place, label, round(exp(s), 6) AS p FROM s QUALIFY place < 3""")
def code_tree_labels(spark, sf_dir):
    """The three likeliest of eight labels through a code tree, of the mean of each document's known words."""
    vector = X.literal_map({w: " ".join(map(repr, v)) for w, v in zip(TREE_WORDS, TREE_INPUT)})
    w = F.filter(F.transform(X.lower_tokens("text"), lambda t: F.try_element_at(vector, t)), lambda v: v.isNotNull())
    d = table(spark, sf_dir, "documents").select("doc_id", F.transform(w, lambda v: F.split(v, " ").cast("array<double>")).alias("x")).where("size(x) > 0")
    part = lambda j: F.aggregate("x", F.lit(0.0), lambda a, v: a + v[j]) / F.size("x")
    mean = F.array(*map(part, range(4)))
    d = SW.tree_labels(d.select("doc_id", mean.alias("h")), "h", TREE_LABELS, TREE_COUNTS, np.array(TREE_OUTPUT), 3)
    d = d.select("doc_id", F.posexplode("labels").alias("place", "x"))
    return d.select("doc_id", F.col("place").cast("long").alias("place"), F.col("x.label").alias("label"), F.round("x.p", 6).alias("p"))


TEMPLATES = {"greet": "Hello {{{1|you}}}<noinclude>doc</noinclude>", "outer": "{{greet|{{{name}}}}}!", "loop": "x{{loop}}"}
MARKUP = [(0, "{{Greet|Bo}} {{outer|name=An}}"), (1, "{{#if: |a|b}}{{#ifeq:1|1.0|y|n}}"), (2, "{{#switch:b|a=1|b|c=2|3}}"), (3, "{{#expr: 2 * (3 + 4) ^ 2 mod 5}}"), (4, "{{uc:abc}}{{padleft:7|3|0}}{{Roman|1994}}"), (5, "[[A|b]] {{none}}{{{x|d}}}"), (6, None)]


@query(rf"SELECT w, regexp_full_match(w, '\p{{Latin}}*') AS latin FROM {WORDS}")
def is_latin(spark, sf_dir):
    return words(spark, sf_dir).select("w", X.is_latin("w").alias("latin"))


@query("SELECT event_id, json_valid(props) AS success FROM events")
def json_parsed(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", *A.parsed_json("props")).drop("data")


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%H:%M:%S') AS time, strftime(ts, '%A') AS weekday, epoch(ts)::BIGINT - CASE WHEN epoch(ts)::BIGINT > epoch(ts) THEN 1 ELSE 0 END AS epoch FROM events")
def clock_fields(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", *A.clock("ts"))


PAPER = '<h1 class="title mathjax"><span>Title:</span>On Words</h1><div class="authors"><a>A. B.</a>, <a>C. D.</a></div><blockquote class="abstract">\nShort.</blockquote>'


@query("""
WITH p AS (SELECT replace(url, split_part(url, '/', 1) || '//', '') AS path FROM pages WHERE url IS NOT NULL),
h AS (SELECT split_part(path, '/', 1) || CASE WHEN strpos(path, '/') > 0 THEN '/' ELSE '' END AS name, strpos(path, '/') > 0 AS is_dir FROM p)
SELECT DISTINCT name, is_dir FROM h WHERE is_dir AND name NOT LIKE '.%'""")
def directory_listing(spark, sf_dir):
    """Hosts as the folders of a tree of addresses."""
    path = F.regexp_replace("url", r"^[^/]*//", "")
    tree = table(spark, sf_dir, "pages").where("url IS NOT NULL").select(path.alias("path"), F.lit(0).cast("long").alias("size"), F.lit(None).cast("timestamp").alias("modified"))
    return C.list_directory(tree).where("is_dir").select("name", "is_dir")


@query("SELECT DISTINCT a.url AS path FROM pages a WHERE a.page_id % 3 = 0 AND a.url IS NOT NULL AND NOT EXISTS (SELECT 1 FROM pages b WHERE b.page_id % 3 <> 0 AND b.url = a.url)")
def structure_difference(spark, sf_dir):
    p = table(spark, sf_dir, "pages").where("url IS NOT NULL")
    return C.missing_paths(p.where("page_id % 3 = 0").select(F.col("url").alias("path")).distinct(), p.where("page_id % 3 <> 0").select(F.col("url").alias("path")))
