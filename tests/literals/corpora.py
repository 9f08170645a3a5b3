"""Queries over literal rows, with their answers: fixtures of the operators."""

# ruff: noqa: F401
from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window
from loomtext.functions import text as X
from loomtext.sources import corpora as C

from tests.literals import query, table


@query("SELECT * FROM (VALUES (0, 'Tôi đi_học hôm_nay'), (1, 'a')) t(sent, text)")
def ws_to_text(spark, sf_dir):
    d = spark.createDataFrame([(0, ["Tôi", "đi", "học", "hôm", "nay"], ["B_W", "B_W", "I_W", "B_W", "I_W"]), (1, ["a"], ["B_W"])], "sent int, tokens array<string>, tags array<string>")
    return d.select("sent", C.join_words(F.col("tokens"), F.col("tags")).alias("text"))


BLOCKS = [(1, "# sent_id = s1\n# text = Tôi đi\n1\tTôi\t_\tP\tP\t_\t2\tnsubj\t_\t_\n1-2\tx\t_\t_\t_\t_\t_\t_\t_\t_\n2\tđi\t_\tV\tV\t_\t0\troot\t_\t_"), (2, "1\tA\t_\tN\tN\t_\t0\troot\t_\t_"), (3, "x\tN\n \tV")]


def blocks(spark):
    return spark.createDataFrame(BLOCKS, "block int, body string")


@query("SELECT * FROM (VALUES (1, 1, 'Tôi', 'P', '2', 'nsubj'), (1, 2, 'đi', 'V', '0', 'root'), (2, 1, 'A', 'N', '0', 'root')) t(block, id, form, pos, head, deprel)")
def conll_tokens(spark, sf_dir):
    return C.conll_tokens(blocks(spark)).select("block", "id", "form", "pos", "head", "deprel")


@query("SELECT * FROM (VALUES (1, 0), (1, 1), (1, 3), (3, 0), (3, 1)) t(block, line_no)")
def conll_notes(spark, sf_dir):
    return C.conll_notes(blocks(spark)).select("block", "line_no")


@query("SELECT * FROM (VALUES (1, 'sent_id', 's1'), (1, 'text', 'Tôi đi')) t(block, name, value)")
def ud_headers(spark, sf_dir):
    return C.ud_headers(blocks(spark))


@query("SELECT * FROM (VALUES (1, 3), (2, 1)) t(block, n)")
def strict_columns(spark, sf_dir):
    """Blocks with an empty token are dropped whole."""
    return C.token_rows(blocks(spark), strict=True).groupBy("block").agg(F.count("*").cast("int").alias("n"))


@query("SELECT * FROM (VALUES (0, 'ROOMS#CLEAN', 'positive'), (0, 'HOTEL#GENERAL', 'negative'), (1, 'FOOD#PRICES', 'neutral')) t(id, aspect, polarity)")
def absa_parse(spark, sf_dir):
    d = spark.createDataFrame([(0, "{ROOMS#CLEAN, positive}, {HOTEL#GENERAL, negative}"), (1, "{FOOD#PRICES, neutral}"), (2, "")], "id int, labels string")
    return d.select("id", F.explode(C.parse_aspects("labels")).alias("x")).select("id", "x.*")


@query("SELECT * FROM (VALUES (0, 'good', 'POS'), (2, 'bad', 'NEG')) t(line_no, text, label)")
def alternating_labels(spark, sf_dir):
    """A file of texts, each followed by its label."""
    d = spark.createDataFrame([(0, "good"), (1, "POS"), (2, "bad"), (3, "NEG")], "line_no int, line string")
    return C.alternating(d, "line_no", "line")


@query("SELECT * FROM (VALUES (1, 'B-W', 'Tôi'), (2, 'I-W', 'đi')) t(pos, tag, token)")
def dataset_rows(spark, sf_dir):
    """Tokens with numbered tags and the tags' names."""
    d = spark.createDataFrame([(["Tôi", "đi"], [0, 1], ["B-W", "I-W"])], "tokens array<string>, tags array<int>, names array<string>")
    z = F.arrays_zip("tokens", F.transform("tags", lambda i: F.get("names", i)).alias("tag"))
    return d.select(F.posexplode(z).alias("p", "x")).select((F.col("p") + 1).alias("pos"), F.col("x.tag").alias("tag"), F.col("x.tokens").alias("token"))


@query("SELECT * FROM (VALUES ('s-1', 'Tôi đi'), ('s-3', 'Xin chào')) t(sent_id, text)")
def revise_ids(spark, sf_dir):
    """Sentences numbered in order, without those on an ignore list."""
    d = spark.createDataFrame([(10, "Tôi đi"), (11, "bỏ"), (12, "Xin chào")], "seq int, text string")
    n = d.withColumn("sent_id", F.concat(F.lit("s-"), F.row_number().over(Window.orderBy("seq")).cast("string")))
    return n.join(spark.createDataFrame([("s-2",)], "sent_id string"), "sent_id", "left_anti").select("sent_id", "text")


@query("SELECT * FROM (VALUES ('s1', 'silver', 'old'), ('s2', 'auto', 'gen'), ('s3', 'auto', 'gen')) t(sent_id, type, rows)")
def merge_silver(spark, sf_dir):
    """Generated sentences, replaced by those that were corrected."""
    gen = spark.createDataFrame([("s1", "auto", "gen"), ("s2", "auto", "gen"), ("s3", "auto", "gen")], "sent_id string, type string, rows string")
    old = spark.createDataFrame([("s1", "silver", "old"), ("s2", "auto", "old")], "sent_id string, t2 string, r2 string")
    s = F.coalesce(F.col("t2") == "silver", F.lit(False))
    return gen.join(old, "sent_id", "left").select("sent_id", F.when(s, F.col("t2")).otherwise(F.col("type")).alias("type"), F.when(s, F.col("r2")).otherwise(F.col("rows")).alias("rows"))


@query("SELECT * FROM (VALUES ('a', 'N', 2, true), ('b', 'V', 1, false)) t(token, pos, votes, agreed)")
def sense_vote(spark, sf_dir):
    """Candidates checked against the senses of other dictionaries."""
    c = spark.createDataFrame([("a", "N"), ("b", "V")], "token string, pos string")
    s = spark.createDataFrame([("a", "N"), ("a", "V"), ("b", "N")], "token string, tag string").groupBy("token").agg(F.collect_list("tag").alias("tags"))
    j = c.join(s, "token", "left")
    return j.select("token", "pos", F.size("tags").alias("votes"), F.exists("tags", lambda t: t == F.col("pos")).alias("agreed"))


@query("SELECT * FROM (VALUES ('a', 'N'), ('b', 'V'), ('c', 'A')) t(token, pos)")
def dictionary_growth(spark, sf_dir):
    """Verified pairs that are missing are added."""
    have = spark.createDataFrame([("a", "N"), ("b", "V")], "token string, pos string")
    new = spark.createDataFrame([("a", "N", True), ("c", "A", True), ("d", "N", False)], "token string, pos string, ok boolean")
    return have.unionByName(new.where("ok").drop("ok").join(have, ["token", "pos"], "left_anti"))


@query("SELECT * FROM (VALUES ('đi', 0, 'V', 'move'), ('đi', 1, 'R', 'away'), ('ăn', 0, 'V', 'eat')) t(word, sense, pos, definition)")
def dictionary_senses(spark, sf_dir):
    d = spark.createDataFrame([("đi", [("V", "move"), ("R", "away")]), ("ăn", [("V", "eat")])], "word string, senses array<struct<pos:string,definition:string>>")
    return d.select("word", F.posexplode("senses").alias("sense", "x")).select("word", "sense", "x.*")
