"""Queries over literal rows, with their answers: fixtures of the operators."""

# ruff: noqa: F401
from __future__ import annotations

from pyspark.sql import functions as F
from loomtext.functions import text as X
from loomtext.operators import agentlog as A
from loomtext.operators import crf
from loomtext.operators import wikitext as W
from loomtext.operators.written import written
from loomtext.plans.sequences import scored_tags, training_rows

from tests.literals import query, table


WIKI = [(0, "'''Hà Nội''' là [[thủ đô|kinh đô]] của [[Việt Nam]].{{Infobox|a={{b}}}}<ref>x</ref>"), (1, "== Lịch sử ==\n* một\n* [http://a.b hai]\n[[File:x.jpg|thumb|[[y]] z]]"), (2, "{| class=x\n| a\n|}\n&lt;ok&gt;")]


@query("SELECT * FROM (VALUES (0, 'Hà Nội là kinh đô của Việt Nam.'), (1, 'Lịch sử' || chr(10) || 'một' || chr(10) || 'hai'), (2, '<ok>')) t(id, text)")
def wiki_plain_text(spark, sf_dir):
    return spark.createDataFrame(WIKI, "id int, markup string").select("id", W.wiki_text("markup").alias("text"))


@query("SELECT * FROM (VALUES (0, 't a sil x y z')) t(id, phones)")
def phoneme_tokens(spark, sf_dir):
    """Words by a lexicon, others letter by letter."""
    known = X.literal_map({"ta": "t a", ",": "sil"})
    d = spark.createDataFrame([(0, ["ta", ",", "xyz"])], "id int, words array<string>")
    one = lambda w: F.coalesce(F.split(F.try_element_at(known, w), " "), F.split(w, ""))
    return d.select("id", F.array_join(F.flatten(F.transform("words", one)), " ").alias("phones"))
