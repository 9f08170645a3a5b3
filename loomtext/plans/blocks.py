"""Blocks of annotated sentences and dictionaries, made from the benchmark's and the documents' words."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext.functions import text as X
from loomtext.operators import lexicon as L
from loomtext.operators import validate as V
from loomtext.plans.catalog import query, table
from loomtext.sources import corpora as C

#: Words of small letters a to z, with their places from 1.
LOW = "w AS (SELECT item_id, regexp_extract_all(text, '[a-z]+') AS w FROM benchmark), t AS (SELECT item_id, len(w) AS n, k, w[k] AS w FROM w, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS k))"


def low_words(spark, sf_dir):
    """(item_id, w): an array of words of small letters."""
    return table(spark, sf_dir, "benchmark").select("item_id", F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0)).alias("w"))


# --- sentences in ten columns ------------------------------------------------------------------------------------------------


def conll_blocks(spark, sf_dir):
    """(block, body): headers, a range over the first two words, and a chain of words; every third block has a row without a word."""
    cells = lambda no, form, tag, head, rel: F.concat_ws("\t", no.cast("string"), form, F.lit("_"), tag, tag, F.lit("_"), head.cast("string"), rel, F.lit("_"), F.lit("_"))
    row = lambda x, i: cells(i + 1, x, F.when(F.length(x) > 3, "N").otherwise("E"), i, F.when(i == 0, "root").otherwise("dep"))
    rows = F.transform("w", row)
    extra = F.when(F.size("w") > 1, F.array(F.lit("1-2\tx" + "\t_" * 8))).otherwise(F.array().cast("array<string>"))
    empty = F.when(F.col("item_id") % 3 == 0, F.array(F.lit(" \tV"))).otherwise(F.array().cast("array<string>"))
    head = F.array(F.concat(F.lit("# sent_id = s"), F.col("item_id").cast("string")), F.concat(F.lit("# text = "), F.array_join("w", " ")), F.lit("# no header"))
    body = F.array_join(F.concat(head, F.slice(rows, 1, 1), extra, F.slice(rows, F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))), empty), "\n")
    return low_words(spark, sf_dir).where("size(w) > 0").select(F.col("item_id").alias("block"), body.alias("body"))


@query(f"WITH {LOW} SELECT item_id AS block, k::INT AS id, w AS form, CASE WHEN length(w) > 3 THEN 'N' ELSE 'E' END AS pos, (k - 1)::VARCHAR AS head, CASE WHEN k = 1 THEN 'root' ELSE 'dep' END AS deprel FROM t")
def conll_tokens(spark, sf_dir):
    return C.conll_tokens(conll_blocks(spark, sf_dir)).select("block", "id", "form", "pos", "head", "deprel")


@query(f"WITH {LOW}, b AS (SELECT DISTINCT item_id, n FROM t) SELECT item_id AS block, unnest(list_concat([0, 1, 2], CASE WHEN n > 1 THEN [4] ELSE [] END, CASE WHEN item_id % 3 = 0 THEN [(3 + n + (n > 1)::INT)::INT] ELSE [] END))::INT AS line_no FROM b")
def conll_notes(spark, sf_dir):
    return C.conll_notes(conll_blocks(spark, sf_dir)).select("block", "line_no")


@query(f"WITH {LOW} SELECT item_id AS block, 'sent_id' AS name, 's' || item_id AS value FROM t GROUP BY item_id UNION ALL SELECT item_id, 'text', string_agg(w, ' ' ORDER BY k) FROM t GROUP BY item_id")
def ud_headers(spark, sf_dir):
    return C.ud_headers(conll_blocks(spark, sf_dir))


@query(f"WITH {LOW} SELECT item_id AS block, (count(*) + (any_value(n) > 1)::INT)::BIGINT AS n FROM t WHERE item_id % 3 <> 0 GROUP BY item_id")
def strict_columns(spark, sf_dir):
    """Blocks with an empty token are dropped whole."""
    return C.token_rows(conll_blocks(spark, sf_dir), strict=True).groupBy("block").agg(F.count("*").alias("n"))


@query(f"WITH {LOW} SELECT item_id AS block, (count(*) + (any_value(n) > 1)::INT + (item_id % 3 = 0)::INT)::BIGINT AS n, count(*) FILTER (k = 1)::BIGINT AS firsts FROM t GROUP BY item_id")
def plain_columns(spark, sf_dir):
    """The same not strictly: rows as they stand, ranges and empty words too."""
    return C.token_rows(conll_blocks(spark, sf_dir)).groupBy("block").agg(F.count("*").alias("n"), F.sum((F.get("cells", F.lit(0)) == "1").cast("long")).alias("firsts"))


# --- sentences in two columns -------------------------------------------------------------------------------------------------


def segmented_blocks(spark, sf_dir):
    """(block, body): words with tags; of some blocks a header is missing, some rows have a fault."""

    def row(x, i):
        tag = F.when(i % 5 == 4, "B").when(i % 2 == 1, "I-W").otherwise("B-W")
        return F.when(i % 11 == 10, x).when(i % 7 == 6, F.concat(F.lit(" "), x, F.lit("\t"), tag)).when(i % 13 == 12, F.concat(x, F.lit(" x\t"), tag)).otherwise(F.concat(x, F.lit("\t"), tag))

    none = F.array().cast("array<string>")
    head = F.concat(F.when(F.col("item_id") % 4 != 1, F.array(F.lit("# sent_id = 1"))).otherwise(none), F.when(F.col("item_id") % 3 != 1, F.array(F.concat(F.lit("# text = "), F.array_join("w", " ")))).otherwise(none))
    return low_words(spark, sf_dir).where("size(w) > 0").select(F.col("item_id").alias("block"), F.array_join(F.concat(head, F.transform("w", row)), "\n").alias("body"))


@query(f"WITH {LOW} SELECT item_id AS block, unnest(list_concat(CASE WHEN item_id % 4 = 1 THEN ['sent_id'] ELSE [] END, CASE WHEN item_id % 3 = 1 THEN ['text'] ELSE [] END)) AS missing FROM (SELECT DISTINCT item_id FROM t)")
def validate_headers(spark, sf_dir):
    return V.missing_headers(segmented_blocks(spark, sf_dir))


@query(f"""
WITH {LOW}, i AS (SELECT item_id, (k - 1)::INT AS i FROM t),
f AS (SELECT item_id AS block, i AS row_no, CASE WHEN i % 11 = 10 THEN 'columns' WHEN i % 7 = 6 THEN 'edge space' WHEN i % 5 = 4 THEN 'tag' WHEN i % 13 = 12 THEN 'tokens' END AS kind FROM i)
SELECT * FROM f WHERE kind IS NOT NULL""")
def validate_tokens(spark, sf_dir):
    """Rows with other than two columns, spaces at an edge, an unknown tag, or a token that tokenizes to something else."""
    return V.bad_rows(segmented_blocks(spark, sf_dir))


def tagged_items(spark, sf_dir):
    """(item_id, tokens, tags): every third word goes on with the one before."""
    d = low_words(spark, sf_dir).where("size(w) > 0")
    return d.select("item_id", F.col("w").alias("tokens"), F.transform("w", lambda x, i: F.when(i % 3 == 2, "I_W").otherwise("B_W")).alias("tags"))


@query(f"WITH {LOW} SELECT item_id, ltrim(string_agg(CASE WHEN (k - 1) % 3 = 2 THEN '_' ELSE ' ' END || w, '' ORDER BY k)) AS text FROM t GROUP BY item_id")
def ws_to_text(spark, sf_dir):
    return tagged_items(spark, sf_dir).select("item_id", C.join_words(F.col("tokens"), F.col("tags")).alias("text"))


@query(f"WITH {LOW} SELECT item_id, k::INT AS pos, CASE WHEN (k - 1) % 3 = 2 THEN 'I-W' ELSE 'B-W' END AS tag, w AS token FROM t")
def dataset_rows(spark, sf_dir):
    """Tokens with numbered tags and the tags' names."""
    d = tagged_items(spark, sf_dir).select("item_id", "tokens", F.transform("tags", lambda t: (t == "I_W").cast("int")).alias("numbers"), F.array(F.lit("B-W"), F.lit("I-W")).alias("names"))
    z = F.arrays_zip("tokens", F.transform("numbers", lambda i: F.get("names", i)).alias("tag"))
    return d.select("item_id", F.posexplode(z).alias("p", "x")).select("item_id", (F.col("p") + 1).alias("pos"), F.col("x.tag").alias("tag"), F.col("x.tokens").alias("token"))


@query(f"WITH {LOW}, c AS (SELECT item_id, (k - 1)::INT AS pos, w AS word, CASE WHEN length(w) = 2 THEN 'Np' WHEN length(w) = 1 THEN 'CH' ELSE 'N' END AS tag FROM t) SELECT item_id, pos, word FROM c WHERE tag NOT IN ('Np', 'CH')")
def content_words(spark, sf_dir):
    d = low_words(spark, sf_dir).select("item_id", F.posexplode("w").alias("pos", "w"))
    d = d.withColumn("tag", F.when(F.length("w") == 2, "Np").when(F.length("w") == 1, "CH").otherwise("N"))
    return V.content_words(d, "w", "tag").select("item_id", "pos", F.col("w").alias("word"))


@query("SELECT s_suppkey AS id, unnest(['ROOMS#' || (s_suppkey % 5), 'HOTEL#GENERAL'][1:(1 + s_suppkey % 2)::INT]) AS aspect, unnest([CASE WHEN s_acctbal > 0 THEN 'positive' ELSE 'negative' END, 'neutral'][1:(1 + s_suppkey % 2)::INT]) AS polarity FROM supplier")
def absa_parse(spark, sf_dir):
    one = F.concat(F.lit("{ROOMS#"), (F.col("s_suppkey") % 5).cast("string"), F.lit(", "), F.when(F.col("s_acctbal") > 0, "positive").otherwise("negative"), F.lit("}"))
    line = F.when(F.col("s_suppkey") % 2 == 1, F.concat(one, F.lit(", {HOTEL#GENERAL, neutral}"))).otherwise(one)
    d = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), line.alias("labels"))
    return d.select("id", F.explode(C.parse_aspects("labels")).alias("x")).select("id", "x.*")


@query("SELECT p_partkey AS id, string_split(p_type, ' ')[1] AS aspect FROM part")
def aspect_labels(spark, sf_dir):
    d = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.replace("p_type", F.lit(" "), F.lit("#")).alias("label"))
    return d.select("id", F.split_part("label", F.lit("#"), F.lit(1)).alias("aspect"))


@query("SELECT source, (2 * r)::BIGINT AS line_no, 'd' || doc_id AS text, lang AS label FROM (SELECT source, doc_id, lang, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS r, count(*) OVER (PARTITION BY source) AS n FROM documents) WHERE NOT (source = 'src0' AND r = n - 1)")
def alternating_labels(spark, sf_dir):
    """A file a source, of texts each followed by its label; the last text of one file has none."""
    d = L.sums_before(table(spark, sf_dir, "documents").select("source", "doc_id", "lang"), "source", ["doc_id"], F.lit(1), "r")
    n = d.groupBy("source").agg((F.count("*") - 1).alias("last"))
    d = d.join(F.broadcast(n), "source")  # a row a file
    lines = F.array(F.struct((2 * F.col("r")).alias("line_no"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("line")), F.when((F.col("source") != "src0") | (F.col("r") < F.col("last")), F.struct((2 * F.col("r") + 1).alias("line_no"), F.col("lang").alias("line"))))
    d = d.select("source", F.explode(F.array_compact(lines)).alias("x")).select("source", "x.*")
    return C.alternating(d, "line_no", "line", "source").select("source", "line_no", "text", "label")


@query("SELECT 's-' || r AS sent_id, url AS text FROM (SELECT url, row_number() OVER (ORDER BY page_id) AS r FROM pages) WHERE r % 10 <> 3")
def revise_ids(spark, sf_dir):
    """Addresses numbered in order, without those on an ignore list."""
    n = L.dense_ids(table(spark, sf_dir, "pages").select("page_id", "url"), ["page_id"]).select(F.concat(F.lit("s-"), (F.col("rank") + 1).cast("string")).alias("sent_id"), F.col("url").alias("text"))
    ignored = table(spark, sf_dir, "pages").select(F.concat(F.lit("s-"), (F.col("page_id") * 10 + 3).cast("string")).alias("sent_id"))
    return n.join(ignored, "sent_id", "left_anti")


@query("SELECT 's' || d.doc_id AS sent_id, CASE WHEN quality = 0 THEN 'silver' ELSE 'auto' END AS type, CASE WHEN quality = 0 THEN 'old' || toxic ELSE 'gen' || n_chars END AS rows FROM documents d LEFT JOIN labels l USING (doc_id)")
def merge_silver(spark, sf_dir):
    """Generated sentences, replaced by those that were corrected."""
    key = F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("sent_id")
    gen = table(spark, sf_dir, "documents").select(key, F.lit("auto").alias("type"), F.concat(F.lit("gen"), F.col("n_chars").cast("string")).alias("rows"))
    old = table(spark, sf_dir, "labels").select(key, F.when(F.col("quality") == 0, "silver").otherwise("auto").alias("type"), F.concat(F.lit("old"), F.col("toxic").cast("string")).alias("rows"))
    return C.merge_corrected(gen, old, "sent_id", "type", "silver", ["rows"])


# --- dictionaries -------------------------------------------------------------------------------------------------------------

#: (token, pos) of words, the class of a word being its length's.
SENSES = r"SELECT lower(w) AS token, CASE length(w) % 3 WHEN 0 THEN 'N' WHEN 1 THEN 'V' ELSE 'A' END AS pos, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS w FROM {}) GROUP BY ALL"


def senses(spark, sf_dir, name):
    w = table(spark, sf_dir, name).select(F.explode(X.simple_tokens("text")).alias("w"))
    n = F.length("w") % 3
    return w.groupBy(F.lower("w").alias("token"), F.when(n == 0, "N").when(n == 1, "V").otherwise("A").alias("pos")).agg(F.count("*").alias("n"))


DICTS = f"WITH b AS ({SENSES.replace('{}', 'benchmark')}), d AS ({SENSES.replace('{}', 'documents')})"


@query(DICTS + ", s AS (SELECT token, list(CASE WHEN n > 2 THEN pos ELSE 'X' END) AS tags FROM d GROUP BY token) SELECT b.token, b.pos, coalesce(len(tags), 0)::INT AS votes, coalesce(list_contains(tags, b.pos), false) AS agreed FROM b LEFT JOIN s USING (token)")
def sense_vote(spark, sf_dir):
    """Candidates checked against the senses of other dictionaries."""
    s = senses(spark, sf_dir, "documents").select("token", F.when(F.col("n") > 2, F.col("pos")).otherwise("X").alias("tag"))
    return L.sense_votes(senses(spark, sf_dir, "benchmark").select("token", "pos"), s)


@query(DICTS + " SELECT token, pos FROM b UNION ALL SELECT token, pos FROM d WHERE n >= 5 AND NOT EXISTS (SELECT 1 FROM b WHERE b.token = d.token AND b.pos = d.pos)")
def dictionary_growth(spark, sf_dir):
    """Pairs seen five times that are missing are added."""
    return L.grown(senses(spark, sf_dir, "benchmark").select("token", "pos"), senses(spark, sf_dir, "documents").where("n >= 5").select("token", "pos"))


ENTRIES = "WITH g AS (SELECT source, lang, count(*) AS n, count(*) FILTER (n_chars > 500) AS long FROM documents GROUP BY source, lang)"


def entries(spark, sf_dir):
    """(word, senses): a dictionary of sources, a sense a language, its long documents as examples."""
    g = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") > 500).alias("long"))
    sense = F.struct(F.col("lang").alias("pos"), F.col("n").cast("string").alias("definition"), F.array_repeat(F.lit("x"), F.col("long").cast("int")).alias("examples"))
    return g.groupBy(F.col("source").alias("word")).agg(F.array_sort(F.collect_list(sense)).alias("senses"))


@query(ENTRIES + " SELECT source AS word, (row_number() OVER (PARTITION BY source ORDER BY lang) - 1)::INT AS sense, lang AS pos, n::VARCHAR AS definition FROM g")
def dictionary_senses(spark, sf_dir):
    return entries(spark, sf_dir).select("word", F.posexplode("senses").alias("sense", "x")).select("word", "sense", "x.pos", "x.definition")


@query(ENTRIES + " SELECT count(DISTINCT source) AS words, count(*) AS senses, sum(long)::BIGINT AS examples FROM g")
def dictionary_totals(spark, sf_dir):
    """Head words, senses and examples of a dictionary."""
    examples = F.aggregate("senses", F.lit(0), lambda a, s: a + F.size(s["examples"]))
    return entries(spark, sf_dir).agg(F.count("*").alias("words"), F.sum(F.size("senses")).cast("long").alias("senses"), F.sum(examples).cast("long").alias("examples"))
