"""Projections, filters and corpus validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext.functions import text as X
from loomtext.operators import validate as V
from loomtext.plans.catalog import query, table


def lines(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return d.select("doc_id", F.col("line_no").cast("long").alias("line_no"), "line")


@query("SELECT doc_id, (k - 1)::BIGINT AS line_no, s[k] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents), LATERAL (SELECT unnest(range(1, len(s) + 1)) AS k)")
def doc_lines(spark, sf_dir):
    return lines(spark, sf_dir)


@query("SELECT doc_id, (k - 1)::BIGINT AS line_no, s[k] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents), LATERAL (SELECT unnest(range(1, len(s) + 1)) AS k) WHERE length(s[k]) >= 30 AND NOT starts_with(s[k], '<')")
def clean_lines(spark, sf_dir):
    return lines(spark, sf_dir).where(V.clean_line("line"))


@query()
def clean_sentences(spark, sf_dir):
    """Clean lines, split into sentences, of which the clean ones stay."""
    s = lines(spark, sf_dir).where(V.clean_line("line")).select("doc_id", "line_no", F.posexplode(X.sentences("line")).alias("sent_no", "sentence"))
    return s.where(V.clean_line("sentence"))


@query("SELECT event_id, user_id, event_type FROM events WHERE strftime(ts, '%Y%m%d') = strftime(DATE '2024-01-15' - INTERVAL 1 DAY, '%Y%m%d')")
def sentences_for_day(spark, sf_dir):
    """Rows of the day before a given one, by their date as yyyyMMdd."""
    return V.of_day_before(table(spark, sf_dir, "events"), "ts", "2024-01-15").select("event_id", "user_id", "event_type")


VOCAB = r"SELECT DISTINCT lower(w) AS word FROM (SELECT unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS w FROM benchmark)"


def vocabulary(spark, sf_dir, name="benchmark"):
    return table(spark, sf_dir, name).select(F.explode(X.lower_tokens("text")).alias("word")).distinct()


@query(f"SELECT word FROM ({VOCAB}) WHERE starts_with(word, 'th')")
def dict_prefix(spark, sf_dir):
    return vocabulary(spark, sf_dir).where(F.col("word").startswith("th"))


@query(rf"""
SELECT doc_id, count(*) AS n_known FROM (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+'))) AS word FROM documents)
WHERE word IN ({VOCAB}) GROUP BY doc_id""")
def dict_members(spark, sf_dir):
    w = table(spark, sf_dir, "documents").select("doc_id", F.explode(X.lower_tokens("text")).alias("word"))
    return w.join(vocabulary(spark, sf_dir), "word", "left_semi").groupBy("doc_id").agg(F.count("*").alias("n_known"))


@query(r"""
WITH l AS (SELECT doc_id, (k - 1)::BIGINT AS line_no, regexp_extract_all(s[k], '[a-zA-ZÀ-ɏḀ-ỿ]+') AS w FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents), LATERAL (SELECT unnest(range(1, len(s) + 1)) AS k))
SELECT doc_id, line_no, len(w)::BIGINT AS n_tokens, len(list_filter(w, lambda x: NOT regexp_full_match(x, '[a-zA-Z]+')))::BIGINT AS n_marked FROM l
WHERE len(w) BETWEEN 6 AND 60 AND 2 * len(list_filter(w, lambda x: NOT regexp_full_match(x, '[a-zA-Z]+'))) >= len(w)""")
def accented_sentences(spark, sf_dir):
    """Lines of 6 to 60 alphabetic tokens of which half or more bear marks."""
    return V.accented(lines(spark, sf_dir), "line").select("doc_id", "line_no", "n_tokens", "n_marked")


@query("SELECT doc_id FROM documents WHERE text <> nfc_normalize(text)")
def nfc_violations(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("n", X.nfc("text"))
    return d.where(F.col("text") != F.col("n")).select("doc_id")


@query("SELECT doc_id, nfc_normalize(text) AS text FROM documents")
def nfc_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.nfc("text").alias("text"))


@query("SELECT item_id, translate(text, '0123456789', '') AS text FROM benchmark")
def remove_digits(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.translate("text", "0123456789", "").alias("text"))


@query("SELECT item_id, lower(text) AS text FROM benchmark")
def lowercase(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.lower("text").alias("text"))


@query("SELECT d.doc_id, d.lang, d.n_chars FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 1 AND l.toxic = 0 AND d.n_chars >= 500")
def quality_filter(spark, sf_dir):
    good = table(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0").select("doc_id")
    return table(spark, sf_dir, "documents").where("n_chars >= 500").select("doc_id", "lang", "n_chars").join(good, "doc_id")


BLOCKS = [
    (1, "# sent_id = 1\n# text = Tôi đi học\nTôi\tB-W\nđi\tB-W\nhọc\tI-W"),
    (2, "# text = Không có mã\nKhông\tB-W\ncó mã\tB-W"),
    (3, "# sent_id = 3\n# text = x\nx\tB\n y\tB-W\nz"),
]


@query("SELECT doc_id, CASE WHEN text LIKE '%!!%' THEN 'shout' ELSE 'short' END AS kind FROM documents WHERE text LIKE '%!!%' OR length(text) < 30 ORDER BY doc_id LIMIT 10")
def error_budget(spark, sf_dir):
    """The first ten violations, then no more."""
    bad = table(spark, sf_dir, "documents").where("text LIKE '%!!%' OR length(text) < 30")
    return bad.select("doc_id", F.when(F.col("text").contains("!!"), "shout").otherwise("short").alias("kind")).orderBy("doc_id").limit(10)


@query("SELECT doc_id, length(text) AS n_chars, CASE WHEN trim(text) = '' THEN 0 ELSE len(string_split_regex(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '\\s+')) END::BIGINT AS n_words, (length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT AS n_lines FROM documents")
def text_stats(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", *V.text_stats("text"))
