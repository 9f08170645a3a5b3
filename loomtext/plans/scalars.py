"""Scalar functions over real columns and over small fixtures."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import functions as F

from loomtext.functions import tables as T
from loomtext.functions import text as X
from loomtext.operators import lexicon as L
from loomtext.plans.catalog import query, table


def words(spark, sf_dir, name="documents"):
    return table(spark, sf_dir, name).select(F.explode(X.simple_tokens("text")).alias("w")).distinct()


W = r"(SELECT DISTINCT unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS w FROM documents)"
CHARS = [("ò", "o`"), ("o`", "ô"), ("é", "e"), ("ß", "ss")]
TOKEN_MAP = {"the": "ze", "le": "lo", "de": "du"}


@query(f"SELECT w, replace(replace(replace(replace(w, 'ò', 'o`'), 'o`', 'ô'), 'é', 'e'), 'ß', 'ss') AS mapped FROM {W}")
def char_map(spark, sf_dir):
    """Rules in order; a later one sees what an earlier one made."""
    return words(spark, sf_dir).select("w", X.replace_in_order("w", CHARS).alias("mapped"))


@query(f"""
SELECT w, CASE WHEN length(w) > 6 THEN w ELSE coalesce(CASE n WHEN 'the' THEN 'ze' WHEN 'le' THEN 'lo' WHEN 'de' THEN 'du' END, n) END AS token
FROM (SELECT w, replace(replace(nfc_normalize(w), 'é', 'e'), 'ß', 'ss') AS n FROM {W})""")
def token_normalize(spark, sf_dir):
    """On distinct words: a dictionary-like function runs once a word, not once a token."""
    return words(spark, sf_dir).select("w", X.normalize_token("w", CHARS[2:], TOKEN_MAP).alias("token"))


@query()
def text_normalize(spark, sf_dir):
    """Tokens of the class tokenizer, normalized on distinct tokens, joined again by single spaces."""
    d = table(spark, sf_dir, "benchmark").withColumn("t", X.regex_tokens("text")).select("item_id", F.posexplode("t").alias("pos", "x")).select("item_id", "pos", "x.token")
    m = d.select("token").distinct().withColumn("norm", X.normalize_token("token", CHARS[2:], TOKEN_MAP))
    j = d.join(m, "token").groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("pos", "norm"))).alias("x"))
    return j.select("item_id", F.array_join(F.transform("x", lambda v: v["norm"]), " ").alias("text"))


@query("""
SELECT item_id, array_to_string(list_transform(string_split(text, ' '), lambda w: CASE WHEN length(w) > 6 THEN w ELSE coalesce(CASE replace(replace(nfc_normalize(w), 'é', 'e'), 'ß', 'ss') WHEN 'the' THEN 'ze' WHEN 'le' THEN 'lo' WHEN 'de' THEN 'du' END, replace(replace(nfc_normalize(w), 'é', 'e'), 'ß', 'ss')) END), ' ') AS text
FROM benchmark""")
def text_normalize_space(spark, sf_dir):
    known = X.literal_map(TOKEN_MAP)

    def one(w):
        n = X.replace_in_order(w, CHARS[2:])
        return F.when(F.length(w) > 6, w).otherwise(F.coalesce(F.try_element_at(known, n), n))

    d = table(spark, sf_dir, "benchmark").withColumn("n", X.nfc("text"))
    return d.select("item_id", F.array_join(F.transform(F.split("n", " "), one), " ").alias("text"))


@query(r"""
WITH b AS (SELECT w AS key, reverse(w) AS value FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS w FROM documents)),
e AS (SELECT key, value, 0 AS made, key AS seq, 0 AS o FROM b
  UNION ALL SELECT replace(upper(left(key, 1)), 'ẞ', 'SS') || lower(substr(key, 2)), replace(upper(left(value, 1)), 'ẞ', 'SS') || lower(substr(value, 2)), 1, key, 1 FROM b
  UNION ALL SELECT replace(upper(key), 'ẞ', 'SS'), replace(upper(value), 'ẞ', 'SS'), 1, key, 2 FROM b)
SELECT key, value FROM (SELECT key, value, row_number() OVER (PARTITION BY key ORDER BY made DESC, seq DESC, o DESC) AS r FROM e) WHERE r = 1""")
def rule_expand(spark, sf_dir):
    """Rules (here each word read backwards, in the words' order), also capitalized and in capitals; later rules win."""
    w = table(spark, sf_dir, "documents").select(F.explode(X.simple_tokens("text")).alias("key")).distinct()
    return L.expand_rules(w.select(F.col("key").alias("seq"), "key", F.reverse("key").alias("value")))


def _plain_sql(col):
    a, b = X._tone_pairs()
    return f"translate({col}, '{a}', '{b}')"


@query(f"SELECT w, regexp_replace(lower({_plain_sql('w')}), '[^aeiouy]', '', 'g') AS vowels, regexp_replace(lower({_plain_sql('w')}), '[^aeiouy]', '', 'g') NOT IN ('a', 'e', 'i', 'o', 'u', 'y', 'ai', 'ao', 'au', 'eo', 'ia', 'io', 'oa', 'oi', 'ua', 'ui', 'uy', 'ye') AS odd FROM {W}")
def vowel_group(spark, sf_dir):
    known = ("a", "e", "i", "o", "u", "y", "ai", "ao", "au", "eo", "ia", "io", "oa", "oi", "ua", "ui", "uy", "ye")
    v = F.regexp_replace(F.lower(X.remove_tone("w")), "[^aeiouy]", "")
    return words(spark, sf_dir).select("w", v.alias("vowels"), (~v.isin(*known)).alias("odd"))


@query(f"SELECT w, {_plain_sql('w')} AS plain FROM {W}")
def remove_tone(spark, sf_dir):
    return words(spark, sf_dir).select("w", X.remove_tone("w").alias("plain"))


@query(f"SELECT w, translate(strip_accents(w), 'đĐ', 'dD') AS plain FROM {W} WHERE regexp_full_match(w, '[a-zA-ZàâäéèêëîïôöùûüçñáíóúÀÂÄÉÈÊËÎÏÔÖÙÛÜÇÑÁÍÓÚ]+')")
def strip_diacritics(spark, sf_dir):
    d = words(spark, sf_dir).where(F.col("w").rlike("^[a-zA-ZàâäéèêëîïôöùûüçñáíóúÀÂÄÉÈÊËÎÏÔÖÙÛÜÇÑÁÍÓÚ]+$"))
    return d.select("w", X.strip_diacritics("w").alias("plain"))


@query("SELECT url, regexp_replace(strip_accents(lower(trim(url))), '[^a-z0-9]', '', 'g') AS key FROM pages")
def normalize_key(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("url", X.normalize_key("url").alias("key"))


ADDRESSES = [
    "P. Phúc Xá, Q. Ba Đình, TP. Hà Nội",
    "Phường Phúc Xá, Quận Ba Đình, Thành phố Hà Nội",
    "12 Hàng Bài, phường Tràng Tiền, quận Hoàn Kiếm, Hà Nội",
    "Xã Cũ, Hà Nội",
    "Hà Nội",
    "Quận Ba Đình, Hà Nội",
    "Nowhere, Atlantis",
    "phường Lạ, quận Lạ, Hà Nội",
    "phường Chia, quận Ba Đình, hà nội",
]
_ADDR = "(VALUES " + ", ".join(f"({i}, '{a}')" for i, a in enumerate(ADDRESSES)) + ") t(id, address)"
_EXP = "lower(trim(address))"
for _k, _v in sorted(T.ADDRESS_ABBREVIATIONS.items(), key=lambda x: -len(x[0])):
    _EXP = f"replace({_EXP}, '{_k}', '{_v}')"


def addresses(spark):
    return spark.createDataFrame(list(enumerate(ADDRESSES)), "id int, address string")


PROVINCES = [("hanoi", 1, "hanoi", "Thành phố Hà Nội"), ("thanhphohanoi", 2, "hanoi", "Thành phố Hà Nội")]
UNITS = [
    (1, "hanoi", "quanbadinh", "phuongphucxa", "Hà Nội", "Phường Hồng Hà"),
    (2, "hanoi", "quanhoankiem", "phuongtrangtien", "Hà Nội", "Phường Hoàn Kiếm"),
    (3, "hanoi", "quanhoankiem", "phuonghangbai", "Hà Nội", "Phường Hoàn Kiếm"),
    (4, "hanoi", "quanbadinh", "phuongchia", "Hà Nội", "Phường Một"),
    (5, "hanoi", "quanbadinh", "phuongchia", "Hà Nội", "Phường Hai"),
    (6, "hanoi", "huyencu", "xacu", "Hà Nội", "Xã Cũ"),
]
UNIT_TYPES = "seq int, old_province_key string, old_district_key string, old_ward_key string, new_province string, new_ward string"


SOCIAL = ["sp ko đẹp lắm!!!", "xem www.x.vn nhé :) ok.", "KHÔNG tốt chút nào đâu", "hay quá.... tks!!", ""]


@query(r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '') AS w FROM documents),
t AS (SELECT doc_id, k, w[k] AS x, regexp_replace(w[k], '^[.,!?;:]+|[.,!?;:]+$', '', 'g') IN ('the', 'le', 'der') AS neg FROM w, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS k)),
m AS (SELECT doc_id, k, CASE WHEN bool_or(neg) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) THEN 'NEG_' || x ELSE x END AS x FROM t)
SELECT doc_id, string_agg(x, ' ' ORDER BY k) AS text FROM m GROUP BY doc_id""")
def negation_mark(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("w", X.space_tokens(F.lower("text")))
    return d.select("doc_id", F.array_join(X.mark_negation(F.col("w"), ("the", "le", "der"), 2), " ").alias("text")).where("text <> ''")


@query()
def tts_text_norm(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", X.tts_text("text").alias("text"))


@query(r"""
WITH u AS (SELECT url, regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://)?([^?#]*)', 1) AS p FROM pages)
SELECT url, left(regexp_replace(regexp_replace(regexp_replace(p, '[^\p{L}\p{N}_\-]', '_', 'g'), '^_+|_+$', '', 'g'), '_+', '_', 'g'), 80) || '.md' AS name FROM u""")
def safe_filename(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("url", X.safe_filename("url").alias("name"))


@query(r"SELECT item_id, regexp_replace(left(regexp_replace(text, '[^\p{L}\p{N}_]', '_', 'g'), 50), '^_+|_+$', '', 'g') AS slug FROM benchmark")
def question_slug(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", X.slug("text").alias("slug"))


@query(r"""
SELECT url, CASE WHEN lower(url) LIKE '%twitter.com%' OR lower(url) LIKE '%x.com%' THEN 'tweet' WHEN lower(url) LIKE '%arxiv.org%' THEN 'arxiv' WHEN lower(url) LIKE '%github.com%' THEN 'github'
 WHEN lower(url) LIKE '%youtube.com%' OR lower(url) LIKE '%youtu.be%' THEN 'youtube' WHEN lower(regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)) LIKE '%.pdf' THEN 'pdf'
 WHEN regexp_matches(lower(regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)), '\.(png|jpg|jpeg|webp|gif)$') THEN 'image' ELSE 'webpage' END AS kind
FROM (SELECT url FROM pages UNION ALL SELECT unnest(['https://twitter.com/a', 'http://arxiv.org/abs/1', 'https://github.com/x', 'https://youtu.be/1', 'https://a.b/c.PDF?x=1', 'https://a.b/c.jpg']))""")
def url_type(spark, sf_dir):
    more = [(u,) for u in ("https://twitter.com/a", "http://arxiv.org/abs/1", "https://github.com/x", "https://youtu.be/1", "https://a.b/c.PDF?x=1", "https://a.b/c.jpg")]
    return table(spark, sf_dir, "pages").select("url").unionByName(spark.createDataFrame(more, "url string")).select("url", X.url_type("url").alias("kind"))


@query()
def sentences(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.sentences("text")).alias("sent_no", "sentence"))


SIMPLE = r"SELECT doc_id, unnest(regexp_extract_all(text, '[^.?!]+[.?!]*')) AS s FROM documents"


@query(f"SELECT doc_id, trim(s, ' ' || chr(9) || chr(10) || chr(13)) AS sentence FROM ({SIMPLE}) WHERE trim(s, ' ' || chr(9) || chr(10) || chr(13)) <> ''")
def sentences_simple(spark, sf_dir):
    """Sentences by end marks alone, without abbreviations."""
    s = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[^.?!]+[.?!]*"), F.lit(0))).alias("s"))
    return s.select("doc_id", F.expr("trim(BOTH ' \\t\\n\\r' FROM s)").alias("sentence")).where("sentence <> ''")


@query(f"SELECT doc_id, count(*) AS n FROM ({SIMPLE}) WHERE trim(s, ' ' || chr(9) || chr(10) || chr(13)) <> '' GROUP BY doc_id")
def sentences_per_doc(spark, sf_dir):
    return sentences_simple(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n"))


@query()
def regex_tokens(spark, sf_dir):
    """Tokens leave in batches of a few texts: those of 10,000 whole texts would not fit an executor."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 20):
                part = b.slice(at, 20)
                rows = [(i, k, t, c) for i, x in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) if x for k, (t, c) in enumerate(X.tokenize(unicodedata.normalize("NFC", x)))]
                cols = zip(*rows) if rows else ([], [], [], [])
                yield pa.RecordBatch.from_arrays([pa.array(list(v), kind) for v, kind in zip(cols, (part.column(0).type, pa.int32(), pa.string(), pa.string()))], names=["doc_id", "pos", "token", "cls"])

    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, pos int, token string, cls string")


SYLLABLES = ["anh", "ách", "giếng", "hương", "hoa", "tà", "tả", "tã", "tạ", "quốc", "truyền", "khách", "xyz"]


_TONE_SQL = "CASE " + " ".join(f"WHEN regexp_matches(l, '^[{v}]$') THEN '{k}'" for k, v in T.TONES.items()) + " ELSE 'level' END"
_ALLT = "".join(T.TONES.values())


@query(f"SELECT w, translate(lower(w), '{_ALLT}', '{T.LEVEL * 5}') AS base, {_TONE_SQL} AS tone FROM (SELECT w, regexp_extract(lower(w), '(?s).*([{_ALLT}])', 1) AS l FROM {W})")
def tone_analysis(spark, sf_dir):
    return words(spark, sf_dir).select("w", X.without_tone(F.lower("w")).alias("base"), X.tone(F.lower("w")).alias("tone"))


@query(f"SELECT w, len(list_filter(string_split(w, ' '), lambda p: left(p, 1) <> upper(left(p, 1)) OR left(p, 1) = 'ß')) = 0 AS title FROM {W}")
def is_title(spark, sf_dir):
    return words(spark, sf_dir).select("w", X.is_title("w").alias("title"))


@query(f"SELECT w, regexp_full_match(w, '[+-]?[0-9]+') AND coalesce(TRY_CAST(w AS HUGEINT) BETWEEN -2147483648 AND 2147483647, false) AS digit FROM (SELECT w FROM {W} UNION ALL SELECT unnest(['-3', '+7', '2147483648', ' 1', '1.5', '']))")
def is_digit(spark, sf_dir):
    more = spark.createDataFrame([(x,) for x in ("-3", "+7", "2147483648", " 1", "1.5", "")], "w string")
    return words(spark, sf_dir).unionByName(more).select("w", X.is_digit("w").alias("digit"))


@query(r"SELECT s, regexp_full_match(s, '\p{P}+') AS punct FROM (SELECT DISTINCT unnest(string_split_regex(text, '[\p{L}\p{N}\s]+')) AS s FROM documents) WHERE s <> ''")
def is_punct(spark, sf_dir):
    s = table(spark, sf_dir, "documents").select(F.explode(F.split("text", r"[\p{L}\p{N}\s]+")).alias("s")).where("s <> ''").distinct()
    return s.select("s", X.is_punct("s").alias("punct"))


@query(r"SELECT w, substr(x, k, 3) AS gram FROM (SELECT w, w AS x FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS w FROM benchmark)), LATERAL (SELECT unnest(range(1, greatest(length(x) - 2, 1) + 1)) AS k)")
def char_trigrams(spark, sf_dir):
    return words(spark, sf_dir, "benchmark").select("w", F.explode(X.char_ngrams("w", 3)).alias("gram"))


@query(r"""
WITH x AS (SELECT w, '<' || w || '>' AS x FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS w FROM benchmark))
SELECT w, substr(x, k, n) AS gram FROM x, LATERAL (SELECT unnest(range(3, 7)) AS n), LATERAL (SELECT unnest(range(1, length(x) - n + 2)) AS k) WHERE length(x) >= n AND substr(x, k, n) <> x""")
def subword_ngrams(spark, sf_dir):
    return words(spark, sf_dir, "benchmark").select("w", F.explode(X.subword_ngrams("w", 3, 6)).alias("gram"))


@query("""
SELECT l_orderkey, l_linenumber, round(sqrt(l_extendedprice), 6) AS sq, round(sin(l_discount), 9) AS si, round(cos(l_discount), 9) AS co, round(tan(l_discount), 9) AS ta, round(ln(l_extendedprice), 9) AS lg, round(log10(l_extendedprice), 9) AS l10,
 round(exp(l_tax), 9) AS ex, floor(l_extendedprice)::BIGINT AS fl, ceil(l_extendedprice)::BIGINT AS ce, round(pow(l_quantity, 2), 6) AS po, abs(l_discount - 1) AS ab, least(l_tax, l_discount) AS lo, greatest(l_tax, l_discount) AS hi FROM lineitem""")
def math_functions(spark, sf_dir):
    r = lambda c, n, a: F.round(c, n).alias(a)
    p, q, d, t = (F.col(f"l_{x}") for x in ("extendedprice", "quantity", "discount", "tax"))
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", r(F.sqrt(p), 6, "sq"), r(F.sin(d), 9, "si"), r(F.cos(d), 9, "co"), r(F.tan(d), 9, "ta"), r(F.ln(p), 9, "lg"), r(F.log10(p), 9, "l10"),
        r(F.exp(t), 9, "ex"), F.floor(p).alias("fl"), F.ceil(p).alias("ce"), r(F.pow(q, F.lit(2)), 6, "po"), F.abs(d - 1).alias("ab"), F.least(t, d).alias("lo"), F.greatest(t, d).alias("hi"),
    )


@query("""
WITH m AS (SELECT doc_id, max(v) AS m FROM (SELECT doc_id, quality::DOUBLE AS v FROM labels UNION ALL SELECT doc_id, toxic FROM labels) GROUP BY doc_id)
SELECT doc_id, round(exp(quality - m) / (exp(quality - m) + exp(toxic - m)), 9) AS p_quality, round(exp(toxic - m) / (exp(quality - m) + exp(toxic - m)), 9) AS p_toxic, round(1 / (1 + exp(-(quality - toxic))), 9) AS sig FROM labels JOIN m USING (doc_id)""")
def softmax(spark, sf_dir):
    from loomtext.operators.linear import softmax as soft

    x = F.array(F.col("quality").cast("double"), F.col("toxic").cast("double"))
    d = table(spark, sf_dir, "labels").withColumn("p", soft(x))
    return d.select("doc_id", F.round(F.get("p", F.lit(0)), 9).alias("p_quality"), F.round(F.get("p", F.lit(1)), 9).alias("p_toxic"), F.round(1 / (1 + F.exp(F.col("toxic") - F.col("quality"))), 9).alias("sig"))


@query(f"SELECT DISTINCT w, {_plain_sql('lower(w)')} AS key, count(*) OVER (PARTITION BY {_plain_sql('lower(w)')}) AS n FROM (SELECT DISTINCT lower(w) AS w FROM {W})")
def diacritic_candidates(spark, sf_dir):
    """Words by their spelling without marks, with the number of words that share it."""
    v = words(spark, sf_dir).select(F.lower("w").alias("w")).distinct().withColumn("key", X.remove_tone("w"))
    return v.join(v.groupBy("key").agg(F.count("*").alias("n")), "key").select("w", "key", "n")
