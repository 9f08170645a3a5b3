"""Queries over literal rows, with their answers: fixtures of the operators."""

# ruff: noqa: F401
from __future__ import annotations

import unicodedata
import pyarrow as pa
from pyspark.sql import functions as F
from loomtext.functions import tables as T
from loomtext.functions import text as X
from loomtext.operators import address as A
from loomtext.operators import lexicon as L

from tests.literals import query, table


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


@query(f"SELECT id, trim({_EXP}) AS expanded FROM {_ADDR}")
def expand_abbrev(spark, sf_dir):
    return addresses(spark).select("id", X.expand_abbreviations("address").alias("expanded"))


@query(f"""
WITH p AS (SELECT id, list_filter(list_transform(string_split(trim({_EXP}), ','), lambda x: trim(x)), lambda x: x <> '') AS p FROM {_ADDR}),
q AS (SELECT id, p, len(p) AS n, coalesce(p[-1], '') AS a, coalesce(p[-2], '') AS b, coalesce(p[-3], '') AS c FROM p),
r AS (SELECT *, n = 2 AND regexp_matches(b, '^(phường|xã|thị trấn)') AS w FROM q)
SELECT id, a AS province, CASE WHEN w THEN '' ELSE b END AS district, CASE WHEN w THEN b ELSE c END AS ward, CASE WHEN n >= 4 THEN array_to_string(p[1:n-3], ', ') ELSE '' END AS street FROM r""")
def address_parse(spark, sf_dir):
    return A.parse(addresses(spark), "address").drop("address")


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


@query("SELECT * FROM (VALUES (1, 'renamed', false), (2, 'merged', false), (3, 'merged', false), (4, 'divided', true), (5, 'divided', false), (6, 'unchanged', false)) t(seq, mapping_type, is_default)")
def admin_mapping_build(spark, sf_dir):
    return A.build_mapping(spark.createDataFrame(UNITS, UNIT_TYPES)).select("seq", "mapping_type", "is_default")


@query("SELECT * FROM (VALUES ('renamed', 1), ('merged', 2), ('divided', 2), ('unchanged', 1)) t(mapping_type, n)")
def admin_mapping_stats(spark, sf_dir):
    return admin_mapping_build(spark, sf_dir).groupBy("mapping_type").agg(F.count("*").cast("int").alias("n"))


@query("""
SELECT * FROM (VALUES
 (0, 'success', 'renamed', 'Phường Hồng Hà, Thành phố Hà Nội', ''),
 (1, 'success', 'renamed', 'Phường Hồng Hà, Thành phố Hà Nội', ''),
 (2, 'success', 'merged', '12 hàng bài, Phường Hoàn Kiếm, Thành phố Hà Nội', ''),
 (3, 'success', 'unchanged', 'Xã Cũ, Thành phố Hà Nội', ''),
 (4, 'partial', NULL, 'Thành phố Hà Nội', 'Province-only conversion'),
 (5, 'partial', NULL, 'Thành phố Hà Nội', 'Ward not found, province converted'),
 (6, 'not_found', NULL, '', 'Province not found: atlantis'),
 (7, 'partial', NULL, 'Thành phố Hà Nội', 'Ward not found, province converted'),
 (8, 'success', 'divided', 'Phường Một, Thành phố Hà Nội', 'Old ward was split; default new ward selected')) t(id, status, mapping_type, converted, note)""")
def address_convert(spark, sf_dir):
    prov = spark.createDataFrame(PROVINCES, "keyword string, seq int, old_province_key string, new_province string")
    return A.convert(addresses(spark), "address", prov, A.build_mapping(spark.createDataFrame(UNITS, UNIT_TYPES))).drop("address")


SOCIAL = ["sp ko đẹp lắm!!!", "xem www.x.vn nhé :) ok.", "KHÔNG tốt chút nào đâu", "hay quá.... tks!!", ""]


@query("SELECT * FROM (VALUES (0, 'sản phẩm không NEG_đẹp NEG_lắm!'), (1, 'xem nhé :) tốt'), (2, 'không NEG_tốt NEG_chút nào đâu'), (3, 'hay quá... cảm ơn'), (4, '')) t(id, out)")
def social_preprocess(spark, sf_dir):
    d = spark.createDataFrame(list(enumerate(SOCIAL)), "id int, text string")
    return X.with_social_preprocess(d, "text", "out").select("id", "out")


@query("SELECT * FROM (VALUES (0, 'Viện nghiên cứu', 'fixed_words'), (1, 'chiến lược', 'fixed_words'), (2, 'quốc', 'word'), (3, 'gia', 'word'), (4, '1.500', 'number'), (5, '=>', 'special')) t(pos, token, cls)")
def fixed_word_tokens(spark, sf_dir):
    d = spark.createDataFrame([("Viện nghiên cứu chiến lược quốc gia 1.500 =>",)], "text string")
    return d.select(F.posexplode(X.regex_tokens("text", ("Viện nghiên cứu", "chiến lược"))).alias("pos", "x")).select("pos", "x.token", "x.cls")


SYLLABLES = ["anh", "ách", "giếng", "hương", "hoa", "tà", "tả", "tã", "tạ", "quốc", "truyền", "khách", "xyz"]


@query("SELECT * FROM (VALUES ('anh', '', '', 'a', 'nh'), ('ách', '', '', 'a', 'ch'), ('giếng', 'gi', '', 'ê', 'ng'), ('hương', 'h', '', 'ươ', 'ng'), ('hoa', 'h', 'o', 'a', ''), ('tà', 't', '', 'a', ''), ('tả', 't', '', 'a', ''), ('tã', 't', '', 'a', ''), ('tạ', 't', '', 'a', ''), ('quốc', 'qu', '', 'ô', 'c'), ('truyền', 'tr', 'u', 'yê', 'n'), ('khách', 'kh', '', 'a', 'ch')) t(s, onset, glide, vowel, coda)")
def syllable_parts(spark, sf_dir):
    d = spark.createDataFrame([(s,) for s in SYLLABLES], "s string").withColumn("p", X.syllable_parts("s"))
    return d.where("p IS NOT NULL").select("s", "p.*")


@query("SELECT * FROM (VALUES ('anh', 'ʔɛŋ³³'), ('ách', 'ʔɛk⁴⁵'), ('giếng', 'ziəŋ²⁴'), ('hương', 'hɨəŋ³³'), ('hoa', 'hʷa³³'), ('tà', 'ta³²'), ('tả', 'ta³¹²'), ('tã', 'ta³ˀ⁵'), ('tạ', 'ta²¹ˀ'), ('quốc', 'kʷok⁴⁵'), ('truyền', 'tɕʷiən³²'), ('khách', 'xɛk⁴⁵'), ('xyz', '')) t(s, ipa)")
def syllable_ipa(spark, sf_dir):
    return spark.createDataFrame([(s,) for s in SYLLABLES], "s string").select("s", X.syllable_ipa("s", eight=True).alias("ipa"))


@query("SELECT * FROM (VALUES (0, 'ao'), (1, 'áo'), (2, 'ăn'), (3, 'âm'), (4, 'đi'), (5, 'ếch'), (6, 'y')) t(r, w)")
def vi_sort(spark, sf_dir):
    from loomtext.operators.lexicon import dense_ids

    d = spark.createDataFrame([(w,) for w in ("y", "ếch", "đi", "âm", "ăn", "áo", "ao")], "w string").withColumn("k", X.vi_sort_key("w"))
    return dense_ids(d, ["k", "w"]).select(F.col("rank").cast("int").alias("r"), "w")


@query("SELECT * FROM (VALUES ('HA', 'hà', 'HÀ'), ('H', 'hà', 'Hà'), ('Ha', 'hà', 'Hà'), ('ha', 'hà', 'hà'), ('1', 'hà', 'hà')) t(shape, word, out)")
def match_case(spark, sf_dir):
    d = spark.createDataFrame([(s, "hà") for s in ("HA", "H", "Ha", "ha", "1")], "shape string, word string")
    return d.select("shape", "word", X.match_case("shape", "word").alias("out"))
