"""Addresses of customers, and the mapping of old to new units of suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext.functions import tables as T
from loomtext.functions import text as X
from loomtext.operators import address as A
from loomtext.plans.catalog import query, table

WARDS = ["Phúc Xá", "Tràng Tiền", "Hàng Bài", "Chia", "Lạ", "Cũ"]
DISTRICTS = ["Ba Đình", "Hoàn Kiếm", "Lạ"]
PROVINCES = ["Hà Nội", "TP. Hà Nội", "hà nội", "Atlantis", "Thành phố Hà Nội"]
_ARRAY = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
#: Written out in one to four parts, with and without short forms.
ADDRESS = f"""
(SELECT c_custkey AS id, array_to_string(list_filter([
   CASE WHEN k % 5 = 0 THEN k || ' ' || c_mktsegment END,
   CASE WHEN k % 7 <> 1 THEN list_extract(['P. ', 'Phường ', 'phường ', 'xã '], (k % 4 + 1)::INT) || list_extract({_ARRAY(WARDS)}, (k % 6 + 1)::INT) END,
   CASE WHEN k % 11 > 1 THEN list_extract(['Q. ', 'Quận ', 'quận '], (k % 3 + 1)::INT) || list_extract({_ARRAY(DISTRICTS)}, ((k // 3) % 3 + 1)::INT) END,
   list_extract({_ARRAY(PROVINCES)}, ((k // 7) % 5 + 1)::INT)], lambda x: x IS NOT NULL), ', ') AS address FROM (SELECT *, c_custkey AS k FROM customer)) t"""
_EXP = "lower(trim(address))"
for _k, _v in sorted(T.ADDRESS_ABBREVIATIONS.items(), key=lambda x: -len(x[0])):
    _EXP = f"replace({_EXP}, '{_k}', '{_v}')"


def addresses(spark, sf_dir):
    k = F.col("c_custkey")
    pick = lambda xs, i: F.get(F.array(*map(F.lit, xs)), i.cast("int"))
    parts = F.array(
        F.when(k % 5 == 0, F.concat_ws(" ", k.cast("string"), "c_mktsegment")),
        F.when(k % 7 != 1, F.concat(pick(["P. ", "Phường ", "phường ", "xã "], k % 4), pick(WARDS, k % 6))),
        F.when(k % 11 > 1, F.concat(pick(["Q. ", "Quận ", "quận "], k % 3), pick(DISTRICTS, F.floor(k / 3) % 3))),
        pick(PROVINCES, F.floor(k / 7) % 5),
    )
    return table(spark, sf_dir, "customer").select(k.alias("id"), F.array_join(F.array_compact(parts), ", ").alias("address"))


@query(f"SELECT id, trim({_EXP}) AS expanded FROM {ADDRESS}")
def expand_abbrev(spark, sf_dir):
    return addresses(spark, sf_dir).select("id", X.expand_abbreviations("address").alias("expanded"))


PARSED = f"""
WITH p AS (SELECT id, list_filter(list_transform(string_split(trim({_EXP}), ','), lambda x: trim(x)), lambda x: x <> '') AS p FROM {ADDRESS}),
q AS (SELECT id, p, len(p) AS n, coalesce(p[-1], '') AS a, coalesce(p[-2], '') AS b, coalesce(p[-3], '') AS c FROM p),
r AS (SELECT *, n = 2 AND regexp_matches(b, '^(phường|xã|thị trấn)') AS w FROM q),
parsed AS (SELECT id, a AS province, CASE WHEN w THEN '' ELSE b END AS district, CASE WHEN w THEN b ELSE c END AS ward, CASE WHEN n >= 4 THEN array_to_string(p[1:n-3], ', ') ELSE '' END AS street FROM r)"""


@query(PARSED + " SELECT * FROM parsed")
def address_parse(spark, sf_dir):
    return A.parse(addresses(spark, sf_dir), "address").drop("address")


#: Old wards of suppliers, some of which went to several new ones or were joined; each record by its first supplier.
UNITS = """
u AS (SELECT min(s_suppkey) AS seq, 'hanoi' AS op, od, ow, 'Hà Nội' AS np, nw FROM (SELECT s_suppkey, 'quan' || d AS od, 'phuong' || l AS ow,
   CASE k WHEN 4 THEN 'Phường chia ' || s_suppkey % 2 || l WHEN 5 THEN 'Phường chung ' || d WHEN 6 THEN 'Phường chung ' || d WHEN 7 THEN 'Phường mới ' || l ELSE 'Phường ' || l END AS nw
   FROM (SELECT s_suppkey, (s_suppkey // 9) % 3 AS d, s_suppkey % 9 AS k, (s_suppkey % 9) * 10 + (s_suppkey // 9) % 3 AS l FROM supplier)) GROUP BY od, ow, nw),
m AS (SELECT *, count(*) OVER (PARTITION BY op, od, ow) AS n_old, count(*) OVER (PARTITION BY np, nw) AS n_new, row_number() OVER (PARTITION BY op, od, ow ORDER BY seq) AS r FROM u),
g AS (SELECT seq, op, od, ow, nw, CASE WHEN n_old > 1 THEN 'divided' WHEN n_new > 1 THEN 'merged' WHEN regexp_replace(strip_accents(lower(nw)), '[^a-z0-9]', '', 'g') = ow THEN 'unchanged' ELSE 'renamed' END AS mapping_type, n_old > 1 AND r = 1 AS is_default FROM m)"""


def units(spark, sf_dir):
    k = F.col("s_suppkey")
    d, l = (F.floor(k / 9) % 3).cast("string"), ((k % 9) * 10 + F.floor(k / 9) % 3).cast("string")
    say = lambda name, *xs: F.concat(F.lit(f"Phường {name}"), *xs)
    new = F.when(k % 9 == 4, say("chia ", (k % 2).cast("string"), l)).when((k % 9).isin(5, 6), say("chung ", d)).when(k % 9 == 7, say("mới ", l)).otherwise(say("", l))
    d = table(spark, sf_dir, "supplier").select(k.alias("seq"), F.lit("hanoi").alias("old_province_key"), F.concat(F.lit("quan"), d).alias("old_district_key"), F.concat(F.lit("phuong"), l).alias("old_ward_key"), F.lit("Hà Nội").alias("new_province"), new.alias("new_ward"))
    return d.groupBy(*d.columns[1:]).agg(F.min("seq").alias("seq"))


@query("WITH " + UNITS + " SELECT seq, mapping_type, is_default FROM g")
def admin_mapping_build(spark, sf_dir):
    return A.build_mapping(units(spark, sf_dir)).select("seq", "mapping_type", "is_default")


@query("WITH " + UNITS + " SELECT mapping_type, count(*) AS n FROM g GROUP BY mapping_type")
def admin_mapping_stats(spark, sf_dir):
    return admin_mapping_build(spark, sf_dir).groupBy("mapping_type").agg(F.count("*").alias("n"))


_KEY = lambda c: f"regexp_replace(replace(strip_accents(lower(trim({c}))), 'đ', 'd'), '[^a-z0-9]', '', 'g')"
#: Old wards by name, two of them as they are named in the addresses.
NAMED = [(1, "quanbadinh", "phuongphucxa", "Phường Hồng Hà"), (2, "quanhoankiem", "phuongtrangtien", "Phường Hoàn Kiếm"), (3, "quanhoankiem", "phuonghangbai", "Phường Hoàn Kiếm"), (4, "quanbadinh", "phuongchia", "Phường Một"), (5, "quanbadinh", "phuongchia", "Phường Hai"), (6, "huyencu", "xacu", "Xã Cũ")]
KINDS = ["renamed", "merged", "merged", "divided", "divided", "unchanged"]


@query(PARSED + f""", k AS (SELECT *, {_KEY('province')} AS kp, {_KEY('district')} AS kd, {_KEY('ward')} AS kw FROM parsed),
m(seq, d, w, nw, kind) AS (VALUES {", ".join(f"({a}, '{b}', '{c}', '{d}', '{e}')" for (a, b, c, d), e in zip(NAMED, KINDS) if a != 5)}),
f AS (SELECT k.*, kp IN ('hanoi', 'thanhphohanoi') OR (district <> '' AND kd IN ('hanoi', 'thanhphohanoi')) AS found, ward = '' AND district = '' AS alone,
  coalesce((SELECT m.seq FROM m WHERE m.d = kd AND m.w = kw), (SELECT m.seq FROM m WHERE m.w = kw), CASE WHEN ward <> '' THEN (SELECT m.seq FROM m WHERE m.w = kd) END) AS s FROM k)
SELECT id, CASE WHEN NOT found THEN 'not_found' WHEN alone OR s IS NULL THEN 'partial' ELSE 'success' END AS status, CASE WHEN found AND NOT alone THEN kind END AS mapping_type,
  CASE WHEN NOT found THEN '' WHEN alone THEN 'Thành phố Hà Nội' ELSE array_to_string(list_filter([street, CASE WHEN s IS NULL THEN '' ELSE nw END, 'Thành phố Hà Nội'], lambda x: x <> ''), ', ') END AS converted,
  CASE WHEN NOT found THEN 'Province not found: ' || province WHEN alone THEN 'Province-only conversion' WHEN s IS NULL THEN 'Ward not found, province converted' WHEN kind = 'divided' THEN 'Old ward was split; default new ward selected' ELSE '' END AS note
FROM f LEFT JOIN m ON f.s = m.seq""")
def address_convert(spark, sf_dir):
    prov = spark.createDataFrame([("hanoi", 1, "hanoi", "Thành phố Hà Nội"), ("thanhphohanoi", 2, "hanoi", "Thành phố Hà Nội")], "keyword string, seq int, old_province_key string, new_province string")
    m = spark.createDataFrame([(a, "hanoi", b, c, "Hà Nội", d) for a, b, c, d in NAMED], "seq int, old_province_key string, old_district_key string, old_ward_key string, new_province string, new_ward string")
    return A.convert(addresses(spark, sf_dir), "address", prov, A.build_mapping(m)).drop("address")
