"""Administrative addresses: parse, build the mapping of old to new units, convert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions import text as X
from loomtext.functions.tables import WARD_PREFIXES


def parse(df: DataFrame, address: str) -> DataFrame:
    """Add street, ward, district, province (empty where missing), read from the right; of two parts, the first is a ward
    if it starts as one."""
    parts = F.filter(F.transform(F.split(X.expand_abbreviations(address), ","), lambda p: F.trim(p)), lambda p: p != "")
    d = df.withColumn("_p", parts).withColumn("_n", F.size("_p"))
    at = lambda k: F.coalesce(F.try_element_at("_p", F.lit(-k)), F.lit(""))
    ward2 = (F.col("_n") == 2) & at(2).rlike(f"^({'|'.join(WARD_PREFIXES)})")
    street = F.when(F.col("_n") >= 4, F.array_join(F.slice("_p", 1, F.col("_n") - 3), ", ")).otherwise(F.lit(""))
    return d.withColumns({"province": at(1), "district": F.when(ward2, F.lit("")).otherwise(at(2)), "ward": F.when(ward2, at(2)).otherwise(at(3)), "street": street}).drop("_p", "_n")


def joined(street: Column, ward: Column, district: Column, province: Column) -> Column:
    return F.concat_ws(", ", *[F.nullif(x, F.lit("")) for x in (street, ward, district, province)])


def build_mapping(records: DataFrame) -> DataFrame:
    """Classify (seq, old_*, new_*) records: divided if an old ward went to several new ones, merged if a new ward has
    several old ones, else renamed or unchanged by name; the first of a divided ward is its default."""
    old = Window.partitionBy("old_province_key", "old_district_key", "old_ward_key")
    new = Window.partitionBy("new_province", "new_ward")
    d = records.withColumn("_o", F.count("*").over(old)).withColumn("_n", F.count("*").over(new)).withColumn("_r", F.row_number().over(old.orderBy("seq")))
    kind = F.when(F.col("_o") > 1, "divided").when(F.col("_n") > 1, "merged").when(X.normalize_key("new_ward") == F.col("old_ward_key"), "unchanged").otherwise("renamed")
    return d.select(*records.columns, kind.alias("mapping_type"), ((F.col("_o") > 1) & (F.col("_r") == 1)).alias("is_default"))


def convert(df: DataFrame, address: str, provinces: DataFrame, mapping: DataFrame) -> DataFrame:
    """Add status, mapping_type, converted, note to parsed addresses.

    ``provinces``: (keyword, seq, old_province_key, new_province), later keywords win. ``mapping``: see build_mapping. The
    dimension tables have a row per administrative unit, some ten thousand in all, so they are broadcast; addresses are
    not shuffled. A ward is found by province, district and ward, else by province and ward, else by what stands in
    the district's place.
    """
    d = parse(df, address)
    for k in ("province", "district", "ward"):
        d = d.withColumn(f"_k_{k}", X.normalize_key(k))
    kw = provinces.groupBy("keyword").agg(F.max_by(F.struct("old_province_key", "new_province"), "seq").alias("v")).select("keyword", "v.*")
    for n, key in enumerate(("province", "district")):
        side = F.broadcast(kw.select(F.col("keyword").alias(f"_k_{key}"), F.col("old_province_key").alias(f"_op{n}"), F.col("new_province").alias(f"_np{n}")))
        d = d.join(side, f"_k_{key}", "left")
    by_district = (F.col("_op0").isNull()) & (F.col("district") != "")
    d = d.withColumn("_op", F.coalesce("_op0", F.when(by_district, F.col("_op1")))).withColumn("_np", F.coalesce("_np0", F.when(by_district, F.col("_np1"))))
    best = F.min_by(F.struct("new_ward", "mapping_type"), F.struct(~F.col("is_default"), F.col("seq")))
    exact = mapping.groupBy(F.col("old_province_key").alias("_op"), F.col("old_district_key").alias("_k_district"), F.col("old_ward_key").alias("_k_ward")).agg(best.alias("_m1"))
    loose = mapping.groupBy(F.col("old_province_key").alias("_op"), F.col("old_ward_key").alias("_k_ward")).agg(best.alias("_m2"))
    third = loose.select("_op", F.col("_k_ward").alias("_k_district"), F.col("_m2").alias("_m3"))
    d = d.join(F.broadcast(exact), ["_op", "_k_district", "_k_ward"], "left").join(F.broadcast(loose), ["_op", "_k_ward"], "left").join(F.broadcast(third), ["_op", "_k_district"], "left")
    m = F.coalesce("_m1", "_m2", F.when(F.col("ward") != "", F.col("_m3")))
    found = F.col("_op").isNotNull()
    only = (F.col("ward") == "") & (F.col("district") == "")
    d = d.withColumn("_m", m)
    status = F.when(~found, "not_found").when(only | F.col("_m").isNull(), "partial").otherwise("success")
    none = F.lit("")
    converted = F.when(~found, none).when(only, F.col("_np")).when(F.col("_m").isNull(), joined(F.col("street"), none, none, F.col("_np"))).otherwise(joined(F.col("street"), F.col("_m.new_ward"), none, F.col("_np")))
    note = (
        F.when(~found, F.concat(F.lit("Province not found: "), F.col("province")))
        .when(only, "Province-only conversion")
        .when(F.col("_m").isNull(), "Ward not found, province converted")
        .when(F.col("_m.mapping_type") == "divided", "Old ward was split; default new ward selected")
        .otherwise("")
    )
    kind = F.when(found & ~only, F.col("_m.mapping_type"))
    return d.select(*df.columns, status.alias("status"), kind.alias("mapping_type"), converted.alias("converted"), note.alias("note"))
