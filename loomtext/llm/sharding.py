"""Sharding along a Hilbert curve over document metadata, in DataFrame operations only.

Source, language and size are quantised to 32 steps each, of about equal rows. Sources and languages keep their order: whole
values are counted, and steps are cut along the ranked distinct values; sizes go by quantiles. So files cut from the curve hold narrow
ranges in all three and readers can skip them by any of these columns. Documents are ordered by curve index, then by a
hash, and runs of nearly equal bytes are cut as shards. The order is never gathered: sums per (cell, slot) are prefixed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.llm.common import materialize, running_sums

BITS = 5


def hilbert_index(dims: list[Column], bits: int = BITS) -> Column:
    """The curve index of a cell: each of ``dims`` an integer from 0 to 2**bits - 1.

    Skilling's transform, folded over bit planes from the highest to the lowest; then Gray coding; then bits interleaved.
    """
    n = len(dims)
    field = lambda k: f"x{k}"
    start = F.struct(*[d.cast("long").alias(field(k)) for k, d in enumerate(dims)])

    def plane(acc: Column, q: Column) -> Column:
        xs = [acc[field(k)] for k in range(n)]
        low = q - 1
        for k in range(n):
            swap = xs[0].bitwiseXOR(xs[k]).bitwiseAND(low)
            on = xs[k].bitwiseAND(q) > 0
            first = F.when(on, xs[0].bitwiseXOR(low)).otherwise(xs[0].bitwiseXOR(swap))
            other = F.when(on, xs[k]).otherwise(xs[k].bitwiseXOR(swap))
            xs[0] = first
            if k:
                xs[k] = other
        return F.struct(*[x.alias(field(k)) for k, x in enumerate(xs)])

    def finish(acc: Column) -> Column:
        xs = [acc[field(k)] for k in range(n)]
        for k in range(1, n):
            xs[k] = xs[k].bitwiseXOR(xs[k - 1])
        t = F.lit(0).cast("long")
        for b in range(bits - 1, 0, -1):
            t = F.when(xs[-1].bitwiseAND(F.lit(1 << b).cast("long")) > 0, t.bitwiseXOR(F.lit((1 << b) - 1).cast("long"))).otherwise(t)
        out = F.lit(0).cast("long")
        for b in range(bits):
            for k in range(n):
                bit = F.shiftright(xs[k].bitwiseXOR(t), b).bitwiseAND(F.lit(1).cast("long"))
                out = out.bitwiseOR(F.shiftleft(bit, b * n + (n - 1 - k)))
        return out

    planes = F.array(*[F.lit(1 << b).cast("long") for b in range(bits - 1, 0, -1)])
    return F.aggregate(planes, start, plane, finish)


def value_edges(docs: DataFrame, col: str, steps: int) -> list[str]:
    """The first value of each step but the lowest: distinct values in order, cut into ``steps`` of about equal rows.

    Values are counted first, so a hot one is one row; they are range-sorted and counts are prefixed by range, one row a range.
    """
    counts = docs.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("string").alias("value")).agg(F.count("*").alias("n"))
    counts = materialize(counts.repartitionByRange("value").withColumn("p", F.spark_partition_id()))
    ranges = counts.groupBy("p").agg(F.sum("n").alias("m"))
    ranges = ranges.select("p", F.coalesce(F.sum("m").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("b"), F.sum("m").over(Window.partitionBy()).alias("total"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("p").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = counts.withColumn("w", inside).join(F.broadcast(ranges), "p")
    # A value goes to the step in which the middle of its rows lies.
    step = F.least(F.floor((F.col("b") + F.col("w") + F.col("n") / 2) * steps / F.col("total")), F.lit(steps - 1))
    first = at.groupBy(step.alias("step")).agg(F.min("value").alias("value")).orderBy("step").collect()  # a row a step
    return [r.value for r in first[1:]]


def _at_most(value: Column):
    return lambda edge: edge <= value


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", bits: int = BITS) -> DataFrame:
    """(id_col, size, text_crc32, law, shard, slot, grown_shard, curve): runs of the curve of nearly equal bytes.

    Size is the text's UTF-8 bytes plus 1 (null text: 1, CRC that of no bytes). Null metadata count as step 0; sources and languages may be of any type that has a text. ``slot`` runs
    without gaps from 0 in each shard, along the curve. Rows equal in all columns read are interchangeable. A hot cell is
    cut like any run. An empty table gives no row; more shards than documents leave some shards empty.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = F.octet_length(text).cast("long") + 1
    slim = docs.select(F.col(id_col).alias("id"), size.alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"), F.col(source_col).cast("string").alias("d0"), F.col(lang_col).cast("string").alias("d1"), F.log2(size.cast("double")).alias("d2"))
    slim = materialize(slim)
    steps = 1 << bits
    probes = [i / steps for i in range(1, steps)]
    sizes = slim.agg(F.percentile_approx("d2", probes, 10000)).first()[0]
    dims = []
    for k, (edges, kind) in enumerate([(value_edges(slim, "d0", steps), "string"), (value_edges(slim, "d1", steps), "string"), (sorted(set(sizes or [])), "double")]):
        marks = F.array(*map(F.lit, edges)).cast(f"array<{kind}>")
        value = F.col(f"d{k}")
        dims.append(F.when(value.isNull(), F.lit(0)).otherwise(F.size(F.filter(marks, _at_most(value)))))
    cells = slim.select("id", "size", "text_crc32", F.xxhash64("id", "text_crc32", "size").alias("_h"), hilbert_index(dims, bits).alias("curve"), F.lit(1).cast("long").alias("one"))
    d = running_sums(cells, ["curve"], [F.col("_h"), F.col("id"), F.col("text_crc32"), F.col("size")], {"_bytes": "size", "_rows": "one"}, F.col("_h"))
    # One row a cell, of at most 2 ** (3 * bits): the only window without a partition.
    per_cell = cells.groupBy("curve").agg(F.sum("size").alias("_b"), F.count("*").alias("_n"))
    before = Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, -1)
    per_cell = per_cell.select(F.col("curve").alias("_c"), F.coalesce(F.sum("_b").over(before), F.lit(0)).alias("_b0"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), F.sum("_b").over(Window.partitionBy()).alias("_total"))
    d = d.join(per_cell, F.col("curve") == F.col("_c"))
    middle = (F.col("_b0") + F.col("_bytes")).cast("double") + F.col("size") / 2
    d = d.select("id", "size", "text_crc32", F.least(F.floor(middle * shards / F.col("_total")), F.lit(shards - 1)).cast("int").alias("shard"), (F.col("_n0") + F.col("_rows")).alias("_rank"), "curve")
    d = materialize(d)
    first = d.groupBy("shard").agg(F.min("_rank").alias("_first")).withColumnRenamed("shard", "_sh")
    d = d.join(F.broadcast(first), F.col("shard") == F.col("_sh"))  # one row a shard
    return d.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_rank") - F.col("_first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve")
