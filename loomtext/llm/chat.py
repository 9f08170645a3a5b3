"""Chat formatting: collapse cumulative snapshots of one conversation, then render, in DataFrame operations only.

Logs often hold a conversation again and again, each time with more turns. Every turn gets rolling hashes of all turns up
to it (two 64-bit hashes of position, role and text, combined by exclusive or). A conversation whose whole hash is the
hash of a proper prefix of another is a snapshot of it: an anti-join drops it. Of conversations that are equal the one
with the smallest id stays. The rest is rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.llm.common import materialize

#: Turns in a rendered segment: a conversation without bound is rendered in several rows.
SEGMENT = 1024


def rolling_prefixes(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, pos, role, text, h1, h2): turns numbered from 1 and the hashes of turns 1 to pos.

    Turns are ordered by turn number, null last, then role and text. A conversation is first summed in blocks of SEGMENT
    turn numbers, so one that holds a third of all rows is no single task. Rows repeated in all of these count once (a
    turn that was logged twice).
    """
    t = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")).distinct()
    t = t.withColumn("block", F.floor(F.col("turn") / SEGMENT))
    keys = ["conv", "block"]
    order = [F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_last(), F.col("text").asc_nulls_last()]
    t = t.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    blocks = t.groupBy(*keys).agg(F.count("*").alias("_n"))
    up_to = Window.partitionBy("conv").orderBy(F.col("block").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("conv").alias("_c"), F.col("block").alias("_b"), F.coalesce(F.sum("_n").over(up_to), F.lit(0)).alias("_at"))
    t = t.join(blocks, F.col("conv").eqNullSafe(F.col("_c")) & F.col("block").eqNullSafe(F.col("_b"))).withColumn("pos", (F.col("_k") + F.col("_at")).cast("long"))
    item = lambda salt: F.xxhash64(F.lit(salt), "pos", F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit("")))
    inside = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("_i1", item("a")).withColumn("_i2", item("b"))
    t = t.withColumn("_r1", F.bit_xor("_i1").over(inside)).withColumn("_r2", F.bit_xor("_i2").over(inside))
    sums = t.groupBy(*keys).agg(F.bit_xor("_i1").alias("_x1"), F.bit_xor("_i2").alias("_x2"))
    zero = F.lit(0).cast("long")
    sums = sums.select(F.col("conv").alias("_c2"), F.col("block").alias("_b2"), F.coalesce(F.bit_xor("_x1").over(up_to), zero).alias("_y1"), F.coalesce(F.bit_xor("_x2").over(up_to), zero).alias("_y2"))
    t = t.join(sums, F.col("conv").eqNullSafe(F.col("_c2")) & F.col("block").eqNullSafe(F.col("_b2")))
    return t.select("conv", "pos", "role", "text", F.col("_r1").bitwiseXOR(F.col("_y1")).alias("h1"), F.col("_r2").bitwiseXOR(F.col("_y2")).alias("h2"))


def maximal(prefixes: DataFrame) -> DataFrame:
    """(conv, turns, copies): the conversations that are no proper prefix of another; of equal ones the smallest id, with their number."""
    ends = prefixes.groupBy("conv").agg(F.max_by(F.struct("h1", "h2"), "pos").alias("h"), F.max("pos").alias("turns"))
    whole = ends.groupBy("h", "turns").agg(F.min("conv").alias("conv"), F.count("*").alias("copies"))
    # A prefix of length pos is proper if some conversation goes on after it: each row but a conversation's last.
    last = ends.select(F.col("conv").alias("_c"), F.col("turns").alias("_t"))
    proper = prefixes.join(last, F.col("conv").eqNullSafe(F.col("_c"))).where(F.col("pos") < F.col("_t")).select(F.struct("h1", "h2").alias("h"), F.col("pos").alias("turns")).distinct()
    return whole.join(proper, ["h", "turns"], "left_anti").select("conv", "turns", "copies")


def turn_markup(role: Column, text: Column) -> Column:
    """A turn between marks. The opening of a mark inside a role or text is parted by a space: a text forges no turn."""
    plain = lambda c, d: F.replace(F.coalesce(c, F.lit(d)), F.lit("<|im_"), F.lit("< |im_"))
    return F.concat(F.lit("<|im_start|>"), plain(role, "user"), F.lit("\n"), plain(text, ""), F.lit("<|im_end|>\n"))


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, segment, turns, copies, rendered) of the maximal conversations.

    A null role is rendered as user, a null text as empty; in comparisons null differs from every text. A null id is one
    conversation. Marks inside texts are parted by a space. ``rendered`` joins at most SEGMENT turns; segments from 0 up, one after another, are the whole conversation.
    Extra columns are not read. An empty table gives no row.
    """
    p = materialize(rolling_prefixes(turns, conv, turn, role, text))
    top = maximal(p).withColumnRenamed("conv", "_c")
    d = p.join(top, F.col("conv").eqNullSafe(F.col("_c"))).withColumn("segment", F.floor((F.col("pos") - 1) / SEGMENT).cast("int"))
    lines = F.array_sort(F.collect_list(F.struct("pos", turn_markup(F.col("role"), F.col("text")).alias("line"))))
    d = d.groupBy("conv", "segment").agg(F.first("turns").alias("turns"), F.first("copies").alias("copies"), F.array_join(F.transform(lines, lambda x: x["line"]), "").alias("rendered"))
    return d.select(F.col("conv").alias(conv), "segment", "turns", "copies", "rendered")
