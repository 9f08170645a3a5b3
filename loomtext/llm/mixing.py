"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a shuffled order (a seeded hash of the document). A document's virtual finish
time is the tokens its source has queued up to its end, divided by the source's target. Every source is queued again and
again, up to MOST times its size, and nothing of it is clipped beforehand. Sources are served as in fluid fair queueing: from
its virtual start to its finish a document gets its words at its source's rate. The mix is ordered by virtual finish time
over all sources (a range sort); the words served in each range are summed over all sources, and the mix is cut off at the
virtual time at which the total budget is used up. A document in service then counts with the words it has had.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.llm.common import materialize, running_sums, shuffle_partitions

WEIGHTS = (3.0, 1.0, 2.0)
BUDGET = 1.5
MOST = 2.0
SEED = 17
#: Ranges of the sort by virtual finish time, at least; four for each shuffle partition if that is more.
RANGES = 256


def word_count(text: str) -> Column:
    """Runs of characters other than space and 0x09-0x0D; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """(source, source_size) -> with target: weights by code point order of the source, null last, repeating.

    The targets share ``budget`` times all sizes by weight, stop at ``most`` times the source's size, and what a stopped
    source leaves is shared again by weight. A source is stopped at a level (size to weight ratio) below the common one, so
    one pass over sources in that ratio's order finds the level: windows over one row a source.
    """
    rank = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.array(*[F.lit(float(x)) for x in weights])
    d = sizes.withColumn("_n", F.row_number().over(rank) - 1).withColumn("_w", F.get(w, F.col("_n") % len(weights)))
    d = d.withColumn("_cap", most * F.col("source_size")).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    every = Window.partitionBy()
    before = Window.orderBy("_ratio", "_n").rowsBetween(Window.unboundedPreceding, -1)
    since = Window.orderBy("_ratio", "_n").rowsBetween(0, Window.unboundedFollowing)
    d = d.withColumn("_budget", budget * F.sum("source_size").over(every))
    d = d.withColumn("_level", (F.col("_budget") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(since))
    d = d.withColumn("_open", F.when(F.col("_ratio") > F.col("_level"), F.col("_level")))
    level = F.max("_open").over(every)  # the first open source has the highest; later ones count their forerunners as stopped
    d = d.withColumn("target", F.least(F.col("_cap"), F.coalesce(F.col("_w") * level, F.col("_cap"))))
    return d.select("source", "source_size", "target")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, most: float = MOST, seed: int = SEED, shuffled_by: str | None = None) -> DataFrame:
    """One row a document: id_col, source, size, source_size, target, finish, first_taken, second_taken, taken, mix_offset.

    ``finish`` is the virtual finish time in the first round of its source (the second adds source_size / target), ``taken``
    the tokens the mix takes over both rounds, ``mix_offset`` the tokens before the document in the mix (null: not taken). Sizes are words of the whole text, 0 for a null or empty one: such documents
    are taken with 0. A null source is a source of its own. Repeated rows are separate documents; rows equal in id, size and
    source are interchangeable. The order hangs on the seed and the rows alone, so reruns agree. Extra columns are not read.
    ``shuffled_by``: what is hashed with the text for a source's order, the id if not given.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"), F.xxhash64(F.lit(seed), F.col(shuffled_by or id_col), F.col(text_col)).alias("_h"))
    slim = materialize(slim.withColumn("_row", F.monotonically_increasing_id()))  # fixed by being written
    targets = materialize(source_targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, budget, most))
    queued = running_sums(slim, ["source"], [F.col("_h"), F.col("id"), F.col("size"), F.col("_row")], {"_before": "size"}, F.col("_h"))
    t = targets.select(F.col("source").alias("_s"), "source_size", "target")
    d = queued.join(t, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    finish = F.when(F.col("target") > 0, (F.col("_before") + F.col("size")) / F.col("target")).otherwise(F.lit(0.0))
    d = materialize(d.select("_row", "id", "source", "size", "source_size", "target", finish.alias("finish"), "_before"))
    cut = cut_time(d, float(targets.agg(F.sum("target")).first()[0] or 0.0))
    quota = F.floor(F.col("target") * F.lit(cut) + 0.5)
    served = lambda round_: F.least(F.greatest(quota - F.col("_before") - (round_ - 1) * F.col("source_size"), F.lit(0)), F.col("size")).cast("long")
    d = d.withColumn("first_taken", served(1)).withColumn("second_taken", served(2))
    d = d.join(_offsets(d), "_row", "left")
    return d.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "finish", "first_taken", "second_taken", (F.col("first_taken") + F.col("second_taken")).alias("taken"), "mix_offset")


def _rounds(d: DataFrame, *more: str) -> DataFrame:
    """(_row, round, begin, at, *more) of both rounds of all documents with words: virtual start and finish times."""
    w = [F.struct(F.lit(k).alias("round"), ((F.col("_before") + (k - 1) * F.col("source_size")) / F.col("target")).alias("begin"), (F.col("finish") + (k - 1) * F.col("source_size") / F.col("target")).alias("at")) for k in (1, 2)]
    return d.where("size > 0 AND target > 0").select("_row", *more, F.explode(F.array(*w)).alias("x")).select("_row", *more, "x.*")


def cut_time(d: DataFrame, budget: float) -> float:
    """The virtual time at which the words served to all rounds add up to ``budget``.

    Words served are summed by ranges of virtual time (a document's share of each range that its service meets), prefixed over
    one row a range, and within the range that crosses the budget taken as even. Targets that add up to the budget and reach no
    source's end put it at 1, but for rounding, which counts as 1.
    """
    ranges = RANGES
    e = _rounds(d, "target").withColumn("_p", F.explode(F.sequence(F.floor(F.col("begin") * ranges), F.greatest(F.floor(F.col("begin") * ranges), F.ceil(F.col("at") * ranges) - 1))))
    part = F.greatest(F.least("at", (F.col("_p") + 1) / ranges) - F.greatest("begin", F.col("_p") / ranges), F.lit(0.0)) * F.col("target")
    sums = e.groupBy("_p").agg(F.sum(part).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))  # a row a range
    over = sums.withColumn("b", before).where((F.col("b") + F.col("n") >= budget * (1 - 1e-9)) & (F.col("n") > 0)).orderBy("_p").first()
    if over is None:
        return MOST * 1e9 if budget > 0 else 0.0  # everything is served
    cut = (over["_p"] + min(1.0, max(0.0, budget - over["b"]) / over["n"])) / ranges
    return 1.0 if abs(cut - 1) < 1e-6 else cut


def _offsets(d: DataFrame) -> DataFrame:
    """(_row, mix_offset): the words before a document in the mix, its taken rounds range-sorted by virtual finish time. Ranges of
    equal width hold about equal words; their sums are prefixed, one row a range."""
    e = _rounds(d, "first_taken", "second_taken").withColumn("t", F.when(F.col("round") == 1, F.col("first_taken")).otherwise(F.col("second_taken"))).where("t > 0")
    ranges = max(RANGES, 4 * shuffle_partitions(d.sparkSession))
    e = e.withColumn("_p", F.floor(F.col("at") * ranges).cast("long"))
    sums = e.groupBy("_p").agg(F.sum("t").alias("_n"))
    sums = sums.select(F.col("_p").alias("_q"), F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    inside = Window.partitionBy("_p").orderBy("at", "_row", "round").rowsBetween(Window.unboundedPreceding, -1)
    e = e.withColumn("_w", F.coalesce(F.sum("t").over(inside), F.lit(0))).join(F.broadcast(sums), F.col("_p") == F.col("_q"))  # a row a range
    return e.groupBy("_row").agg(F.min((F.col("_b") + F.col("_w")).cast("long")).alias("mix_offset"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **kw) -> DataFrame:
    """The mix as whole documents with all columns of ``docs``, range-sorted by virtual finish time.

    A document stands once for each round in which at least half of its words were served before the cut; documents without
    words, and documents without an id (they cannot be named), stay once. Ids may be repeated: rows are told apart by id and a
    hash of text and source; rows equal in these stand equally often, their mean rounded.
    """
    own = lambda x: f"__loomtext_mixing_{x}"
    row, copies, finish, turn, no = (own(x) for x in ("row", "copies", "finish", "round", "copy"))
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col), F.col(source_col).isNull(), F.col(source_col)).alias("h"))
    named = docs.where(F.col(id_col).isNotNull())
    m = mix(named.select(key.alias(row), F.col(text_col), F.col(source_col)), row, text_col, source_col, shuffled_by=f"{row}.id", **kw)
    half = lambda c: (F.col(c) * 2 >= F.col("size")).cast("int")
    n = F.when(F.col("size") == 0, F.lit(1)).otherwise(half("first_taken") + F.when(F.col("second_taken") > 0, half("second_taken")).otherwise(0))
    m = m.groupBy(row).agg(F.round(F.avg(n)).cast("int").alias(copies), F.min("finish").alias(finish), F.first(F.col("source_size") / F.nullif(F.col("target"), F.lit(0.0))).alias(turn)).where(F.col(copies) > 0)
    d = named.join(m, key == F.col(row)).withColumn(no, F.explode(F.sequence(F.lit(1), F.col(copies))))
    d = d.withColumn(finish, F.col(finish) + (F.col(no) - 1) * F.coalesce(turn, F.lit(0.0)))
    d = d.unionByName(docs.where(F.col(id_col).isNull()), allowMissingColumns=True)
    return d.repartitionByRange(F.col(finish), F.xxhash64(F.col(id_col))).sortWithinPartitions(finish).select(*[F.col(f"`{c}`") for c in docs.columns])
