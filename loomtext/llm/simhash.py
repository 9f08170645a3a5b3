"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Every distinct fingerprint emits all variants within half the radius (2 of 4 bits: 2,081 of them). Two fingerprints that
differ in at most 4 bits share a variant, and two that share one differ in at most 4: the candidate set is exact.
Variants are shuffled by their leading bits: a row (prefix, fingerprint) stands for all variants of that fingerprint
under that prefix, so 79 rows travel where 2,081 would, and the rest is spelled out in the receiving task. Prefixes that
very many near copies share are split by further bits. There
colliding fingerprints are linked to the smallest of their variant (a star, never all pairs), links are deduplicated and
verified by their bit distance and reduced to a forest. Components follow by star contraction over the fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, comb, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import materialize, shuffle_partitions
from loomtext.llm.components import connected_components, forest

RADIUS = 4
SHINGLE = 4
SEED = 42
#: Variants spelled out at once in a task, about.
CHUNK = 500_000
#: Variants under one prefix from which on it is split by its next STEP bits: among tasks, then within a task.
HEAVY = 8_000_000
STEP = 8
#: Heavy prefixes are broadcast up to this number (8 MB); beyond it the joins are shuffled.
BROADCAST_PREFIXES = 1_000_000
#: Dropped documents (id and hash, 16 MB) are broadcast up to this number; beyond it the join is shuffled.
BROADCAST_IDS = 1_000_000


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit fingerprint, as an unsigned int, of one text."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxh64_intdigest(b" ".join(words), seed)
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - shingle + 1].tolist()
    h = np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist())], np.uint64)
    total = np.zeros(64, np.int64)
    for i in range(0, len(h), 65536):
        total += np.unpackbits(h[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(h), bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed long. Null and empty texts have fp 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            fps = np.array([fingerprint(t.as_py()) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["id", "fp"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, fp long")


def _masks(bits: int, radius: int) -> list[int]:
    return [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(bits), r)]


def _collisions(prefix: np.ndarray, fp: np.ndarray, bits: int, half: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between fingerprints that share a variant under one of these prefixes."""
    low = 64 - bits
    diff = np.bitwise_count((fp >> np.uint64(low)) ^ prefix)
    tail = fp & np.uint64((1 << low) - 1)
    made, who = [], []
    for d in range(half + 1):
        at = np.flatnonzero(diff == d)
        if len(at):
            masks = np.array(_masks(low, half - d), np.uint64)
            head = (prefix[at] << np.uint64(low)) | tail[at]
            made.append((head[:, None] ^ masks[None, :]).ravel())
            who.append(np.repeat(at, len(masks)))
    variants = np.concatenate(made)
    order = np.sort(variants)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return fp[:0], fp[:0]
    place = np.minimum(np.searchsorted(twice, variants), len(twice) - 1)
    hit = np.flatnonzero(twice[place] == variants)
    place, owner = place[hit], fp[np.concatenate(who)[hit]]
    least = np.full(len(twice), np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, place, owner)
    a, b = owner, least[place]
    pairs = np.unique(np.stack([a, b], 1)[a != b], axis=0)
    pairs = pairs[np.bitwise_count(pairs[:, 0] ^ pairs[:, 1]) <= 2 * half]
    return forest(pairs[:, 0], pairs[:, 1]) if len(pairs) else (fp[:0], fp[:0])


def _weights(bits: int, half: int) -> list[int]:
    """Variants that a row stands for, by the bits its prefix differs in."""
    return [sum(comb(64 - bits, r) for r in range(half - d + 1)) for d in range(half + 1)]


def _bounded_collisions(prefix: np.ndarray, fp: np.ndarray, bits: int, half: int, heavy: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``_collisions``, of one prefix after another by its next bits where there are more than ``heavy`` variants."""
    diff = np.bitwise_count((fp >> np.uint64(64 - bits)) ^ prefix)
    if bits + STEP > 64 - STEP or np.array(_weights(bits, half))[diff].sum() <= heavy:
        yield _collisions(prefix, fp, bits, half)
        return
    edges = [0, *(np.flatnonzero(np.diff(prefix)) + 1).tolist(), len(prefix)]
    deep = bits + STEP
    for a, z in zip(edges[:-1], edges[1:]):
        head, mine = fp[a:z] >> np.uint64(64 - deep), fp[a:z]
        for v in range(1 << STEP):
            p = (prefix[a] << np.uint64(STEP)) | np.uint64(v)
            near = mine[np.bitwise_count(head ^ p) <= half]
            if len(near) > 1:
                yield from _bounded_collisions(np.full(len(near), p), near, deep, half, heavy)


def _links_under(rows: DataFrame, bits: int, half: int, parts: int, heavy: int) -> DataFrame:
    """(src, dst) links of rows (prefix, fp), prefixes of this many bits."""
    per_row = sum(comb(64, r) for r in range(half + 1)) / sum(comb(bits, r) for r in range(half + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_p, keep_f, size = [], [], 0

        def out(p: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
            for a, b in _bounded_collisions(p, f, bits, half, heavy):
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["src", "dst"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keep_p.append(batch.column(0).to_numpy().astype(np.uint64))
            keep_f.append(batch.column(1).to_numpy().view(np.uint64))
            size += batch.num_rows
            if size * per_row >= CHUNK and keep_p[0][0] != keep_p[-1][-1]:
                p, f = np.concatenate(keep_p), np.concatenate(keep_f)
                cut = int(np.searchsorted(p, p[-1]))
                yield from out(p[:cut], f[:cut])
                keep_p, keep_f, size = [p[cut:]], [f[cut:]], len(p) - cut
        if size:
            yield from out(np.concatenate(keep_p), np.concatenate(keep_f))

    return rows.repartition(parts, "prefix").sortWithinPartitions("prefix").mapInArrow(run, "src long, dst long")


def near_links(fps: DataFrame, radius: int = RADIUS, bits: int | None = None, heavy: int = HEAVY) -> DataFrame:
    """(src, dst) links that connect exactly the distinct ``fp`` values of a frame (fp long) within ``radius`` bits.

    ``bits`` (leading bits to shuffle on) follows from the number of fingerprints, so that the variants under one prefix
    fit a task: 12, or more from about 100 million fingerprints on. A prefix with more than ``heavy`` variants (very many
    near copies) goes by STEP more bits to as many tasks, and by more within a task. Neither changes the result.
    """
    spark, half = fps.sparkSession, radius // 2
    ball = sum(comb(64, r) for r in range(half + 1))
    n = fps.count()
    if bits is None:
        bits = min(28, max(12, ceil(log2(max(1, n) * ball / 64e6))))
    parts = max(shuffle_partitions(spark), ceil(n * ball / 64e6))
    masks = F.array(*[F.lit(m).cast("long") for m in _masks(bits, half)])
    rows = fps.select(F.explode(masks).alias("m"), "fp").select(F.shiftrightunsigned("fp", 64 - bits).bitwiseXOR(F.col("m")).alias("prefix"), "fp", F.bit_count("m").alias("d"))
    weight = F.get(F.array(*[F.lit(w).cast("long") for w in _weights(bits, half)]), F.col("d"))
    crowded = materialize(rows.groupBy("prefix").agg(F.sum(weight).alias("w")).where(F.col("w") > heavy).select("prefix"))
    many = crowded.count()
    if not many:
        return _links_under(rows.select("prefix", "fp"), bits, half, parts, heavy)
    side = F.broadcast(crowded) if many <= BROADCAST_PREFIXES else crowded
    light = rows.join(side, "prefix", "left_anti").select("prefix", "fp")
    more = F.array(*[F.lit(m).cast("long") for m in _masks(STEP, half)])
    split = rows.join(side, "prefix", "left_semi").select("prefix", "fp", "d", F.explode(more).alias("m")).where(F.col("d") + F.bit_count("m") <= half)
    tail = F.shiftrightunsigned("fp", 64 - bits - STEP).bitwiseAND(F.lit((1 << STEP) - 1).cast("long")).bitwiseXOR(F.col("m"))
    split = split.select(F.shiftleft("prefix", STEP).bitwiseOR(tail).alias("prefix"), "fp")
    return _links_under(light, bits, half, parts, heavy).unionByName(_links_under(split, bits + STEP, half, parts, heavy))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(id_col, fp, component): component is the smallest id reachable over fingerprints within ``radius`` bits.

    Null and empty texts share fingerprint 0 and are linked like any others. Copies, repeated rows and ties share a
    fingerprint, hence a component. A null id is kept; it names a component only if no id in it is set. Other columns
    are not read. An empty table gives an empty result.
    """
    each = materialize(with_fingerprints(docs, id_col, text_col))
    reps = materialize(each.groupBy("fp").agg(F.min("id").alias("rep")))
    found = connected_components(near_links(reps.select("fp"), radius))
    rooted = reps.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("component", "fp").alias("root"))
    label = rooted.groupBy("root").agg(F.min("rep").alias("component"))
    named = rooted.join(label, "root").select("fp", "component")
    return each.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One document of each group of near copies, whole, all columns kept: of the rows with its smallest id, the one of the smallest text hash.

    Ids may be repeated: it is rows that are told apart, by id and a 64-bit hash of the text. Rows equal in both are one
    document: one of them stays. Rows without an id cannot be named in a group: all stay. Decisions are made on ids and hashes;
    texts are not shuffled while the dropped documents are few enough to broadcast, else once.
    """
    named = docs.where(F.col(id_col).isNotNull())
    key, text_hash = "__loomtext_simhash_id", "__loomtext_simhash_hash"
    slim = named.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("h")).alias("id"), F.col(text_col).alias("text"))
    comp = materialize(simhash_components(slim, "id", "text", radius))
    rows = comp.groupBy("id", "component").agg(F.count("*").alias("n"))
    dropped = materialize(rows.where(F.col("id") != F.col("component")).select(F.col("id.id").alias(key), F.col("id.h").alias(text_hash)).distinct())
    repeated = materialize(rows.where((F.col("id") == F.col("component")) & (F.col("n") > 1)).select(F.col("id.id").alias(key), F.col("id.h").alias(text_hash)))

    def told(side: DataFrame, n: int, df: DataFrame, how: str) -> DataFrame:
        on = (F.col(id_col) == F.col(key)) & (F.xxhash64(F.col(text_col)) == F.col(text_hash))
        return df.join(F.broadcast(side) if n <= BROADCAST_IDS else side, on, how)

    out = told(dropped, dropped.count(), named, "left_anti")
    n = repeated.count()
    if n:
        out = told(repeated, n, out, "left_anti").unionByName(told(repeated, n, out, "left_semi").dropDuplicates([id_col, text_col]))
    return out.unionByName(docs.where(F.col(id_col).isNull()))


def fingerprint_hex(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
