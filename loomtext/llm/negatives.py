"""Hard negatives by distributed radix selection.

Every anchor is a stated query: it meets all rows, in blocks, and keeps none of the pairs. For each anchor and positive a window of scores
says which rows of other labels may be taken. Tasks count the window's scores in 64 buckets, the counts add up over tasks, and the bucket
that holds the k-th score is the range of the next digit, until the range is known in which few enough rows lie; rows of one score
are told apart in the same way by their ids. Only then rows are gathered: those from the k-th score up. Positives are selected alike, in
one window an anchor that holds all scores of its label.

Rows stay where they are, as blocks of whole numbers written once; anchors come to them in chunks of CHUNK_CELLS components, one broadcast a chunk.
Per chunk the driver holds the windows (at most five an anchor) and their counts, never rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.llm.common import discard, materialize
from loomtext.llm.vectors import finite, integer_blocks, integers, same_length

POSITIVES, NEGATIVES, LOW, HIGH, SCALE = 5, 10, 30, 90, 256
#: Components of the anchors of a chunk, about.
CHUNK_CELLS = 1 << 19
BUCKETS = 64
#: Anchors that meet a block at once.
TOGETHER = 256


@dataclass
class Anchors:
    block: np.ndarray
    at: np.ndarray
    ids: np.ndarray
    x: np.ndarray
    #: Its label's place in ``labels``.
    label: np.ndarray
    labels: pd.Index


@dataclass
class Windows:
    """Of each window: its anchor's place, lowest and highest score, the range looked at, and the rows known to come before that range.

    In the end a row qualifies if its score is over ``least``, or equal to it with an id of at most ``last``.
    """

    anchor: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def __post_init__(self) -> None:
        n = len(self.anchor)
        self.a, self.b = self.low.copy(), self.high.copy()
        self.before = np.zeros(n, np.int64)
        self.by_id, self.done = np.zeros(n, bool), self.low > self.high
        self.least, self.last = self.low.copy(), np.full(n, np.iinfo(np.int64).max)


def _widths(a: np.ndarray, b: np.ndarray, buckets: int) -> np.ndarray:
    """Whole numbers a bucket so that ``buckets`` of them cover a..b, as unsigned longs (ids may span all longs)."""
    return (b.astype(np.uint64) - a.astype(np.uint64)) // np.uint64(buckets) + np.uint64(1)


def _scores(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products as longs."""
    if x.shape[1] * int(np.abs(a).max(initial=0)) * int(np.abs(x).max(initial=0)) < 1 << 53:
        return (a.astype(float) @ x.astype(float).T).astype(np.int64)
    return a @ x.T


class _Meeting:
    """A chunk's windows against one block after another."""

    def __init__(self, anchors: Anchors, w: Windows, same: bool, active: np.ndarray, dims: int):
        self.anchors, self.w, self.same, self.dims, self.together, self.buckets = anchors, w, same, dims, TOGETHER, BUCKETS
        self.active = active[np.argsort(w.anchor[active], kind="stable")]
        self.who = np.unique(w.anchor[self.active])
        self.starts = np.searchsorted(w.anchor[self.active], self.who[:: self.together])

    def pairs(self, b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(windows, places of the block's rows, scores, ids) of all rows that a window's range of scores holds, of the right label, but for the anchor itself."""
        ids = b.column("id").flatten().to_numpy()
        x, block = integers(b.column("x")[0].as_py(), self.dims, len(ids)), b.column("block")[0].as_py()
        label = self.anchors.labels.get_indexer(b.column("label").flatten().to_pandas())
        ends = [*self.starts[1:], len(self.active)]
        for k, (s, e) in enumerate(zip(self.starts, ends)):
            mine = self.who[k * self.together : (k + 1) * self.together]
            score = _scores(self.anchors.x[mine], x)
            for t in range(s, e, self.together):
                win = self.active[t : min(e, t + self.together)]
                anchor = self.w.anchor[win]
                got = score[np.searchsorted(mine, anchor)]
                low = np.where(self.w.by_id[win], self.w.least[win], self.w.a[win])
                high = np.where(self.w.by_id[win], self.w.least[win], self.w.b[win])
                hit = (got >= low[:, None]) & (got <= high[:, None]) & ((label == self.anchors.label[anchor][:, None]) == self.same)
                own = np.flatnonzero(self.anchors.block[anchor] == block)
                hit[own, self.anchors.at[anchor[own]]] = False
                r, c = np.nonzero(hit)
                yield win[r], c, got[r, c], ids[c]


def _counted(blocks: DataFrame, anchors: Anchors, w: Windows, same: bool, active: np.ndarray, dims: int) -> np.ndarray:
    """Rows of each active window's range by bucket, from the best on."""
    shared = blocks.sparkSession.sparkContext.broadcast(_Meeting(anchors, w, same, active, dims))  # a chunk

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        total, width = np.zeros(len(m.w.anchor) * m.buckets, np.int64), _widths(m.w.a, m.w.b, m.buckets)
        for whole in batches:
            for k in range(whole.num_rows):
                for win, _, score, ids in m.pairs(whole.slice(k, 1)):
                    by_id = m.w.by_id[win]
                    inside = ~by_id | ((ids >= m.w.a[win]) & (ids <= m.w.b[win]))
                    far = np.where(by_id, ids.astype(np.uint64) - m.w.a[win].astype(np.uint64), m.w.b[win].astype(np.uint64) - score.astype(np.uint64))
                    bucket = (far[inside] // width[win[inside]]).astype(np.int64)
                    np.add.at(total, win[inside] * m.buckets + bucket, 1)
        rows = total.reshape(-1, m.buckets)
        some = np.flatnonzero(rows.any(axis=1))
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * m.buckets, pa.int32()), pa.array(rows[some].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), flat], names=["w", "n"])

    try:
        got = blocks.select("block", "id", "label", "x").mapInArrow(run, "w long, n array<long>").groupBy("w").agg(F.array(*[F.sum(F.col("n")[i]) for i in range(BUCKETS)]).alias("n")).toArrow()  # a row a window of the chunk
    finally:
        shared.unpersist()
    out = np.zeros((len(w.anchor), BUCKETS), np.int64)
    out[got.column("w").to_numpy()] = got.column("n").combine_chunks().flatten().to_numpy().reshape(-1, BUCKETS) if got.num_rows else out[:0]
    return out[active]


def _located(w: Windows, at: np.ndarray, counts: np.ndarray, k: int, ids: tuple[int, int], enough: int) -> None:
    """Narrow the windows ``at`` to the bucket of their k-th row, or finish them where few rows come up to its end."""
    width = _widths(w.a, w.b, BUCKETS)
    for i, n in zip(at.tolist(), counts):
        upto = int(w.before[i]) + np.cumsum(n)
        hit = int(np.searchsorted(upto, min(k, upto[-1]))) if upto[-1] else BUCKETS - 1
        size, first, last = int(width[i]), int(w.a[i]), int(w.b[i])
        if w.by_id[i]:
            a, b = first + hit * size, min(last, first + (hit + 1) * size - 1)
        else:
            a, b = max(first, last - (hit + 1) * size + 1), last - hit * size
        if upto[-1] <= enough and not w.by_id[i]:
            w.least[i], w.done[i] = first, True
        elif upto[hit] <= enough or (w.by_id[i] and a == b):
            w.done[i] = True
            if w.by_id[i]:
                w.last[i] = b
            else:
                w.least[i] = a
        else:
            w.before[i] = upto[hit - 1] if hit else w.before[i]
            w.a[i], w.b[i] = a, b
            if not w.by_id[i] and a == b:
                w.by_id[i], w.least[i] = True, a
                w.a[i], w.b[i] = ids


def select(blocks: DataFrame, anchors: Anchors, w: Windows, same: bool, k: int, dims: int, ids: tuple[int, int]) -> DataFrame:
    """Rows (w, id, score, n) that qualify for each window: its first ``k`` and few more; ``n`` counts rows alike."""
    enough = max(BUCKETS, 4 * k)
    while (active := np.flatnonzero(~w.done)).size:
        _located(w, active, _counted(blocks, anchors, w, same, active, dims), k, ids, enough)
    ready = Windows(w.anchor, w.least, w.high)
    ready.last = w.last
    shared = blocks.sparkSession.sparkContext.broadcast(_Meeting(anchors, ready, same, np.flatnonzero(ready.low <= ready.high), dims))  # a chunk

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for j in range(whole.num_rows):
                for win, _, score, ids in m.pairs(whole.slice(j, 1)):
                    ok = (score > m.w.low[win]) | (ids <= m.w.last[win])
                    if ok.any():
                        each, n = np.unique(np.stack([win[ok], ids[ok], score[ok]]), axis=1, return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(each[0]), pa.array(each[1]), pa.array(each[2]), pa.array(n.astype(np.int64))], names=["w", "id", "score", "n"])

    got = blocks.select("block", "id", "label", "x").mapInArrow(run, "w long, id long, score long, n long")
    got = got.groupBy("w", "id", "score").agg(F.sum("n").alias("n"))
    one = got.select("w", "id", "score", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int"))).alias("copy"))
    rank = F.row_number().over(Window.partitionBy("w").orderBy(F.desc("score"), "id", "copy"))
    return one.withColumn("rank", rank).where(F.col("rank") <= k).select("w", "id", "score", "rank")


def _chunks(blocks: DataFrame, anchors: DataFrame, dims: int) -> Iterator[Anchors]:
    n = anchors.count()
    some = -(-n * dims // CHUNK_CELLS)
    for c in range(some):
        mine = anchors if some == 1 else anchors.where(F.pmod(F.xxhash64("block", "at"), F.lit(some)) == c)
        t = mine.orderBy("block", "at").toArrow()
        if t.num_rows:
            label = t.column("label").to_pandas()
            known = pd.Index(label.unique())
            x = np.concatenate([integers(v, dims, 1) for v in t.column("x").to_pylist()])
            yield Anchors(t.column("block").to_numpy(), t.column("at").to_numpy(), t.column("id").to_numpy(), x, known.get_indexer(label), known)


def mine(vectors: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", scale: int = SCALE) -> DataFrame:
    """For each row of ``anchor`` and each of its first ``positives`` rows of the same label, the first ``negatives`` rows of other labels whose score is within ``low`` to ``high`` hundredths of the positive's.

    A score is the inner product of vectors as floor(scale * x); higher scores come first, ties by smaller id. Rows without id or label, without vector, or with null or
    non-finite components take no part; of vectors of unequal lengths those of the commonest do. Repeated rows count each: a repeated anchor gives its rows twice, a
    repeated negative fills more than one rank. An anchor without positive, and a pair without negatives, gives no row. Other columns don't matter, whatever their names.
    """
    names = {"anchor_id": "long", "positive_id": "long", "rank": "int", "negative_id": "long", "positive_score": "long", "negative_score": "long"}
    spark = vectors.sparkSession
    nothing = spark.createDataFrame([], ", ".join(f"{n} {t}" for n, t in names.items()))
    d = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vec_col}`").alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    d, dims = same_length(d.where(finite("v") & F.col("id").isNotNull() & F.col("label").isNotNull()), "v")
    if not dims:
        return nothing
    blocks = materialize(integer_blocks(d, dims, scale, "v", id=F.col("id"), label=F.col("label"), anchor=F.col("anchor")))
    span = blocks.agg(F.min(F.array_min("id")), F.max(F.array_max("id"))).first()
    kind = {f.name: f.dataType for f in blocks.schema.fields}["label"].elementType.simpleString()

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(whole.num_rows):
                b = whole.slice(k, 1)
                at = np.flatnonzero(b.column("anchor").flatten().to_numpy(zero_copy_only=False))
                ids = b.column("id").flatten()
                x = integers(b.column("x")[0].as_py(), dims, len(ids))[at].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([b.column("block")[0].as_py()] * len(at), pa.int64()), pa.array(at, pa.int64()), ids.take(pa.array(at)), b.column("label").flatten().take(pa.array(at)), pa.array([r.tobytes() for r in x], pa.binary())], names=["block", "at", "id", "label", "x"])

    anchors = materialize(blocks.mapInArrow(chosen, f"block long, at long, id long, label {kind}, x binary"))
    rows = blocks.select("block", "id", "label", "x")
    out, largest = [], _largest(rows, dims)
    for chunk in _chunks(blocks, anchors, dims):
        top = np.abs(chunk.x).sum(axis=1) * largest
        alike = select(rows, chunk, Windows(np.arange(len(chunk.ids)), -top, top), True, positives, dims, span).toArrow()  # at most ``positives`` an anchor
        if not alike.num_rows:
            continue
        of, other, score = alike.column("w").to_numpy(), alike.column("id").to_numpy(), alike.column("score").to_numpy()
        least = np.array([-((-low * s) // 100) for s in score.tolist()], np.int64)
        most = np.array([high * s // 100 for s in score.tolist()], np.int64)
        found = select(rows, chunk, Windows(of, least, most), False, negatives, dims, span)
        pairs = spark.createDataFrame(pa.table({"w": pa.array(np.arange(len(of)), pa.int64()), "anchor_id": pa.array(chunk.ids[of], pa.int64()), "positive_id": pa.array(other, pa.int64()), "positive_score": pa.array(score, pa.int64())}))
        out.append(materialize(found.join(F.broadcast(pairs), "w").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))))  # a chunk's windows
    discard(blocks)
    discard(anchors)
    return reduce(DataFrame.unionByName, out, nothing)


def _largest(blocks: DataFrame, dims: int) -> int:
    """The largest component of all rows, without sign."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = [int(np.abs(integers(x, dims, n)).max(initial=0)) for b in batches for x, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays([pa.array([max(top, default=0)], pa.int64())], names=["m"])

    return blocks.select("x", F.size("id").alias("n")).mapInArrow(run, "m long").agg(F.max("m")).first()[0]
