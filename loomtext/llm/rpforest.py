"""Embedding near-duplicates by a forest of random-projection trees.

A tree splits the space again and again at the median along a random direction (of a few drawn the one in which the rows
spread most); vectors within ``spill`` of a split go to both sides, so close pairs part seldom. The forest has two tiers.
TREES outer trees are fitted on a bounded sample and only go down to leaves of a task's size: each vector is shuffled once
for every outer leaf it lies in, and by nothing else. The task that receives an outer leaf grows INNER trees over all of
the leaf's vectors, down to LEAF, with more spill, as copies cost no shuffle there. So inner leaves stay small whatever
the table holds, only the outer trees are broadcast, and only nodes that split are stored.

Vectors are compared within inner leaves. A pair whose cosine is at least the threshold is counted in the first outer
leaf, and there in the first inner leaf, in which both lie; outer leaves of linked vectors are looked up again from the
trees, not shuffled along. No pair is ever shuffled: a leaf sends on sums of links and a forest of its links. Equal
vectors lie in the same leaves; they are merged a batch, then a leaf, with their number, and are compared once. A node that
no direction parts (very many near copies) stays a leaf, which is cut in blocks that meet pairwise in several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import materialize, shuffle_partitions
from loomtext.llm.components import connected_components, forest
from loomtext.llm.vectors import matrix, same_length, usable

TREES = 3
SPILL = 0.01
INNER = 2
INNER_SPILL = 0.025
LEAF = 512
#: Components (rows times dimensions) of an outer leaf: 16 MB as doubles. Leaves of over four times that are cut in blocks.
CELLS = 1 << 21
#: Rows of an outer leaf, at least, where the table is cut finer to keep all tasks busy.
LEAST_ROWS = 1024
#: Components of the sample that outer trees are fitted on, at most (128 MB as doubles), and sampled rows a leaf wanted, and needed.
FIT_CELLS = 1 << 24
FIT_WANTED, FIT_LEAST = 64, 16
#: Directions of which the widest is taken; a split must leave each side less than this share of the rows.
DRAWN = 8
PROGRESS = 0.8
THRESHOLD = 0.95
SEED = 11


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1)[:, None]


@dataclass(frozen=True)
class Trees:
    """Splits of all trees: direction, cut, and the two nodes below; a node below 0 is leaf -1 - node. ``share``: sampled rows of each leaf."""

    roots: list[int]
    way: np.ndarray
    cut: np.ndarray
    below: np.ndarray
    share: np.ndarray


def grow(x: np.ndarray, rows: float, least: int, trees: int, spill: float, seed: int) -> Trees:
    """Trees over unit vectors; nodes of at most ``rows`` vectors, spilled ones included, or fewer than 2 * ``least`` aren't split."""
    rng = np.random.default_rng(seed)
    way: list = []
    cut: list = []
    below: list[list[int]] = []
    share: list[int] = []
    roots = []
    for _ in range(trees):
        roots.append(0)
        todo = [(np.arange(len(x)), len(roots) - 1, None)]  # rows, tree, (node, side) above
        while todo:
            at, tree, up = todo.pop()
            node = None
            if len(at) > rows and len(at) >= 2 * least:
                some = at if len(at) <= 4096 else at[:: len(at) // 4096 + 1]
                drawn = rng.standard_normal((DRAWN, x.shape[1]))
                drawn /= np.linalg.norm(drawn, axis=1)[:, None]
                w = drawn[np.argmax((x[some] @ drawn.T).std(axis=0))]
                p = x[at] @ w
                m = float(np.median(p))
                left, right = at[p < m + spill], at[p >= m - spill]
                if max(len(left), len(right)) <= PROGRESS * len(at):
                    node = len(way)
                    way.append(w)
                    cut.append(m)
                    below.append([0, 0])
                    todo += [(right, tree, (node, 1)), (left, tree, (node, 0))]
            if node is None:
                node = -1 - len(share)
                share.append(len(at))
            if up is None:
                roots[tree] = node
            else:
                below[up[0]][up[1]] = node
    return Trees(roots, np.array(way).reshape(-1, x.shape[1]), np.array(cut), np.array(below, np.int64).reshape(-1, 2), np.array(share))


def place(x: np.ndarray, t: Trees, spill: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf): all leaves of unit vectors, by row, then leaf. Sums run along each row alone, so a vector's leaves are the same in any batch."""
    rows, leaves = [], []
    for root in t.roots:
        todo = [(root, np.arange(len(x)))]
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            if node < 0:
                rows.append(at)
                leaves.append(np.full(len(at), -1 - node, np.int64))
                continue
            p = (x[at] * t.way[node]).sum(axis=1) - t.cut[node]
            todo += [(t.below[node, 0], at[p < spill]), (t.below[node, 1], at[p >= -spill])]
    row, leaf = np.concatenate(rows), np.concatenate(leaves)
    o = np.lexsort((leaf, row))
    return row[o], leaf[o]


def _padded(row: np.ndarray, leaf: np.ndarray, n: int) -> np.ndarray:
    """The leaves of each of n rows, filled up with -1; ``row`` is sorted."""
    counts = np.bincount(row, minlength=n)
    out = np.full((n, counts.max() if n else 0), -1, np.int64)
    out[np.arange(out.shape[1])[None, :] < counts[:, None]] = leaf
    return out


def _met_before(ma: np.ndarray, mb: np.ndarray, leaf: int) -> np.ndarray:
    """For rows of two such tables: whether they share a leaf below ``leaf``."""
    out = np.zeros(len(ma), bool)
    for k in range(ma.shape[1]):
        c = ma[:, k]
        out |= (c >= 0) & (c < leaf) & (mb == c[:, None]).any(axis=1)
    return out


def merged(ids: np.ndarray, mult: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal vectors as one: the smallest id, the number of them, the vector."""
    if len(x) < 2:
        return ids, mult, x
    as_bytes = np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * x.itemsize))).ravel()
    _, first, of = np.unique(as_bytes, return_index=True, return_inverse=True)
    low, n = ids[first].copy(), np.zeros(len(first), np.int64)
    np.minimum.at(low, of, ids)
    np.add.at(n, of, mult)
    return low, n, x[first]


class _Links:
    """Sums of links and forests of links found in leaves, as (src, dst, add)."""

    def __init__(self, outer: Trees, threshold: float, leaf: int, seed: int):
        self.outer, self.threshold, self.leaf, self.seed = outer, threshold, leaf, seed
        self.src: list = []
        self.dst: list = []
        self.add: list = []

    def compare(self, home: int, b0: int, b1: int, block, ids: np.ndarray, mult: np.ndarray, x: np.ndarray) -> None:
        """All pairs of the outer leaf ``home`` that lie in one inner leaf, of blocks b0 and b1 each; ``block`` gives each vector's."""
        ids, mult, x = merged(ids, mult, x)
        if len(ids) < 2:
            return
        norm = np.linalg.norm(x, axis=1)
        u = x / norm[:, None]
        inner = grow(u, self.leaf, 1, INNER, INNER_SPILL, self.seed)
        row, leaf = place(u, inner, INNER_SPILL)
        near = _padded(row, leaf, len(ids))
        far: np.ndarray | None = None  # outer leaves, looked up once a vector has links
        looked = np.zeros(len(ids), bool)
        b = block(x) if b0 != b1 else None
        linked, sa, sb = np.zeros(len(ids), np.int64), [], []
        o = np.argsort(leaf, kind="stable")
        edges = [0, *(np.flatnonzero(np.diff(leaf[o])) + 1).tolist(), len(o)]
        for s0, s1 in zip(edges[:-1], edges[1:]):
            here, mine = int(leaf[o[s0]]), row[o[s0:s1]]
            left, right = (mine, mine) if b is None else (mine[b[mine] == b0], mine[b[mine] == b1])
            for at in range(0, len(left), 512):
                a = left[at : at + 512]
                i, j = np.nonzero(u[a] @ u[right].T >= self.threshold - 1e-9)
                i, j = a[i], right[j]
                if b is None:
                    i, j = i[i < j], j[i < j]
                for s in range(0, len(i), 20_000):
                    p, q = i[s : s + 20_000], j[s : s + 20_000]
                    ok = (x[p] * x[q]).sum(axis=1) / (norm[p] * norm[q]) >= self.threshold
                    p, q = p[ok], q[ok]
                    new = ~_met_before(near[p], near[q], here)
                    p, q = p[new], q[new]
                    if not len(p):
                        continue
                    ask = np.zeros(len(ids), bool)
                    ask[p] = ask[q] = True
                    ask &= ~looked
                    if ask.any():
                        got = _padded(*place(u[ask], self.outer, SPILL), int(ask.sum()))
                        wide = max(got.shape[1], 0 if far is None else far.shape[1])
                        grown = np.full((len(ids), wide), -1, np.int64)
                        if far is not None:
                            grown[:, : far.shape[1]] = far
                        grown[ask, : got.shape[1]] = got
                        far, looked = grown, looked | ask
                    new = ~_met_before(far[p], far[q], home)
                    p, q = p[new], q[new]
                    if len(p):
                        np.add.at(linked, p, mult[q])
                        np.add.at(linked, q, mult[p])
                        f = forest(ids[p], ids[q])
                        sa.append(f[0])
                        sb.append(f[1])
        if sa:
            f = forest(np.concatenate(sa), np.concatenate(sb))
            some = np.flatnonzero(linked)
            self.src += [f[0], ids[some]]
            self.dst += [f[1], ids[some]]
            self.add += [np.zeros(len(f[0]), np.int64), linked[some]]

    def batch(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (self.src, self.dst, self.add)], names=["src", "dst", "add"])
        self.src, self.dst, self.add = [], [], []
        return out


def link_table(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD, trees: int = TREES, leaf: int = LEAF, cells: int = CELLS, seed: int = SEED) -> DataFrame:
    """(id_col, n_links, component_id, kept), one row per row.

    ``n_links`` counts the other rows found with a cosine, in double precision, of at least ``threshold``; copies count one
    by one. Vectors that are null, zero, hold null or non-finite components or have another length than the commonest link
    with nothing, nor do rows without an id (their component is null and they are not kept). Repeated rows are copies.
    Extra columns are not read. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    src = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    good, dims = same_length(src.where(F.col("id").isNotNull() & usable("v")), "v")
    alone = lambda df: df.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    if not dims:
        return alone(src)
    other = src.where(~(F.col("id").isNotNull() & usable("v") & (F.size("v") == dims)))
    # 128 bits of hash stand for the vector (0.0 and -0.0 alike), so that classes shuffle no vectors.
    flat = F.transform("v", lambda x: x + 0)
    keyed = materialize(good.select("id", F.xxhash64(flat).alias("h1"), F.xxhash64(F.lit(1), flat).alias("h2")))
    classes = materialize(keyed.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("mult")))
    n = classes.count()
    rows = min(max(LEAST_ROWS, n * trees // shuffle_partitions(spark)), max(LEAST_ROWS, cells // dims))
    want = min(max(8192, FIT_WANTED * n // rows), FIT_CELLS // dims)
    # About as many classes as wanted, by their hash; a hot vector is one of them.
    picked = good.where(F.pmod(F.xxhash64(flat, F.lit(seed)), F.lit(1_000_003)) < int(min(1.0, 1.1 * want / n) * 1_000_003) + 1).select("v", F.xxhash64(flat).alias("h1"))
    picked = picked.dropDuplicates(["h1"]).orderBy("h1").limit(FIT_CELLS // dims).select("v").toArrow().column(0).combine_chunks()
    sample = unit(matrix(picked, dims)) if len(picked) else np.zeros((0, dims))
    scale = n / max(1, len(sample))
    outer = grow(sample, rows / scale, FIT_LEAST, trees, SPILL, seed)
    blocks = np.maximum(1, np.ceil(outer.share * scale / (4 * max(rows, cells // dims)))).astype(np.int64)
    shared = spark.sparkContext.broadcast((outer, blocks))  # at most trees * FIT_CELLS / FIT_LEAST components
    kind = good.schema["v"].dataType.simpleString()

    def hashed(x: np.ndarray) -> np.ndarray:
        return np.fromiter((crc32(r.tobytes()) for r in x), np.int64, len(x))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        outer, blocks = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column(1), dims) + 0.0
            ids, mult, x = merged(b.column(0).to_numpy(), np.ones(len(x), np.int64), x)
            for at in range(0, len(ids), 2000):
                part = x[at : at + 2000]
                row, home = place(unit(part), outer, SPILL)
                nb = blocks[home]
                if nb.max() > 1:
                    # A block meets each of its leaf's blocks: key (leaf, smaller block, larger block).
                    each = np.repeat(np.arange(len(row)), nb)
                    o = np.arange(len(each)) - np.repeat(np.cumsum(nb) - nb, nb)
                    row, home, mine = row[each], home[each], hashed(part)[row[each]] % nb[each]
                    key = (home << 40) | (np.minimum(mine, o) << 20) | np.maximum(mine, o)
                else:
                    key = home << 40
                v = pa.array(part[row].ravel()).cast(b.column(1).type.value_type, safe=False)
                v = pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1, dtype=np.int32) * dims), v)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids[at : at + 2000][row]), pa.array(mult[at : at + 2000][row]), v], names=["key", "id", "mult", "v"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        outer, blocks = shared.value
        links = _Links(outer, threshold, leaf, seed + 1)
        key, held = None, []

        def close() -> None:
            if held:
                home = key >> 40
                links.compare(home, (key >> 20) & 0xFFFFF, key & 0xFFFFF, lambda x: hashed(x) % blocks[home], *(np.concatenate(c) for c in zip(*held)))

        for b in batches:
            keys, ids, mult, x = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(), matrix(b.column(3), dims)
            edges = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for a, z in zip(edges[:-1], edges[1:]):
                if a == z:
                    continue
                if key != int(keys[a]):
                    close()
                    key, held = int(keys[a]), []
                    if sum(map(len, links.src)) > 500_000:
                        yield links.batch()
                held.append((ids[a:z], mult[a:z], x[a:z]))
        close()
        if links.src:
            yield links.batch()

    entries = good.mapInArrow(assign, f"key long, id long, mult long, v {kind}")
    met = materialize(entries.repartition("key").sortWithinPartitions("key").mapInArrow(compare, "src long, dst long, add long"))
    comp = connected_components(met.where("src <> dst").select("src", "dst"))
    links = met.where("add > 0").groupBy(F.col("src").alias("rep")).agg(F.sum("add").alias("add"))
    named = classes.join(links, "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select("h1", "h2", (F.col("mult") - 1 + F.coalesce("add", F.lit(0))).cast("long").alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = keyed.join(named, ["h1", "h2"]).select(F.col("id").alias(id_col), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
    return out.unionByName(alone(other))
