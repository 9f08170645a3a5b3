"""Approximate nearest neighbours by cross-polytope hashing.

Rows are parted into bands of like norms. A band's vectors are divided by its largest norm and get one more component that
makes them unit vectors, so that the largest inner product is the nearest unit vector also where norms differ; few rows of
other norms do not turn a band's rows to that component. In each table one to three pseudo-rotations (three rounds of
random signs and a fast Hadamard transform) take a vector to the nearest signed axis, the last one over its first
components only; the axes together name its bucket. A query probes, in every table of every band, the buckets that its own
rotations are nearest to, in the order of what they fall short of its best. Bands of at most EXACT rows meet every query.

How many tables, axes and probes there are follows from the data: ASKED of the queries are compared with all rows, and of the
settings that find TARGET of their neighbours the one that ships and compares least is taken, of those that ship little
first. Finer buckets are worth it as the table grows and where neighbours are near; where they are not, probes cover more,
up to all buckets.

Buckets are dealt into cells. A row goes to a cell once for its buckets there, a query once for its probes there; a cell
holds its rows and streams its queries past them. A bucket that many rows or queries have is met in blocks. Each cell sends
on a query's best, by exact inner products of the original vectors, and the best over all are merged. No candidate is capped: a
bucket's best k are the only ones of it that can be among the best k of all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtext.llm.common import materialize, shuffle_partitions
from loomtext.llm.vectors import matrix, same_length, usable

#: Tables, and probes in one of them, at most; fewer where fewer find TARGET of the neighbours.
TABLES = 4
PROBES = 256
TARGET = 0.95
#: Queries that are compared with all rows to choose a setting, and sampled rows that tell how full buckets are (2 MB of 64 components).
ASKED = 128
SAMPLE = 4_096
SEED = 5
#: Rows of a cell, about (32 MB of 64 components), and rows or queries of a bucket that meet in one block.
CELL, BLOCK = 65_536, 16_384
#: Settings that ship at most so many vectors a row (results counted as vectors) go before all others.
SHIPPED = 4.0
#: Norms are counted in bins of 1/BINS octave; a band is BINS bins from its largest norm down.
BINS = 8
#: Rows of a band that is compared with every query instead of hashed: the few rows of the largest norms are near to no query by angle.
EXACT = 1024
#: Seconds to ship a vector of 64 components, to look a probe up, and to multiply two vectors: only their ratios count.
SHIP, LOOK, MEET = 4e-6, 2e-6, 2e-8
_EVERY, _REST = -1, -2


def hadamard(x: np.ndarray) -> np.ndarray:
    """The normalised Walsh-Hadamard transform of each row; the width is a power of two."""
    n, width = x.shape
    h = 1
    while h < width:
        x = x.reshape(n, width // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, width)
        h *= 2
    return x / np.sqrt(width)


def _width(dims: int) -> int:
    return 1 << dims.bit_length()  # over dims: room for the added component


def _rotate(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    for s in signs:
        x = hadamard(x * s)
    return x


def _bands(bins: list[tuple[int, float, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (bin, largest norm, rows): the bands' lowest norms, largest norms and rows, ascending."""
    out: list[list] = []
    for at, top, n in sorted(bins, reverse=True):
        if out and at > out[-1][0] - BINS:
            out[-1][2] += n
            out[-1][3] = at
        else:
            out.append([at, top, n, at])
    out.reverse()
    return np.array([2.0 ** (b[3] / BINS) for b in out]), np.array([b[1] for b in out]), np.array([b[2] for b in out])


def _norm(x: np.ndarray) -> np.ndarray:
    """Norms, from the largest component on, so that no square overflows."""
    big = np.abs(x).max(axis=1, initial=1e-300)
    return big * np.linalg.norm(x / big[:, None], axis=1)


def _lift(x: np.ndarray, top: np.ndarray | None) -> np.ndarray:
    """Unit vectors of the padded width; ``top`` is the largest norm of each row's band, None for queries."""
    norm = _norm(x)
    out = np.zeros((len(x), _width(x.shape[1])))
    out[:, : x.shape[1]] = x / (norm if top is None else top)[:, None]
    if top is not None:
        out[:, x.shape[1]] = np.sqrt(np.maximum(0, 1 - (norm / top) ** 2))
    return out


def _axis(z: np.ndarray) -> np.ndarray:
    """The nearest signed axis of each row: the component, after all components if it is negative."""
    axis = np.argmax(np.abs(z), axis=1)
    return axis + z.shape[1] * (z[np.arange(len(z)), axis] < 0)


@dataclass(frozen=True)
class Index:
    """What names buckets: bands (lowest and largest norms, rows), rotations [table, hash, round, component], and for a setting the components of each hash, the tables, and the probes of each band."""

    low: np.ndarray
    top: np.ndarray
    size: np.ndarray
    signs: np.ndarray
    hashes: tuple[int, ...] = ()
    tables: int = 1
    probes: tuple[int, ...] = ()

    def band(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(np.searchsorted(self.low, _norm(x), side="right") - 1, 0)

    def turned(self, y: np.ndarray, table: int) -> list[np.ndarray]:
        return [_rotate(y, self.signs[table, h]) for h in range(len(self.hashes))]

    def codes(self, turned: list[np.ndarray]) -> np.ndarray:
        """The bucket of each unit vector."""
        code = np.zeros(len(turned[0]), np.int64)
        for z, d in zip(turned, self.hashes):
            code = code * (2 * d) + _axis(z[:, :d])
        return code

    def nearest_codes(self, turned: list[np.ndarray], most: int) -> np.ndarray:
        """[query, probe]: buckets from the nearest on, at most ``most``."""
        n = len(turned[0])
        if n > 250 and len(self.hashes) > 1:
            return np.concatenate([self.nearest_codes([z[at : at + 250] for z in turned], most) for at in range(0, n, 250)])
        code, short = np.zeros((n, 1), np.int64), np.zeros((n, 1))
        for h, (z, d) in enumerate(zip(turned, self.hashes)):
            z = np.concatenate([z[:, :d], -z[:, :d]], axis=1)
            m = min(2 * d, 16 if h else most)
            some = np.argpartition(-z, m - 1, axis=1)[:, :m] if m < 2 * d else np.broadcast_to(np.arange(2 * d), z.shape)
            loss = z.max(axis=1)[:, None] - np.take_along_axis(z, some, 1)
            short = (short[:, :, None] + loss[:, None, :]).reshape(n, -1)
            code = (code[:, :, None] * (2 * d) + some[:, None, :]).reshape(n, -1)
            if short.shape[1] > most:
                o = np.argpartition(short, most - 1, axis=1)[:, :most]
                short, code = np.take_along_axis(short, o, 1), np.take_along_axis(code, o, 1)
        return np.take_along_axis(code, np.lexsort((code, short), axis=1), 1)

    def full(self, code: np.ndarray, table: int, band) -> np.ndarray:
        return ((np.asarray(band, np.int64) * TABLES_MOST + table) << 40) | code

    def of_rows(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, bucket) of stored vectors."""
        band = self.band(x)
        hashed = np.flatnonzero(self.size[band] > EXACT)
        whole = np.flatnonzero(self.size[band] <= EXACT)
        y = _lift(x[hashed], self.top[band[hashed]])
        at = [self.full(self.codes(self.turned(y, t)), t, band[hashed]) for t in range(self.tables)] if len(y) else []
        return np.concatenate([whole, *[hashed] * len(at)]), np.concatenate([np.full(len(whole), _EVERY, np.int64), *at])

    def of_queries(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, bucket) of probes; bucket _EVERY holds the rows of small bands."""
        y, every = _lift(x, None), np.arange(len(x))
        big = [b for b in range(len(self.size)) if self.size[b] > EXACT]
        who, at = [], []
        if len(big) < len(self.size):
            who.append(every)
            at.append(np.full(len(x), _EVERY, np.int64))
        for t in range(self.tables if big else 0):
            code = self.nearest_codes(self.turned(y, t), max(self.probes[b] for b in big))
            for b in big:
                c = self.full(code[:, : self.probes[b]], t, b)
                who.append(np.repeat(every, c.shape[1]))
                at.append(c.ravel())
        return np.concatenate(who), np.concatenate(at)


#: Room for tables in a bucket's number.
TABLES_MOST = 64


def _settings(width: int, rows: int) -> list[tuple[int, ...]]:
    """Components of each hash: one whole polytope, then finer with a second and third of more and more components."""
    out, full = [(width,)], (width,)
    for _ in range(2):
        d = 1
        while d <= width:
            if np.prod([2.0 * x for x in (*full, d)]) <= min(4.0 * rows, 2.0**39):
                out.append((*full, d))
            d *= 2
        full = (*full, width)
    return out


def choose(index: Index, rows: np.ndarray, total: int, asks: np.ndarray, found: list[np.ndarray], n_asks: int, cells: Callable[[int], int], target: float = TARGET) -> Index:
    """The cheapest setting that finds ``target`` of the neighbours (``found``, vectors of each of ``asks``), by a sample of rows."""
    width = index.signs.shape[-1]
    dims = rows.shape[1]
    big = [b for b in range(len(index.size)) if index.size[b] > EXACT]
    who = np.repeat(np.arange(len(found)), [len(f) for f in found])
    near = np.concatenate([*found, np.zeros((0, dims))])
    nb, rb = index.band(near), index.band(rows)
    y, best, best_cost = _lift(asks, None), None, (True, np.inf)
    ly = _lift(near, index.top[nb]) if len(near) else np.zeros((0, width))
    lr = _lift(rows, index.top[rb])
    scale = total / max(1, len(rows))
    settings = _settings(width, total)
    n_tables, n_hashes = min(TABLES, index.signs.shape[0]), max(map(len, settings))
    turned, axes = {}, {}  # of queries; of neighbours and rows, by the components that are looked at
    for t in range(n_tables):
        whole = replace(index, hashes=(width,) * n_hashes)
        turned[t] = whole.turned(y, t)
        for name, v in (("near", ly), ("rows", lr)):
            for h, z in enumerate(whole.turned(v, t)):
                for d in {x[h] for x in settings if len(x) > h}:
                    axes[name, t, h, d] = _axis(z[:, :d])

    def code_of(name: str, t: int, hashes: tuple[int, ...]) -> np.ndarray:
        code = np.zeros((), np.int64)
        for h, d in enumerate(hashes):
            code = code * (2 * d) + axes[name, t, h, d]
        return code

    for hashes in settings:
        setting = replace(index, hashes=hashes, probes=())
        most = min(PROBES, 2 * width * int(np.prod([min(2.0 * d, 16) for d in hashes[1:]])))
        rank = np.full((len(near),), most, np.int64)
        cost = {b: np.zeros(most) for b in big}
        for t in range(n_tables):
            probe = setting.nearest_codes(turned[t], most)
            hit = probe[who] == code_of("near", t, hashes)[:, None]
            rank = np.minimum(rank, np.where(hit.any(axis=1), hit.argmax(axis=1), most))
            held = code_of("rows", t, hashes)
            for b in big:
                code, n = np.unique(held[rb == b], return_counts=True)
                if len(code):
                    at = np.minimum(np.searchsorted(code, probe), len(code) - 1)
                    cost[b] += np.cumsum(np.where(code[at] == probe, n[at], 0).mean(axis=0)) * scale
            probes = []
            for b in range(len(index.size)):
                r = np.sort(rank[nb == b])
                want = int(np.ceil(target * len(r)))
                few = len(r) < 0.01 * len(near) or not want
                probes.append(1 if few else int(r[want - 1]) + 1)
            if any(probes[b] > most for b in big):
                continue
            tried = (t + 1) * sum(probes[b] for b in big)
            copies = total * (t + 1) + 2.5 * n_asks * min(tried, cells(t + 1))
            took = copies * SHIP * dims / 64 + n_asks * tried * LOOK + n_asks * sum(cost[b][probes[b] - 1] for b in big) * MEET * (dims + 64) / 128
            took = (copies > SHIPPED * total, took)
            if took < best_cost:
                best, best_cost = replace(setting, tables=t + 1, probes=tuple(probes)), took
    return best or replace(index, hashes=(width,), tables=1, probes=(2 * width,) * len(index.size))


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of 64-bit numbers."""
    z = np.asarray(x).astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _best(qv: np.ndarray, xv: np.ndarray, qid: np.ndarray, xid: np.ndarray, k: int, floor: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """Of each query the k best rows but itself, if not below its ``floor``: (query, row, exact score). Equal vectors get equal
    scores. And the floors that these rows set: a query's k best here are no worse."""
    s = qv @ xv.T
    s[qid[:, None] == xid[None, :]] = -np.inf
    if s.shape[1] > k:
        edge = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        floor = np.maximum(floor, edge - 1e-9 * np.maximum(1.0, np.abs(edge)))
    i, j = np.nonzero((s >= floor[:, None]) & (s > -np.inf))
    exact = np.empty(len(i))
    for at in range(0, len(i), 200_000):
        exact[at : at + 200_000] = (qv[i[at : at + 200_000]] * xv[j[at : at + 200_000]]).sum(axis=1)
    return (qid[i], xid[j], exact), floor


def _top(q: np.ndarray, x: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of each query, each row once."""
    o = np.lexsort((x, -s, q))
    q, x, s = q[o], x[o], s[o]
    new = np.ones(len(q), bool)
    new[1:] = (q[1:] != q[:-1]) | (x[1:] != x[:-1])
    q, x, s = q[new], x[new], s[new]
    start = np.ones(len(q), bool)
    start[1:] = q[1:] != q[:-1]
    rank = np.arange(len(q)) - np.maximum.accumulate(np.where(start, np.arange(len(q)), 0))
    return q[rank < k], x[rank < k], s[rank < k]



class _Cell:
    """A cell's rows by bucket; ``meet`` gives the best of a batch of queries."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, who: np.ndarray, sub: np.ndarray, k: int):
        o = np.argsort(sub, kind="stable")
        self.ids, self.x, self.who, self.sub, self.k = ids, x, who[o], sub[o], k
        self.most = k + len(ids) - len(np.unique(ids))  # repeated rows of an id take no other's place

    def meet(self, ids: np.ndarray, v: np.ndarray, who: np.ndarray, sub: np.ndarray, floor: np.ndarray) -> tuple | None:
        o = np.argsort(sub, kind="stable")
        who, sub = who[o], sub[o]
        edges = [0, *(np.flatnonzero(np.diff(sub)) + 1).tolist(), len(sub)]
        left, right = (np.searchsorted(self.sub, sub[edges[:-1]], side=s) for s in ("left", "right"))
        out = []
        floor = floor.copy()
        for a, z, p, q in zip(edges[:-1], edges[1:], left.tolist(), right.tolist()):
            for at in range(a, z if q > p else a, 1024):
                mine, theirs = who[at : min(z, at + 1024)], self.who[p:q]
                got, floor[mine] = _best(v[mine], self.x[theirs], ids[mine], self.ids[theirs], self.most, floor[mine])
                out.append(got)
        return _top(*(np.concatenate(c) for c in zip(*out)), self.k) if out else None


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", tables: int | None = None, probes: int | None = None, seed: int = SEED) -> DataFrame:
    """(query_id, rank, id_col, score): each query's k nearest rows found, by largest inner product, ties to the smaller id.

    A query never finds rows of its own id. Vectors that are null, zero, or hold null or non-finite components, vectors of
    another length than the commonest, and rows without an id take no part. Repeated rows of an id count once. Fewer
    candidates than k: all are returned. Queries that take no part, or empty tables, give no row. Extra columns are not read.
    ``tables`` and ``probes`` fix the setting: one whole polytope a table.
    """
    spark = vectors.sparkSession

    def clean(df: DataFrame) -> DataFrame:
        return df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).where(F.col("id").isNotNull() & usable("v"))

    base, dims = same_length(clean(vectors), "v")
    empty = f"query_id long, rank int, {id_col} long, score double"
    if not dims:
        return spark.createDataFrame([], empty)
    # Norms come from the largest component on, so that no square overflows.
    largest = base.select("v", F.array_max(F.transform("v", lambda x: F.abs(x.cast("double")))).alias("big"))
    share = lambda x: x.cast("double") / F.col("big")
    norm = largest.select((F.col("big") * F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + share(x) * share(x)))).alias("norm"))
    bins = norm.groupBy(F.floor(F.log2(F.greatest("norm", F.lit(1e-300))) * BINS).alias("bin")).agg(F.max("norm"), F.count("*")).collect()  # a bin is 1/BINS octave
    low, top, size = _bands([tuple(b) for b in bins])
    width, total = _width(dims), int(size.sum())
    ask = clean(queries).where(F.size("v") == dims)
    n_asks = ask.count()
    if not n_asks:
        return spark.createDataFrame([], empty)
    signs = np.random.default_rng(seed).choice([-1.0, 1.0], (max(TABLES, tables or 0), 3, 3, width))
    index = Index(low, top, size, signs)
    cells = lambda t: max(2 * shuffle_partitions(spark), -(-total * t // CELL))
    if tables and probes:
        index = replace(index, hashes=(width,), tables=tables, probes=(min(probes, 2 * width),) * len(size))
    some_ids, some = np.zeros(0, np.int64), np.zeros((0, dims))
    if not index.probes and size.max() > EXACT:
        some_ids, some, q, near = _sampled(base, ask, total, n_asks, dims, k, seed)
        index = choose(index, some, total, q, near, n_asks, cells)
        # Floors go by an eighth of all rows at most: a query's neighbours are still many times k of those that reach its floor.
        step = -(-len(some) * 8 // total)
        some_ids, some = some_ids[::step], some[::step]
    n_cells = cells(index.tables)
    kind = base.schema["v"].dataType.simpleString()

    def counted(df: DataFrame, of: Callable) -> dict[int, int]:
        """Blocks of the buckets that have over BLOCK rows, or over the millionth part of all."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, 2000):
                    code, n = np.unique(of(matrix(b.column(0).slice(at, 2000), dims))[1], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], names=["code", "n"])

        n = df.select("v").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
        every = total * index.tables + n_asks * index.tables * sum(index.probes)
        return {r.code: -(-r.n // BLOCK) for r in n.where(F.col("n") > max(BLOCK, every // 1_000_000)).collect()}

    def floors(ids: np.ndarray, x: np.ndarray) -> np.ndarray:
        """What a query's k-th nearest reaches by the sampled rows alone: worse rows needn't be sent on."""
        if len(some) <= k:
            return np.full(len(x), -np.inf)
        s = x @ some.T
        s[ids[:, None] == some_ids[None, :]] = -np.inf
        edge = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        return edge - 1e-9 * np.maximum(1.0, np.abs(edge))

    def shipped(df: DataFrame, side: int, of: Callable, nx: dict[int, int], nq: dict[int, int]) -> DataFrame:
        """(cell, side, id, v, subs, floor): each vector once a cell, with its buckets (or their blocks of queries) there."""
        heavy = np.array(sorted({*nx, *nq}), np.int64)
        n_mine, n_other = (np.array([d.get(int(c), 1) for c in heavy] + [1], np.int64) for d in ((nx, nq) if side == 0 else (nq, nx)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, 2000):
                    part = b.slice(at, 2000)
                    ids = part.column(0).to_numpy()
                    x = matrix(part.column(1), dims)
                    who, code = of(x)
                    floor = floors(ids, x) if side else np.zeros(len(ids))
                    place = np.searchsorted(heavy, code)
                    place = np.where((place < len(heavy)) & (np.append(heavy, 0)[place] == code), place, len(heavy))
                    mine = (_mix(ids[who] + side) % n_mine[place].astype(np.uint64)).astype(np.int64)
                    times = n_other[place]
                    each = np.repeat(np.arange(len(who)), times)
                    other = np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times)
                    who, code, mine = who[each], code[each], mine[each]
                    bx, bq = (mine, other) if side == 0 else (other, mine)
                    sub = _mix(code) ^ (_mix(bq + 1) << np.uint64(1))
                    cell = (_mix(sub.view(np.int64) + bx) % np.uint64(n_cells)).astype(np.int64)
                    sub = sub.view(np.int64)
                    o = np.lexsort((sub, cell, who))
                    who, cell, sub = who[o], cell[o], sub[o]
                    new = np.ones(len(who), bool)
                    new[1:] = (who[1:] != who[:-1]) | (cell[1:] != cell[:-1]) | (sub[1:] != sub[:-1])
                    who, cell, sub = who[new], cell[new], sub[new]
                    start = np.flatnonzero(np.append(True, (who[1:] != who[:-1]) | (cell[1:] != cell[:-1])))
                    subs = pa.ListArray.from_arrays(pa.array(np.append(start, len(who)).astype(np.int32)), pa.array(sub))
                    take = pa.array(who[start])
                    yield pa.RecordBatch.from_arrays([pa.array(cell[start].astype(np.int32)), pa.array(np.full(len(start), side, np.int32)), part.column(0).take(take), part.column(1).take(take), subs, pa.array(floor[who[start]])], names=["cell", "side", "id", "v", "subs", "floor"])

        return df.select("id", "v").mapInArrow(run, f"cell int, side int, id long, v {kind}, subs array<long>, floor double")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, cell = None, [], None

        def joined() -> tuple:
            ids, x, n, sub, floor = (np.concatenate(c) for c in zip(*held))
            held.clear()
            return ids, x, np.repeat(np.arange(len(ids)), n), sub, floor

        def out(got: tuple | None) -> Iterator[pa.RecordBatch]:
            if got is not None and len(got[0]):
                q, x, s = got
                start = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
                edges = pa.array(np.append(start, len(q)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(q[start]), pa.ListArray.from_arrays(edges, pa.array(x)), pa.ListArray.from_arrays(edges, pa.array(s))], names=["query_id", "ids", "scores"])

        for b in batches:
            where, side = b.column(0).to_numpy(), b.column(1).to_numpy()
            edges = [0, *(np.flatnonzero((where[1:] != where[:-1]) | (side[1:] != side[:-1])) + 1).tolist(), b.num_rows]
            for a, z in zip(edges[:-1], edges[1:]):
                if a == z:
                    continue
                key = (int(where[a]), int(side[a]))
                if key != now:
                    if held and now[1] == 0:
                        cell = _Cell(*joined()[:4], k) if now[0] == key[0] else None
                    elif held and cell:
                        yield from out(cell.meet(*joined()))
                    held.clear()
                    cell = cell if now and now[0] == key[0] else None
                    now = key
                if key[1] == 1 and cell is None:
                    continue  # no rows here
                part = b.slice(a, z - a)
                held.append((part.column(2).to_numpy(), matrix(part.column(3), dims), part.column(4).value_lengths().to_numpy(), part.column(4).flatten().to_numpy(), part.column(5).to_numpy()))
                if key[1] == 1 and sum(len(h[0]) for h in held) >= 4000:
                    yield from out(cell.meet(*joined()))
        if held and now[1] == 1 and cell:
            yield from out(cell.meet(*joined()))

    def ranked(*sides: DataFrame) -> DataFrame:
        met = sides[0].unionByName(sides[1]).repartition("cell").sortWithinPartitions("cell", "side").mapInArrow(compare, "query_id long, ids array<long>, scores array<double>")
        met = met.repartition("query_id").select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("z")).groupBy("query_id", F.col("z.ids").alias("id")).agg(F.max("z.scores").alias("score"))
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")

    nx, nq = counted(base, index.of_rows), counted(ask, index.of_queries)
    found = materialize(ranked(shipped(base, 0, index.of_rows, nx, nq), shipped(ask, 1, index.of_queries, nx, nq)))
    # Queries that met too few rows are compared with all of them.
    least = min(k, base.select("id").distinct().count()) if total <= 4 * k * (EXACT + 1) else k
    full = found.groupBy(F.col("query_id").alias("id")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    short = materialize(ask.join(full, "id", "left_anti"))
    n_short = short.count()
    if not n_short:
        return found
    nx, nq = {_REST: -(-total // BLOCK)}, {_REST: -(-n_short // BLOCK)}
    all_of = lambda x: (np.arange(len(x)), np.full(len(x), _REST, np.int64))
    rest = ranked(shipped(base, 0, all_of, nx, nq), shipped(short, 1, all_of, nx, nq))
    return found.join(short.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti").select(*rest.columns).unionByName(rest)


def _sampled(base: DataFrame, ask: DataFrame, total: int, n_asks: int, dims: int, k: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """About SAMPLE rows (ids, each once, and vectors), about ASKED queries, and the vectors of each one's k nearest rows."""

    def some(df: DataFrame, n: int, of: int) -> tuple[np.ndarray, np.ndarray]:
        share = int(min(1.0, 1.2 * n / of) * 1_000_000_007) + 1
        got = df.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_000_007)) < share).orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(n).select("id", "v").toArrow().combine_chunks()
        return got.column(0).to_numpy(), matrix(got.column(1).combine_chunks() if got.num_rows else pa.array([], pa.list_(pa.float64())), dims)

    (qid, q), (ids, rows) = some(ask, ASKED, n_asks), some(base, SAMPLE, total)
    ids, first = np.unique(ids, return_index=True)
    rows = rows[first]

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in qid]  # per query: (score, id, vector), the k best
        for b in batches:
            for at in range(0, b.num_rows, 4000):
                ids, x = b.column(0).slice(at, 4000).to_numpy(), matrix(b.column(1).slice(at, 4000), dims)
                s = q @ x.T
                s[qid[:, None] == ids[None, :]] = -np.inf
                top = np.argpartition(-s, k - 1, axis=1)[:, :k] if s.shape[1] > k else np.broadcast_to(np.arange(s.shape[1]), s.shape)
                for n, mine in enumerate(top):
                    least = held[n][-1][0] if len(held[n]) >= k else -np.inf
                    new = [(float(s[n, j]), int(ids[j]), x[j]) for j in mine if s[n, j] > least]
                    if new:
                        held[n] = sorted(held[n] + new, key=lambda c: (-c[0], c[1]))[:k]
        flat = [(n, *c) for n, h in enumerate(held) for c in h]
        if flat:
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in flat], pa.int32()), pa.array([f[1] for f in flat]), pa.array([f[2] for f in flat], pa.int64()), pa.array([f[3] for f in flat], pa.list_(pa.float64()))], names=["n", "s", "id", "v"])

    near: list[list] = [[] for _ in qid]
    if len(qid):
        w = Window.partitionBy("n").orderBy(F.desc("s"), "id")
        got = base.mapInArrow(best, "n int, s double, id long, v array<double>").withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("n", "v").toArrow()
        for n, v in zip(got.column(0).to_pylist(), matrix(got.column(1).combine_chunks(), dims)):
            near[n].append(v)
    return ids, rows, q, [np.array(v).reshape(-1, dims) for v in near]
