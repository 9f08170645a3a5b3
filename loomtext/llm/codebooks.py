"""Vector codes: each vector is cut into parts, each part is named by the nearest entry of its position's codebook.

Lloyd rounds over heaps. Each block of rows keeps, for each part position and entry, a heap of the parts assigned to it, keyed by slack:
the lower bound of the distance to any other entry minus the upper bound of the distance to its own. Moving entries use slack up:
after a round an entry's threshold grows by its own drift and the largest drift of the others, and only parts whose key the
cumulative drift has reached are popped and rescanned exactly; the others keep their entry without any distance. A key is slack at the
scan plus the drift until then, so keys never change while a part stays. A heap is stored as its sorted array: all pops of a round are one binary search, and pushed
parts are merged in.

Blocks, with their heaps, are written once a round and read by the next, so a lost executor costs a round's blocks at most; no vector is shuffled.
Whole numbers throughout: distances are exact, bounds are rounded so that they err towards a rescan, and the codes are those of plain Lloyd rounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import discard, materialize
from loomtext.llm.vectors import finite, integer_blocks, integers, same_length, summed

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Labels up to which their sums are broadcast; beyond, rows and sums meet in a salted shuffle.
LABELS = 100_000
SALTS = 64


@dataclass
class Codebooks:
    """``entries`` [part][entry, position]: whole numbers."""

    entries: list[np.ndarray]
    scale: int = SCALE
    #: Parts rescanned in each assignment, of how many.
    rescanned: list[int] = field(default_factory=list)

    def digest(self) -> str:
        """SHA-256 of all components as decimal numbers by part, entry, position."""
        return hashlib.sha256(",".join(str(v) for e in self.entries for v in e.ravel().tolist()).encode()).hexdigest()

    def decode(self, code: str) -> list[float]:
        """The vector that a code stands for: the middle of each entry's cell."""
        return [(v + 0.5) / self.scale for p, e in enumerate(self.entries) for v in e[int(code[2 * p : 2 * p + 2], 16)].tolist()]


def cuts(dims: int, parts: int) -> list[slice]:
    """Consecutive parts, equal where ``parts`` divides ``dims``."""
    return [slice(dims * p // parts, dims * (p + 1) // parts) for p in range(parts)]


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances [row, entry] of whole numbers."""
    most = max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0))
    if 4 * x.shape[1] * int(most) ** 2 < 1 << 53:
        a, c = x.astype(float), entries.astype(float)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    return np.stack([((x - e) ** 2).sum(axis=1) for e in entries], axis=1)


def scan(x: np.ndarray, entries: np.ndarray, spent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest entry, key) of each row: ties to the lower index; keys are rounded down."""
    d = distances(x, entries)
    best = np.argmin(d, axis=1)
    upper = np.sqrt(d[np.arange(len(x)), best].astype(float))
    d[np.arange(len(x)), best] = np.iinfo(np.int64).max
    lower = np.sqrt(d.min(axis=1).astype(float)) if d.shape[1] > 1 else np.full(len(x), np.inf)
    exact = np.where(np.isinf(lower), np.inf, lower * (1 - 1e-9) - upper * (1 + 1e-9)) + spent[best] * (1 - 1e-9)
    key = exact.astype(np.float32)
    return best, np.where(key > exact, np.nextafter(key, np.float32(-np.inf)), key)


class Heaps:
    """A block's heaps of one part position: rows by entry, then by key."""

    def __init__(self, rows: np.ndarray, keys: np.ndarray, sizes: np.ndarray):
        self.rows, self.keys, self.sizes = rows, keys, sizes

    @classmethod
    def of(cls, rows: np.ndarray, entry: np.ndarray, keys: np.ndarray, n_entries: int) -> Heaps:
        order = np.lexsort((keys, entry))
        return cls(rows[order].astype(np.uint32), keys[order], np.bincount(entry, minlength=n_entries).astype(np.uint32))

    def entry(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.sizes)), self.sizes)

    def popped(self, spent: np.ndarray) -> np.ndarray:
        """Which places hold keys that the drift of their entry has reached: the first of each entry's run."""
        out = np.zeros(len(self.rows), bool)
        ends = np.cumsum(self.sizes, dtype=np.int64)
        for e, (a, b) in enumerate(zip(ends - self.sizes, ends)):
            out[a : a + np.searchsorted(self.keys[a:b], np.float64(spent[e]), side="right")] = True
        return out


def _totals(x: np.ndarray, entry: np.ndarray, n: int, sign: int, out: np.ndarray) -> None:
    """Add sums and counts by entry to ``out`` [entry, position or count]."""
    full = np.concatenate([x, np.ones((len(x), 1), np.int64)], axis=1)
    np.add.at(out, entry, sign * full)


def _advance(x: np.ndarray, heaps: list[Heaps] | None, books: list[np.ndarray], spent: list[np.ndarray], cut: list[slice]) -> tuple[list[Heaps], np.ndarray, int]:
    """The block's heaps after an assignment, what it changes in sums and counts, and the parts scanned."""
    out, delta, scanned = [], [], 0
    for p, part in enumerate(cut):
        y, book = x[:, part], books[p]
        d = np.zeros((len(book), y.shape[1] + 1), np.int64)
        if heaps is None:
            rows = np.arange(len(x))
            best, keys = scan(y, book, spent[p])
            _totals(y, best, len(book), 1, d)
            h, n = Heaps.of(rows, best, keys, len(book)), len(rows)
        else:
            h = heaps[p]
            hit = h.popped(spent[p])
            rows, was, n = h.rows[hit], h.entry()[hit], int(hit.sum())
            if n:
                best, keys = scan(y[rows], book, spent[p])
                moved = best != was
                _totals(y[rows[moved]], was[moved], len(book), -1, d)
                _totals(y[rows[moved]], best[moved], len(book), 1, d)
                h = Heaps.of(np.concatenate([h.rows[~hit], rows]), np.concatenate([h.entry()[~hit], best]), np.concatenate([h.keys[~hit], keys]), len(book))
        out.append(h)
        delta.append(d.ravel())
        scanned += n
    return out, np.concatenate(delta), scanned


def _packed(heaps: list[Heaps]) -> list[bytes]:
    return [np.concatenate([getattr(h, n) for h in heaps]).tobytes() for n in ("rows", "keys", "sizes")]


def _unpacked(rows: bytes, keys: bytes, sizes: bytes, n: int, books: list[np.ndarray]) -> list[Heaps]:
    r, k, s = np.frombuffer(rows, np.uint32).reshape(-1, n), np.frombuffer(keys, np.float32).reshape(-1, n), np.frombuffer(sizes, np.uint32)
    at = np.cumsum([0, *(len(b) for b in books)])
    return [Heaps(r[p], k[p], s[at[p] : at[p + 1]]) for p in range(len(books))]


_HEAPS = "heap_rows binary, heap_keys binary, heap_sizes binary, delta array<long>"


def _assigned(blocks: DataFrame, books: list[np.ndarray], spent: list[np.ndarray], cut: list[slice], dims: int) -> DataFrame:
    """Blocks after an assignment, with ``delta``: what it changes in all sums and counts, and the parts scanned at the end."""
    first = "delta" not in blocks.columns
    kinds = {f.name: f.dataType.simpleString() for f in blocks.schema.fields if f.name in ("block", "x", "id", "label")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(whole.num_rows):
                b = whole.slice(k, 1)
                n = len(b.column("id").flatten())
                get = lambda c, b=b: b.column(c)[0].as_py()
                x = integers(get("x"), dims, n)
                heaps = None if first else _unpacked(get("heap_rows"), get("heap_keys"), get("heap_sizes"), n, books)
                heaps, delta, scanned = _advance(x, heaps, books, spent, cut)
                made = [pa.array([v], pa.binary()) for v in _packed(heaps)] + [pa.array([[*delta.tolist(), scanned]], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kinds), *made], names=[*kinds, "heap_rows", "heap_keys", "heap_sizes", "delta"])

    return blocks.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in kinds.items()) + f", {_HEAPS}")


def _coded(blocks: DataFrame, books: list[np.ndarray], cut: list[slice], dims: int) -> DataFrame:
    """A row a vector: id, label, code, error."""
    kinds = {f.name: f.dataType.elementType.simpleString() for f in blocks.schema.fields if f.name in ("id", "label")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(whole.num_rows):
                b = whole.slice(k, 1)
                ids = b.column("id").flatten()
                get = lambda c, b=b: b.column(c)[0].as_py()
                x = integers(get("x"), dims, len(ids))
                code, error = np.zeros((len(ids), len(cut)), np.uint8), np.zeros(len(ids), np.int64)
                for p, h in enumerate(_unpacked(get("heap_rows"), get("heap_keys"), get("heap_sizes"), len(ids), books)):
                    code[h.rows, p] = h.entry()
                    error += ((x[:, cut[p]] - books[p][code[:, p]]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([ids, b.column("label").flatten(), pa.array([r.tobytes().hex() for r in code], pa.string()), pa.array(error)], names=["id", "label", "code", "error"])

    return blocks.select("id", "label", "x", "heap_rows", "heap_keys", "heap_sizes").mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, code string, error long")


def fit_codes(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Codebooks]:
    """(rows of ``id_col``, ``label_col``, ``code``, ``error``; the codebooks) after ``rounds`` Lloyd rounds and a last assignment.

    Vectors that are null, empty, or hold null or non-finite components drop; of vectors of unequal lengths those of the commonest stay. Codebooks
    begin as the parts of the vectors of smallest id, nulls last, equal ids by their components; with fewer vectors than ``entries`` there are fewer.
    Repeated rows stay and count each. An empty table gives no rows and empty codebooks. Other columns don't matter, whatever their names.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has one byte a part: entries must be from 1 to 256")
    d = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vec_col}`").alias("v"))
    d, dims = same_length(d.where(finite("v")), "v")
    back = [F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error"]
    if not dims:
        none = vectors.sparkSession.createDataFrame([], d.select("id", "label").schema)
        return none.select(F.col("id").alias(id_col), F.col("label").alias(label_col), F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), Codebooks([np.zeros((0, 0), np.int64)] * parts, scale)
    cut = cuts(dims, parts)
    blocks = materialize(integer_blocks(d, dims, scale, "v", id=F.col("id"), label=F.col("label")))
    seeds = integer_blocks(d.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).coalesce(1), dims, scale, "v", id=F.col("id")).toArrow()
    start = np.concatenate([integers(x, dims, len(i)) for x, i in zip(seeds.column("x").to_pylist(), seeds.column("id").to_pylist())])
    books = [start[:, c].copy() for c in cut]
    totals = [np.zeros((len(b), b.shape[1] + 1), object) for b in books]
    spent = [np.zeros(len(b)) for b in books]
    length = sum(t.size for t in totals) + 1
    found = Codebooks(books, scale)
    for r in range(rounds + 1):
        before, blocks = blocks, materialize(_assigned(blocks, books, spent, cut, dims))
        discard(before)
        change = summed(blocks, "delta", length)
        found.rescanned.append(int(change[-1]))
        if r == rounds:
            break
        at = 0
        for p, t in enumerate(totals):
            t += change[at : at + t.size].reshape(t.shape).astype(object)
            at += t.size
            old = books[p]
            books[p] = np.array([[s // row[-1] for s in row[:-1]] if row[-1] else o.tolist() for row, o in zip(t, old)], np.int64).reshape(old.shape)
            drift = np.sqrt(((books[p] - old).astype(float) ** 2).sum(axis=1)) * (1 + 1e-9)
            top = np.sort(drift)[::-1]
            spent[p] = (spent[p] + drift + np.where((drift == top[0]) & (np.arange(len(drift)) == np.argmax(drift)), top[1] if len(top) > 1 else 0, top[0])) * (1 + 1e-12)
    found.entries = books
    return _coded(blocks, books, cut, dims).select(*back), found


def code_table(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", **settings: int) -> DataFrame:
    """One row a kept vector: ``id_col``, ``code``, ``error``, ``label_error`` (of all rows of its label, nulls together; null where it exceeds a long), ``codebooks_sha256``."""
    rows, found = fit_codes(vectors, id_col, vec_col, label_col, **settings)
    rows = materialize(rows.toDF("id", "label", "code", "error"))
    sums = materialize(rows.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("s")).select(F.col("label").alias("of"), F.expr("try_cast(s AS bigint)").alias("label_error")))
    same = F.col("label").eqNullSafe(F.col("of"))
    if sums.count() <= LABELS:
        got = rows.join(F.broadcast(sums), same)
    else:
        salted = sums.withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        got = rows.withColumn("salt", F.pmod(F.xxhash64("id", "code", "error"), F.lit(SALTS)).cast("int")).join(salted, same & (F.col("salt") == F.col("to")))
    return got.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(found.digest()).alias("codebooks_sha256"))
