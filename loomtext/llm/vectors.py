"""Vector columns: which rows take part, Arrow lists as NumPy matrices, and blocks of whole-number vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vec: str) -> Column:
    """True for vectors that are set, hold only finite components and are not all zero."""
    v = F.col(vec)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def same_length(df: DataFrame, vec: str) -> tuple[DataFrame, int]:
    """The rows whose vector has the commonest length, and that length; 0 for an empty table."""
    n = df.agg(F.mode(F.size(vec), True)).first()[0]
    return (df.where(F.size(vec) == n), n) if n else (df, 0)


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def finite(vec: str) -> Column:
    """True for vectors that are set and hold neither nulls nor non-finite components."""
    v = F.col(vec)
    return F.coalesce(v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


#: Components of a block's vectors.
BLOCK_CELLS = 1 << 18


def largest(dims: int) -> int:
    """The largest component with which squared distances and inner products of so many integers stay longs."""
    return math.isqrt((1 << 62) // max(1, dims)) // 2


def integer_blocks(df: DataFrame, dims: int, scale: int, vec: str, **lists: Column) -> DataFrame:
    """Vectors as floor(scale * x) in blocks of BLOCK_CELLS components, one row a block; no shuffle, no order.

    Columns: ``block`` (unlike for each row), ``x`` (components, row by row, in 2 or 4 bytes each), and for each of ``lists`` an
    array of that column's values. Components beyond ``largest(dims)`` saturate there.
    """
    names = list(lists)
    kinds = df.select(*[c.alias(n) for n, c in lists.items()]).schema
    rows, most = max(1, BLOCK_CELLS // dims), largest(dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 33
        for whole in batches:
            for start in range(0, whole.num_rows, rows):
                b = whole.slice(start, rows)
                x = np.clip(np.floor(scale * matrix(b.column("__v"), dims)), -most, most)
                kind = np.int16 if np.abs(x).max(initial=0) < 1 << 15 else np.int32
                held = [pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column(n)) for n in names]
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([x.astype(kind).tobytes()], pa.binary()), *held], names=["block", "x", *names])
                at += 1

    made = ", ".join(f"{f.name} array<{f.dataType.simpleString()}>" for f in kinds.fields)
    return df.select(*[c.alias(n) for n, c in lists.items()], F.col(vec).alias("__v")).mapInArrow(run, f"block long, x binary, {made}")


def integers(x: bytes, dims: int, rows: int) -> np.ndarray:
    """The int64 matrix of a block."""
    kind = np.int16 if len(x) == 2 * dims * rows else np.int32
    return np.frombuffer(x, kind).astype(np.int64).reshape(rows, dims)


def summed(df: DataFrame, column: str, length: int, slots: int = 16) -> np.ndarray:
    """Component sums of an array column, as longs; rows are summed in ``slots`` tasks and then on the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(length, np.int64)
        for b in batches:
            total += b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, length).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.int64()))], names=["s"])

    got = df.select(column).mapInArrow(run, "s array<long>").repartition(slots).mapInArrow(run, "s array<long>").toArrow()
    return np.array(got.column(0).to_pylist(), np.int64).reshape(-1, length).sum(axis=0)
