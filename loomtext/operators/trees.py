"""Dependency trees: checks as higher-order functions, decoders as Arrow-batched UDFs over score matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def in_cycle(heads: Column) -> Column:
    """1-based tokens that lie on a cycle of two or more: following heads comes back to them.

    Heads are composed with themselves by doubling; after log2(n) rounds tokens stand at a far ancestor, and those on a cycle
    are the images of that map that aren't the root. A token that is its own head isn't counted.
    """
    safe = F.transform(heads, lambda h, i: F.when((h == i + 1) | (h < 0), F.lit(0)).otherwise(h))
    step = lambda m: F.transform(m, lambda h: F.when(h == 0, F.lit(0)).otherwise(F.get(m, h - 1)))
    far = F.aggregate(F.sequence(F.lit(1), F.greatest(F.ceil(F.log2(F.size(heads).cast("double") + 1)).cast("int"), F.lit(1))), safe, lambda m, _: step(m))
    return F.array_sort(F.array_distinct(F.filter(far, lambda h: h != 0)))


def is_projective(heads: Column) -> Column:
    """No two arcs cross, and none spans its own head's arc; heads below 0 are unknown and left out."""
    arcs = F.filter(F.transform(heads, lambda h, i: F.struct(h.alias("h"), (i + 1).alias("d"), F.least(h, i + 1).alias("l"), F.greatest(h, i + 1).alias("r"))), lambda a: a["h"] >= 0)

    def bad(a: Column, b: Column) -> Column:
        back = ((a["l"] <= b["h"]) & (b["h"] <= a["r"]) & (a["h"] == b["d"])) | ((b["l"] <= a["h"]) & (a["h"] <= b["r"]) & (b["h"] == a["d"]))
        inside = lambda x: (a["l"] < x) & (x < a["r"])
        return (a["d"] < b["d"]) & (back | ((inside(b["l"]) | inside(b["r"])) & ((a["l"] - b["l"]) * (a["r"] - b["r"]) > 0)))

    return F.get(F.transform(F.array(arcs), lambda xs: ~F.exists(xs, lambda a: F.exists(xs, lambda b: bad(a, b)))), F.lit(0))


def is_tree(heads: Column, projective: bool = False, multiroot: bool = False) -> Column:
    roots = F.size(F.filter(heads, lambda h: h == 0))
    own = F.exists(F.transform(heads, lambda h, i: h == i + 1), lambda x: x)
    ok = (roots >= 1) & ~own & (F.size(in_cycle(heads)) == 0)
    if not multiroot:
        ok = ok & (roots == 1)
    return ok & is_projective(heads) if projective else ok


def next_siblings(heads: Column) -> Column:
    """For each 1-based token, the next one on the same side of the same head, seen from the head outwards; -1 if none.

    Heads below 0 are unknown. A token whose sibling lies nearer to their common head is named by that sibling instead.
    """
    h = F.transform(heads, lambda x: x.cast("int"))
    n = F.size(h)
    at = lambda i: F.get(h, i - 1)
    side = lambda i: F.signum((at(i) - i).cast("double"))
    spots = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    later = lambda i: F.get(F.filter(spots, lambda j: (j > i) & (at(i) >= 0) & (at(j) == at(i)) & (side(i) * side(j) > 0)), F.lit(0))
    pairs = F.filter(F.transform(spots, lambda i: F.struct(i.alias("i"), later(i).alias("j"))), lambda p: p["j"].isNotNull())
    named = F.transform(pairs, lambda p: F.when(F.abs(at(p["i"]) - p["i"]) > F.abs(at(p["j"]) - p["j"]), p).otherwise(F.struct(p["j"].alias("i"), p["i"].alias("j"))))
    return F.transform(spots, lambda i: F.coalesce(F.get(F.reverse(F.filter(named, lambda p: p["i"] == i)), F.lit(0))["j"], F.lit(-1)))


def _cycle(head: np.ndarray) -> list[int] | None:
    seen = np.zeros(len(head), int)
    for start in range(1, len(head)):
        path, v = [], start
        while v > 0 and not seen[v]:
            seen[v] = start
            path.append(v)
            v = head[v]
        if v > 0 and seen[v] == start:
            return path[path.index(v) :]
    return None


def _arborescence(s: np.ndarray) -> np.ndarray:
    """Best heads of nodes 1.. for scores s[dependent, head] with root 0."""
    s = s.copy()
    np.fill_diagonal(s, -np.inf)
    head = s.argmax(axis=1)
    head[0] = -1
    ring = _cycle(head)
    if ring is None:
        return head
    rest = [v for v in range(len(s)) if v not in set(ring)]
    at = {v: k for k, v in enumerate(rest)}
    c = len(rest)
    t = np.full((c + 1, c + 1), -np.inf)
    kept = s[ring, head[ring]]
    t[:c, :c] = s[np.ix_(rest, rest)]
    leave = s[np.ix_(rest, ring)]
    t[:c, c] = leave.max(axis=1)
    enter = s[np.ix_(ring, rest)] - kept[:, None]
    t[c, :c] = enter.max(axis=0)
    t[0] = -np.inf
    inner = _arborescence(t)
    out = head.copy()
    for v in rest[1:] if rest[0] == 0 else rest:
        h = inner[at[v]]
        out[v] = ring[int(leave[at[v]].argmax())] if h == c else rest[h]
    h = inner[c]
    first = int(enter[:, h].argmax())
    out[ring[first]] = rest[h]
    return out


def mst(scores, multiroot: bool = False) -> list[int]:
    """Heads of the best tree; with one root only, each root is tried and the best tree kept."""
    s = np.array(scores, float)
    s[0] = -np.inf
    head = _arborescence(s)
    if multiroot or (head[1:] == 0).sum() <= 1:
        return [0, *head[1:].tolist()]
    best, value = None, -np.inf
    for r in np.flatnonzero(head == 0):
        t = s.copy()
        t[1:, 0] = -np.inf
        t[r] = -np.inf
        t[r, 0] = s[r, 0]
        h = _arborescence(t)
        v = t[np.arange(1, len(t)), h[1:]].sum()
        if v > value:
            best, value = h, v
    return [0, *best[1:].tolist()]


def eisner(scores) -> list[int]:
    """Heads of the best projective tree with one root, by spans."""
    s = np.array(scores, float).T  # s[head, dependent]
    n = len(s)
    inf = -np.inf
    inc = np.full((n, n), inf)
    com = np.full((n, n), inf)
    bi, bc = np.zeros((n, n), int), np.zeros((n, n), int)
    np.fill_diagonal(com, 0)
    for w in range(1, n):
        for i in range(n - w):
            j = i + w
            mid = com[i, i:j] + com[j, i + 1 : j + 1]
            k = int(mid.argmax())
            inc[i, j], inc[j, i], bi[i, j], bi[j, i] = mid[k] + s[i, j], mid[k] + s[j, i], i + k, i + k
            left = inc[j, i:j] + com[i:j, i]
            k = int(left.argmax())
            com[j, i], bc[j, i] = left[k], i + k
            right = inc[i, i + 1 : j + 1] + com[i + 1 : j + 1, j]
            k = int(right.argmax())
            com[i, j], bc[i, j] = right[k], i + 1 + k
            if i == 0 and w < n - 1:
                com[0, j] = inf
    head = [0] * n

    def walk(i: int, j: int, whole: bool) -> None:
        if i == j:
            return
        if whole:
            k = int(bc[i, j])
            walk(i, k, False)
            walk(k, j, True)
        else:
            head[j] = i
            a, b = sorted((i, j))
            k = int(bi[i, j])
            walk(a, k, True)
            walk(b, k + 1, True)

    walk(0, n - 1, True)
    return head


def eisner_siblings(scores, siblings) -> list[int]:
    """Heads of the best projective tree with one root, where a dependent is also scored by the dependent of its head next to it on its inner side.

    ``scores``[dependent][head]; ``siblings``[dependent][head][sibling], nothing for the dependent nearest to its head. Spans of three kinds: an arc and
    what is under it, a head and all on one side, and two neighbouring dependents of one head with what lies between them.
    """
    s = np.array(scores, float)
    n = len(s)
    t = np.array(siblings, float).reshape(n, n, n) if n else np.zeros((0, 0, 0))
    if n < 2:
        return [0] * n
    arc = np.full((n, n), -np.inf)  # [head, dependent]
    side = np.full((n, n), -np.inf)  # [head, furthest word]
    pair = np.full((n, n), -np.inf)  # [nearer, further], both ways the same
    arc_at, side_at, pair_at = ({} for _ in range(3))
    np.fill_diagonal(side, 0)
    for width in range(1, n):
        for i in range(n - width):
            j = i + width
            inner = side[i, i:j] + side[j, i + 1 : j + 1]
            k = int(inner.argmax())
            pair[i, j] = pair[j, i] = inner[k]
            pair_at[i, j] = i + k
            for head, dep in ((i, j), (j, i)):
                if not dep:
                    continue
                step = 1 if dep > head else -1
                first = side[head, head] + side[dep, head + step]
                best, at = first, head
                for r in range(head + step, dep, step) if head else ():  # the root takes one dependent
                    v = arc[head, r] + pair[r, dep] + t[dep, head, r]
                    if v > best:
                        best, at = v, r
                arc[head, dep], arc_at[head, dep] = best + s[dep, head], at
            for head, end in ((i, j), (j, i)):
                step = 1 if end > head else -1
                best, at = -np.inf, None
                for r in range(head + step, end + step, step):
                    v = arc[head, r] + side[r, end]
                    if v > best:
                        best, at = v, r
                side[head, end], side_at[head, end] = best, at
    heads = [0] * n

    def open_side(head: int, end: int) -> None:
        if head != end:
            r = side_at[head, end]
            open_side(r, end)
            open_arc(head, r)

    def open_arc(head: int, dep: int) -> None:
        heads[dep] = head
        at = arc_at[head, dep]
        if at == head:
            open_side(dep, head + (1 if dep > head else -1))
        else:
            a, b = sorted((at, dep))
            k = pair_at[a, b]
            open_side(a, k)
            open_side(b, k + 1)
            open_arc(head, at)

    open_side(0, n - 1)
    return heads


def decode_siblings(scores: Column, siblings: Column) -> Column:
    """array<int> heads by ``eisner_siblings`` of array<array<double>> and array<array<array<double>>>; null for nulls."""

    @F.arrow_udf("array<int>")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([None if x is None or y is None else eisner_siblings(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.list_(pa.int32()))

    return run(scores, siblings)


def decode(scores: Column, kind: str = "mst") -> Column:
    """array<int> heads of array<array<double>> scores[dependent][head], row 0 the root's."""

    @F.pandas_udf("array<int>")
    def run(v):
        import pandas as pd

        f = mst if kind == "mst" else eisner
        return pd.Series([f([list(r) for r in x]) for x in v], dtype=object)

    return run.asNondeterministic()(scores)


def cky(scores) -> list[tuple[int, int]]:
    """Spans of the best binary tree over scores[from][to] of spans between fences 0 to n, in pre-order; ties to the first split."""
    s = np.array(scores, float)
    n = len(s) - 1
    if n < 1:
        return []
    best, cut = np.zeros_like(s), np.zeros(s.shape, int)
    for w in range(1, n + 1):
        for i in range(n + 1 - w):
            j = i + w
            if w > 1:
                inner = best[i, i + 1 : j] + best[i + 1 : j, j]
                k = int(inner.argmax())
                best[i, j], cut[i, j] = inner[k], i + 1 + k
            best[i, j] += s[i, j]
    out, todo = [], [(0, n)]
    while todo:
        i, j = todo.pop()
        out.append((i, j))
        if j > i + 1:
            todo += [(int(cut[i, j]), j), (i, int(cut[i, j]))]
    return out


def constituents(scores: Column) -> Column:
    """array<struct<start, stop>> of array<array<double>> span scores."""

    @F.pandas_udf("array<struct<start:int,stop:int>>")
    def run(v):
        import pandas as pd

        return pd.Series([None if x is None else [{"start": a, "stop": b} for a, b in cky([list(r) for r in x])] for x in v], dtype=object)

    return run.asNondeterministic()(scores)
