"""Quality by pairwise ranking: a Bradley-Terry model of which of two documents is the better one.

A document's worth is a linear function of FEATURES numbers of its whole text; the chance that one is preferred is the logistic function of the
difference of their worths. It is learned from pairs of a better and a worse labelled document: rows of the commoner label, all of them,
each against PAIRS rows of the other (of which at most about PARTNERS, picked by a hash, travel to the tasks). Newton steps; each sums
gradient and curvature where the rows are. A document counts as good above the quantile of worth that the share of bad labels gives; scores are
logistic in worth and equal ``cut`` at that quantile.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import starmap
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import discard, materialize

#: Labelled rows of the rarer label that others are compared with, at most about so many.
PARTNERS = 8_000
PAIRS = 4
CUT = 0.3
PENALTY = 1e-3
STEPS = 12

#: Marks whose shares count one by one; the other ASCII marks count together.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SHAPE = ["letters", "capitals", "digits", "spaces", "lines", "controls", "others"]
WORDS = ["log_words", "log_chars", "word_length", "long_words", "distinct_words", "repeated_next", "repeated_after_next", "shouted", "ends_in_mark", "inner_mark", "single"]
LINES = ["distinct_lines", "words_a_line", "lines_end_in_stop"]
FEATURES = len(MARKS) + len(SHAPE) + len(WORDS) + len(LINES)


@cache
def _classes() -> np.ndarray:
    """Each code point's place among marks and shapes."""
    n = len(MARKS)
    out = np.full(0x110000, n + 6, np.uint8)
    for cp in range(0x110000):
        c = chr(cp)
        if c in MARKS:
            out[cp] = MARKS.index(c)
        elif c.isalpha():
            out[cp] = n + (1 if c.isupper() else 0)
        elif c.isdigit():
            out[cp] = n + 2
        elif c == "\n":
            out[cp] = n + 4
        elif c.isspace():
            out[cp] = n + 3
        elif cp < 32 or 127 <= cp < 160:
            out[cp] = n + 5
    return out


def measure(text: str | None) -> np.ndarray:
    """The features of a whole text; zeros for a null or empty one."""
    out = np.zeros(FEATURES, np.float32)
    if not text:
        return out
    cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n, m = len(MARKS), len(MARKS) + len(SHAPE)
    out[:m] = np.bincount(_classes()[cps], minlength=m) / len(cps)
    letters = out[n] + out[n + 1]
    out[n + 1] = out[n + 1] / letters if letters else 0
    out[n] = letters
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    if words:
        k = len(words)
        size = np.fromiter(map(len, words), np.int64, k)
        last = [w[-1] for w in words]
        out[m : m + len(WORDS)] = [
            np.log1p(k) / 10, np.log1p(len(cps)) / 10, min(1.0, size.mean() / 20), (size > 20).mean(), len(set(words)) / k,
            sum(starmap(eq, zip(words, words[1:]))) / k, sum(starmap(eq, zip(words, words[2:]))) / k, sum(map(str.isupper, words)) / k,
            1 - sum(map(str.isalnum, last)) / k, 1 - sum(w[:-1].isalnum() for w in words) / k, (size == 1).mean(),
        ]
        out[m + len(WORDS) :] = [len(set(lines)) / len(lines), min(1.0, k / len(lines) / 100), sum(x.rstrip()[-1] in ".!?" for x in lines) / len(lines)]
    np.sqrt(out, out=out, where=out > 0)
    return out


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    #: Worth of the quantile, the score there, and a score that all get (where nothing could be compared).
    at: float
    cut: float
    always: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.always is not None:
            return np.full(len(x), self.always)
        z = x.astype(float) @ self.weights - self.at + np.log(self.cut / (1 - self.cut))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def measured(docs: DataFrame, text_col: str = "text", name: str = "features") -> DataFrame:
    """``docs`` without the text, with its features as an array of floats."""
    rest = [c for c in docs.columns if c not in (text_col, name)]

    @F.pandas_udf("array<float>")
    def run(texts):
        import pandas as pd

        return pd.Series([measure(t) for t in texts])

    return docs.select(*[F.col(f"`{c}`") for c in rest], run.asNondeterministic()(F.col(f"`{text_col}`")).alias(name))


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, FEATURES)


def _sums(rows: DataFrame, weights: np.ndarray, partners: np.ndarray, sign: int, pairs: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Number of pairs, gradient and curvature of the logistic loss of all pairs."""
    d = len(weights)
    shared = rows.sparkSession.sparkContext.broadcast(partners)  # at most about PARTNERS rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, other = np.zeros(1 + d + d * d), shared.value
        for b in batches:
            x, h = _rows(b.column(0)), b.column(1).to_numpy().astype(np.uint64)
            for k in range(pairs):
                y = other[((h >> np.uint64(16 * k % 64)) % np.uint64(len(other))).astype(np.int64)]
                diff = sign * (x - y)
                miss = 1 / (1 + np.exp(np.clip(diff @ weights, -500, 500)))
                total[0] += len(x)
                total[1 : 1 + d] -= miss @ diff
                total[1 + d :] += ((diff * (miss * (1 - miss))[:, None]).T @ diff).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["s"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + d + d * d)
        for b in batches:
            total += b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(total)).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["s"])

    got = rows.select("x", "h").mapInArrow(run, "s array<double>").repartition(16).mapInArrow(add, "s array<double>").toArrow()
    shared.unpersist()
    s = np.sum(got.column("s").to_pylist(), axis=0)
    return float(s[0]), s[1 : 1 + d], s[1 + d :].reshape(d, d)


def fit(features: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", name: str = "features", partners: int = PARTNERS, pairs: int = PAIRS, cut: float = CUT) -> Model:
    """Learn from ``features`` (``id_col``, ``name``) and ``labels`` (``id_col``, ``label_col`` of 0 and 1), joined by id.

    Null ids and labels teach nothing; an id with several labels has their mean, rounded up from a half. Rows of equal features and label teach once.
    Where only one label is known it is everyone's score; where none is, a half is.
    """
    mark = labels.where(F.col(f"`{id_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`").alias("id")).agg((F.avg(f"`{label_col}`") >= 0.5).cast("int").alias("y")).where("y IS NOT NULL")
    known = features.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{name}`").alias("x")).join(mark, "id").select("x", "y").distinct()
    known = materialize(known.withColumn("h", F.xxhash64(F.lit(7), "x")))
    n = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return Model(np.zeros(FEATURES), 0.0, cut, float(next(iter(n), 0.5)))
    rare = int(n[1] < n[0])
    few = known.where(F.col("y") == rare)
    if n[rare] > partners:
        few = few.where(F.pmod("h", F.lit(1_000_000)) < int(1_000_000 * partners / n[rare]) + 1)
    other = _rows(few.select("x", "h").orderBy("h", "x").toArrow().combine_chunks().column("x").combine_chunks())
    many = known.where(F.col("y") != rare)
    w, sign = np.zeros(FEATURES), -1 if rare else 1
    for _ in range(STEPS):
        count, slope, bend = _sums(many, w, other, sign, pairs)
        step = np.linalg.solve(bend / count + PENALTY * np.eye(FEATURES), slope / count + PENALTY * w)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    bad = n[0] / (n[0] + n[1])
    worth = F.aggregate(F.zip_with("x", F.array(*[F.lit(float(v)) for v in w]), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    apart = 0.2 * min(bad, 1 - bad)
    below, above = known.select(worth.alias("u")).agg(F.percentile_approx("u", [bad - apart, bad + apart], 100_000)).first()[0]
    discard(known)
    return Model(w, (below + above) / 2, cut)


def scored(features: DataFrame, model: Model, name: str = "features", names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``features`` with the score in place of the features, and 1 where it is at least the model's cut, else 0."""
    rest = [c for c in features.columns if c not in (name, *names)]

    @F.pandas_udf("double")
    def run(column):
        import pandas as pd

        return pd.Series(model.score(np.stack(column.to_list())) if len(column) else [])

    got = features.select(*[F.col(f"`{c}`") for c in rest], run.asNondeterministic()(F.col(f"`{name}`")).alias(names[0]))
    return got.withColumn(names[1], (F.col(names[0]) >= model.cut).cast("int"))


def rate(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", learn: Column | None = None, **settings: float) -> DataFrame:
    """``docs`` without the text, with ``score`` and ``predicted``; learned from ``labels``, of which only the rows of ``learn``.

    Texts are read once: their features are written and both learned from and scored. All rows stay, also null and empty texts and repeated ids.
    Other columns stay; those named score or predicted are replaced.
    """
    own = "__loomtext_features"
    kept = materialize(measured(docs, text_col, own))
    model = fit(kept, labels if learn is None else labels.where(learn), id_col, label_col, own, **settings)
    return scored(kept, model, own)
