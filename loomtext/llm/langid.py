"""Language identification by mixture inference over character trigrams.

A document is a mixture of languages: each of its trigrams was drawn from one of them. Expectation-maximisation estimates
the proportions; the set of languages is the one whose penalised likelihood is best, grown one language at a time in order
of their share. The prediction is the language with the largest share in that set, its score that share.
Trigram counts per language come from labelled documents, at most about FIT_ROWS of them, picked whole by a hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE_BITS = 16
#: Expected number of labelled documents to learn from, at most.
FIT_ROWS = 8_000
#: Log-likelihood a further language must add, times the logarithm of the trigrams: trigrams overlap, so each character counts thrice.
PENALTY = 3.0
ROUNDS = 12
SMOOTH = 0.5
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """Each code point's lower-case letter, or a space where it is no letter."""
    out = np.full(0x110000, 32, np.uint32)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            low = c.lower()
            out[cp] = ord(low[0])
    return out


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of a whole text's trigrams of letters and single spaces; nothing for a text without letters."""
    cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.concatenate([[32], _letters()[cps], [32]]).astype(np.uint32)
    c = c[np.concatenate([[True], (c[1:] != 32) | (c[:-1] != 32)])]
    if len(c) < 3:
        return np.zeros(0, np.int64), np.zeros(0)
    with np.errstate(over="ignore"):
        h = (c[:-2] * np.uint32(2654435761)) ^ (c[1:-1] * np.uint32(2246822519)) ^ (c[2:] * np.uint32(3266489917))
        h = (h ^ (h >> np.uint32(15))) * np.uint32(668265263)
    count = np.bincount(h >> np.uint32(32 - SPACE_BITS), minlength=0)
    at = np.flatnonzero(count)
    return at, count[at].astype(float)


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    logp: np.ndarray  # [buckets, languages]


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", key: Column | None = None, rows: int = FIT_ROWS) -> Model:
    """Learn from rows with a text and a label; of more than ``rows``, those whose hash of ``key`` is in the matching share."""
    d = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    n = d.count()
    if n > rows:
        h = F.xxhash64(F.lit(29), key if key is not None else F.col(text_col))
        d = d.where(F.pmod(h, F.lit(1_000_000)) < int(1_000_000 * rows / n) + 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                at, n = trigrams(text)
                held.setdefault(lang, np.zeros(1 << SPACE_BITS))[at] += n
        for lang, v in held.items():
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(v[at])], names=["lang", "bucket", "n"])

    got = d.select(text_col, lang_col).mapInArrow(count, "lang string, bucket int, n double").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    t = got.toArrow()  # at most 65,536 rows a language
    langs = tuple(sorted(set(t.column(0).to_pylist())))
    if not langs:
        return Model((), np.zeros((1 << SPACE_BITS, 0)))
    counts = np.zeros((1 << SPACE_BITS, len(langs)))
    where = {x: k for k, x in enumerate(langs)}
    counts[t.column(1).to_numpy(), [where[x] for x in t.column(0).to_pylist()]] = t.column(2).to_numpy()
    counts += SMOOTH
    return Model(langs, np.log(counts / counts.sum(axis=0)))


def _em(p: np.ndarray, n: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Proportions of the columns of ``p`` (likelihoods of each trigram), and the log-likelihood."""
    share = np.full(p.shape[1], 1.0 / p.shape[1])
    total = n.sum()
    for _ in range(rounds if p.shape[1] > 1 else 0):
        mix = p @ share
        share = share * ((n / mix) @ p) / total
    return share, float(n @ np.log(np.maximum(p @ share, 1e-300)))


def infer(text: str | None, model: Model) -> tuple[str, float, dict[str, float]]:
    """(language, score, proportions of the selected set)."""
    at, n = trigrams(text) if text else (np.zeros(0, np.int64), np.zeros(0))
    if not len(at) or not model.langs:
        return UNKNOWN, 0.0, {}
    p = np.exp(model.logp[at])
    full, _ = _em(p, n)
    order = np.lexsort((np.arange(len(full)), -full))
    price = PENALTY * np.log(max(2.0, n.sum()))
    best, best_value = (np.ones(1), order[:1]), _em(p[:, order[:1]], n)[1]
    for m in range(2, len(order) + 1):
        share, value = _em(p[:, order[:m]], n)
        if value - price * (m - 1) <= best_value:
            break
        best, best_value = (share, order[:m]), value - price * (m - 1)
    share, chosen = best
    k = int(np.lexsort((chosen, -share))[0])
    return model.langs[chosen[k]], float(min(1.0, max(0.0, share[k]))), {model.langs[c]: float(s) for c, s in zip(chosen, share)}


def identify(docs: DataFrame, model: Model, text_col: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "mixture")) -> DataFrame:
    """``docs`` with the prediction, its score and the mixture (language:share of the selected set) of each whole text.

    A null text, or one without any letter, is ``und`` with score 0, as is any text if nothing was learned. Ties go to the
    language that sorts first. All rows and other columns stay; inputs named as one of ``names`` are replaced.
    """
    base = docs.drop(*names)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # 65,536 numbers a language

    @F.pandas_udf("struct<lang_pred:string,score:double,mixture:string>")
    def predict(texts):
        import pandas as pd

        got = [infer(t, shared.value) for t in texts]
        named = [",".join(f"{k}:{v:.4f}" for k, v in sorted(m.items(), key=lambda x: (-x[1], x[0]))) for _, _, m in got]
        return pd.DataFrame({"lang_pred": [g[0] for g in got], "score": [g[1] for g in got], "mixture": named})

    own = "__loomtext_language"
    got = base.withColumn(own, predict.asNondeterministic()(F.col(text_col)))
    fields = [F.col(f"`{own}`")[f].alias(n) for f, n in zip(("lang_pred", "score", "mixture"), names)]
    return got.select(*[F.col(f"`{c}`") for c in base.columns], *fields)
