"""Sequence labelling: context features, linear-chain models as tables, decoding, islands of tags."""

from __future__ import annotations

import re
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions import text as X

TEMPLATE = re.compile(r"T\[(?P<a>-?\d+)(?:,(?P<b>-?\d+))?\](?:\[(?P<col>\d+)\])?(?:\.(?P<fn>\w+))?")


def context_features(rows: DataFrame, templates: list[str], columns: list[str], sent: list[str], order: str, words: list[str] = ()) -> DataFrame:
    """Add f0, f1, ...: ``template=value`` for each token, all in one pass over one window.

    A template T[i], T[i,j], T[i][col] or T[i,j].fn takes the value i places on (joined to j), BOS before the sentence and EOS
    after it; functions: lower, isdigit, istitle, is_in_dict.
    """
    w = Window.partitionBy(*sent).orderBy(order)
    out = {}
    for k, t in enumerate(templates):
        m = TEMPLATE.fullmatch(t)
        a, b = int(m["a"]), int(m["b"] or m["a"])
        col = columns[int(m["col"] or 0)]
        at = lambda i, col=col: F.lead(col, i).over(w) if i >= 0 else F.lag(col, -i).over(w)
        v = F.concat_ws(" ", *[at(i) for i in range(a, b + 1)]) if b > a else at(a)
        fn = m["fn"]
        if fn == "lower":
            v = F.lower(v)
        elif fn == "isdigit":
            v = F.when(X.is_digit(v), "True").otherwise("False")
        elif fn == "istitle":
            v = F.when(X.is_title(v), "True").otherwise("False")
        elif fn == "is_in_dict":
            v = F.when(F.lower(v).isin(*words), "True").otherwise("False")
        edge = lambda i: F.when(at(i).isNull(), F.lit("BOS" if i < 0 else "EOS"))
        v = F.coalesce(edge(a), edge(b), v) if a or b else v
        out[f"f{k}"] = F.concat(F.lit(t + "="), v)
    return rows.withColumns(out)


def array_features(rows: DataFrame, templates: list[str], columns: list[str], words: list[str] = ()) -> DataFrame:
    """A row a token, in place of ``columns`` (arrays of one length): ``pos`` and f0, f1, ... as of ``context_features``.

    A sentence is a row, and its tokens look around in its arrays: no shuffle and no window.
    """
    fns = {
        None: lambda v: v,
        "lower": F.lower,
        "isdigit": lambda v: F.when(X.is_digit(v), "True").otherwise("False"),
        "istitle": lambda v: F.when(X.is_title(v), "True").otherwise("False"),
        "is_in_dict": lambda v: F.when(F.lower(v).isin(*words), "True").otherwise("False"),
    }
    parsed = [TEMPLATE.fullmatch(t) for t in templates]
    span = lambda m: range(int(m["a"]), int(m["b"] or m["a"]) + 1)
    near = sorted({(int(m["col"] or 0), k) for m in parsed for k in span(m)} | {(0, 0)})
    name = lambda c, k: f"_{c}_{k + 1000}"

    def shifted(c: int, k: int) -> Column:
        """The column's values ``k`` places on, side by side with the tokens."""
        col, n = F.col(columns[c]), F.size(columns[c])
        return F.slice(col, k + 1, n) if k >= 0 else F.concat(F.array_repeat(F.lit(None).cast("string"), -k), F.slice(col, F.lit(1), F.greatest(n + k, F.lit(0))))

    # Values stand side by side before tokens become rows, so that templates are plain expressions on a row.
    rest = [c for c in rows.columns if c not in columns]
    d = rows.select(*rest, F.size(columns[0]).alias("_n"), *[shifted(c, k).alias(name(c, k)) for c, k in near])
    d = d.select(*rest, "_n", F.posexplode(F.arrays_zip(*[name(c, k) for c, k in near])).alias("pos", "_x")).where(F.col("pos") < F.col("_n"))

    def one(t: str, m: re.Match) -> Column:
        at = [F.col("_x")[name(int(m["col"] or 0), k)] for k in span(m)]
        v = F.concat_ws(" ", *at) if len(at) > 1 else at[0]
        edge = F.when(F.col("pos") + span(m)[0] < 0, "BOS").when(F.col("pos") + span(m)[-1] >= F.col("_n"), "EOS")
        return F.concat(F.lit(t + "="), edge.otherwise(fns[m["fn"]](v)) if span(m) != range(0, 1) else fns[m["fn"]](v))

    return d.select(*rest, F.col("pos").cast("long").alias("pos"), *[one(t, m).alias(f"f{k}") for k, (t, m) in enumerate(zip(templates, parsed))])


class Chain:
    """A linear-chain model in memory: label names, attribute weights [attr -> vector], transition matrix."""

    def __init__(self, state: list[tuple[str, str, float]], trans: list[tuple[str, str, float]]):
        self.labels = sorted({x[1] for x in state} | {y for t in trans for y in t[:2]})
        at = {x: k for k, x in enumerate(self.labels)}
        self.state: dict[str, np.ndarray] = {}
        for a, y, w in state:
            self.state.setdefault(a, np.zeros(len(at)))[at[y]] += w
        self.trans = np.zeros((len(at), len(at)))
        for a, b, w in trans:
            self.trans[at[a], at[b]] = w

    def emissions(self, feats: list[list[str]]) -> np.ndarray:
        e = np.zeros((len(feats), len(self.labels)))
        for t, fs in enumerate(feats):
            for f in fs:
                v = self.state.get(f)
                if v is not None:
                    e[t] += v
        return e

    def decode(self, feats: list[list[str]]) -> tuple[list[str], float]:
        """Best labels and their score; ties to the label that sorts first."""
        e = self.emissions(feats)
        if not len(e):
            return [], 0.0
        s, back = e[0], []
        for row in e[1:]:
            all_ = s[:, None] + self.trans
            back.append(all_.argmax(axis=0))
            s = all_.max(axis=0) + row
        k = int(s.argmax())
        score, path = float(s[k]), [k]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return [self.labels[p] for p in reversed(path)], score

    def marginals(self, feats: list[list[str]]) -> np.ndarray:
        e = self.emissions(feats)
        lse = lambda x, axis: (m := x.max(axis=axis, keepdims=True), np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis)))[1]
        f, b = [e[0]], [np.zeros(e.shape[1])]
        for row in e[1:]:
            f.append(lse(f[-1][:, None] + self.trans, 0) + row)
        for row in e[:0:-1]:
            b.append(lse(self.trans + (row + b[-1])[None, :], 1))
        p = np.array(f) + np.array(b[::-1])
        p -= p.max(axis=1, keepdims=True)
        p = np.exp(p)
        return p / p.sum(axis=1, keepdims=True)


def load_chain(state: DataFrame, trans: DataFrame) -> Chain:
    """A model is a vocabulary times labels: it is read to the driver and shared; corpora never are."""
    return Chain([tuple(r) for r in state.select("attr", "label", "w").collect()], [tuple(r) for r in trans.select("src", "dst", "w").collect()])


def places(values: pa.Array, at: dict[str, int]) -> np.ndarray:
    """Where ``at`` has each value, -1 where it doesn't; it is asked once a distinct value."""
    d = values.dictionary_encode()
    found = np.array([*(at.get(v, -1) for v in d.dictionary.to_pylist()), -1], np.int64)
    return found[d.indices.fill_null(len(found) - 1).to_numpy(zero_copy_only=False)]


def decode(sentences: DataFrame, model: Chain, feats: str = "feats", out: str = "tags") -> DataFrame:
    """Add the best tags (array<string>) of sentences with array<array<string>> features, many sentences at once, as ``Chain.decode`` gives them."""
    k = len(model.labels)
    weights = np.array([*model.state.values(), np.zeros(k)])
    shared = sentences.sparkSession.sparkContext.broadcast(({a: i for i, a in enumerate(model.state)}, weights, model.labels, model.trans))

    @F.arrow_udf("array<string>")
    def run(v: pa.Array) -> pa.Array:
        at, weights, labels, trans = shared.value
        tokens, sizes = v.flatten(), v.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        counts = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        ids, first = places(tokens.flatten(), at), np.cumsum(counts) - counts
        e = np.zeros((len(counts), len(labels)))
        for j in range(int(counts.max(initial=0))):  # in their order, as one by one
            some = np.flatnonzero(counts > j)
            e[some] += weights[ids[first[some] + j]]  # -1: the last row, zeros
        tags = pa.array(labels, pa.string()).take(pa.array(best_paths(e, sizes, trans))) if len(e) else pa.array([], pa.string())
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), tags)

    return sentences.withColumn(out, run.asNondeterministic()(F.col(feats)))


def marginals(sentences: DataFrame, model: Chain, feats: str = "feats", out: str = "marginals") -> DataFrame:
    shared = sentences.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<array<double>>")
    def run(v):
        import pandas as pd

        return pd.Series([shared.value.marginals(x).tolist() for x in v], dtype=object)

    return sentences.withColumn(out, run.asNondeterministic()(F.col(feats)))


def labelling_score(tokens: DataFrame, state: DataFrame, trans: DataFrame, sent: list[str], order: str) -> DataFrame:
    """(sent, score) of given labels: emissions by a join on (attr, label), transitions by a lag."""
    w = Window.partitionBy(*sent).orderBy(order)
    t = tokens.withColumn("src", F.lag("label").over(w))
    e = tokens.select(*sent, "label", F.explode("attrs").alias("attr")).join(state, ["attr", "label"]).select(*sent, "w")
    x = t.select(*sent, "src", F.col("label").alias("dst")).join(trans, ["src", "dst"]).select(*sent, "w")
    scored = e.unionByName(x).groupBy(*sent).agg(F.sum("w").alias("score"))
    return tokens.select(*sent).distinct().join(scored, sent, "left").select(*sent, F.coalesce("score", F.lit(0.0)).alias("score"))


#: Sentences from which on a step goes label by label, over all of them at once.
MANY = 48


def best_paths(e: np.ndarray, sizes: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """The best labels of all tokens of sentences of ``sizes`` tokens, whose scores ``e`` [token, label] stand one after the other.

    Sentences step on together, the longest first; ties to the label that sorts first.
    """
    out = np.zeros(len(e), np.int64)
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]
    if not len(order):
        return out
    start, n = (np.cumsum(sizes) - sizes)[order], sizes[order]
    s, back, k = e[start], [], e.shape[1]
    live = np.searchsorted(-n, -np.arange(int(n[0])), side="left").tolist()  # sentences of over t tokens
    kind = np.uint8 if k <= 256 else np.int64
    for t in range(1, int(n[0])):
        m = live[t]
        if m < MANY:
            paths = s[:m, :, None] + trans
            back.append(paths.argmax(axis=1))
            s[:m] = paths.max(axis=1) + e[start[:m] + t]
            continue
        best, of, path, more = s[:m, :1] + trans[0], np.zeros((m, k), kind), np.empty((m, k)), np.empty((m, k), bool)
        for y in range(1, k):
            np.add(s[:m, y : y + 1], trans[y], out=path)
            np.greater(path, best, out=more)
            np.putmask(of, more, y)
            np.maximum(best, path, out=best)
        back.append(of)
        s[:m] = best + e[start[:m] + t]
    y = s.argmax(axis=1)
    for t in range(int(n[0]) - 1, -1, -1):
        m = live[t]
        out[start[:m] + t] = y[:m]
        if t:
            y[:m] = back[t - 1][np.arange(m), y[:m]]
    return out


# --- islands ------------------------------------------------------------------------------------------------------------


def merge_begins(tokens: DataFrame, sent: list[str], order: str, token: str, begins: Column, glue: str = " ") -> DataFrame:
    """(sent, word_no, start, n, word): runs of tokens, each opened by a begin; the first token always opens one."""
    w = Window.partitionBy(*sent).orderBy(order)
    b = F.when((F.row_number().over(w) == 1) | begins, 1).otherwise(0)
    d = tokens.withColumn("_b", b).withColumn("word_no", F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    g = d.groupBy(*sent, "word_no").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(token).alias("t")))).alias("x"))
    return g.select(*sent, F.col("word_no").cast("long").alias("word_no"), F.get("x", F.lit(0))["o"].alias("start"), F.size("x").alias("n"), F.array_join(F.transform("x", lambda v: v["t"]), glue).alias("word"))


def merged(tokens: Column, begins, glue: str = " ") -> Column:
    """Array of words of an array of tokens: runs, each opened by a token of which ``begins(token)`` holds, the first by the first token."""

    def words(ts: Column) -> Column:
        at = F.filter(F.transform(ts, lambda t, i: F.when((i == 0) | begins(t), i)), lambda i: i.isNotNull())
        return X.let(at, lambda starts: F.transform(starts, lambda p, j: F.array_join(F.slice(ts, p + 1, F.coalesce(F.get(starts, j + 1), F.size(ts)) - p), glue)))

    return X.let(tokens, words)


def merged_pieces(pieces: Column) -> Column:
    """Array of (start, word, entity, last) of an array of (start, piece, entity, end): pieces led by ## go on with the word before and move its end."""

    def words(ps: Column) -> Column:
        opens = F.filter(F.transform(ps, lambda p, i: F.when((i == 0) | ~p["piece"].startswith("##"), i)), lambda i: i.isNotNull())

        def word(i: Column, upto: Column) -> Column:
            run = F.slice(ps, i + 1, upto - i)
            text = F.array_join(F.transform(run, lambda p: F.regexp_replace(p["piece"], "^##", "")), "")
            return F.struct(F.get(ps, i)["start"].alias("start"), text.alias("word"), F.get(ps, i)["entity"].alias("entity"), F.array_max(F.transform(run, lambda p: p["end"])).alias("last"))

        return X.let(opens, lambda at: F.transform(at, lambda i, j: word(i, F.coalesce(F.get(at, j + 1), F.size(ps)))))

    return X.let(pieces, words)


def entity_spans(tags: Column) -> Column:
    """Array of (type, first, last) of an array of BIO tags, as of ``entities``."""
    kind = lambda t: F.when(t.rlike("^[BI]-"), F.substring(t, 3, 2147483647)).otherwise("")
    span = lambda m, nxt, n: F.struct(m["type"].alias("type"), m["at"].cast("long").alias("first"), (F.coalesce(nxt["at"], n) - 1).cast("long").alias("last"))

    def spans(ts: Column) -> Column:
        def mark(t: Column, i: Column) -> Column:
            new = t.startswith("B-") | (t.startswith("I-") & ((i == 0) | (kind(F.get(ts, F.greatest(i - 1, F.lit(0)))) != kind(t))))
            return F.when(new, F.struct(i.alias("at"), kind(t).alias("type"))).when(t == "O", F.struct(i.alias("at"), F.lit(None).cast("string").alias("type")))

        marks = F.filter(F.transform(ts, mark), lambda m: m.isNotNull())
        return F.filter(X.let(marks, lambda ms: F.transform(ms, lambda m, j: span(m, F.get(ms, j + 1), F.size(ts)))), lambda x: x["type"].isNotNull())

    return X.let(tags, spans)


def entities(tokens: DataFrame, sent: list[str], order: str, tag: str) -> DataFrame:
    """(sent, type, first, last) of BIO tags; an I that follows another type or nothing opens an entity."""
    w = Window.partitionBy(*sent).orderBy(order)
    kind = F.regexp_extract(tag, "^[BI]-(.*)$", 1)
    prev = F.lag(tag).over(w)
    opens = F.col(tag).startswith("B-") | (F.col(tag).startswith("I-") & (prev.isNull() | (F.regexp_extract(prev, "^[BI]-(.*)$", 1) != kind)))
    d = tokens.withColumn("_k", kind).withColumn("_o", F.when(opens, 1).otherwise(0)).withColumn("_g", F.sum("_o").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.where(F.col(tag) != "O").groupBy(*sent, "_g").agg(F.first("_k").alias("type"), F.min(order).alias("first"), F.max(order).alias("last")).drop("_g")


# --- marks restored ----------------------------------------------------------------------------------------------------


class Counts:
    """Counts by 64-bit hashes, as two sorted arrays: twelve to sixteen bytes an entry, and no key is held."""

    def __init__(self, hashes: np.ndarray, n: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.n = hashes[order], n[order]

    def get(self, h: int) -> int:
        k = int(np.searchsorted(self.hashes, np.uint64(h)))
        return int(self.n[k]) if k < len(self.hashes) and int(self.hashes[k]) == h else 0


class Restorer:
    """Restores marks with a bigram model of syllables and a unigram fallback.

    ``uni`` and ``bi`` map the hash of a word, and of a pair, to its count; ``variants`` a bare word to its spellings in order, where there are other
    spellings than itself.
    """

    WEIGHT = 0.8
    WORD, NUMBER = re.compile("[a-zA-ZÀ-ɏḀ-ỿ]+"), re.compile("[0-9]+(?:[.,:][0-9]+)*")
    EDGE = "\"'“”‘’.,!?;:()[]{}…-"
    CUT = re.compile(r"(\s+|[,;!?…]+)")
    SEED = 42

    def __init__(self, uni: Counts, bi: Counts, variants: dict[str, list[str]], total: int, size: int):
        self.uni, self.bi, self.variants, self.total, self.size = uni, bi, variants, total, size or 1
        self.plain = str.maketrans(*X._tone_pairs())

    @classmethod
    def of(cls, uni: dict[str, int], bi: dict[tuple[str, str], int]) -> Restorer:
        """A small model from dictionaries."""
        digest = lambda w, seed=cls.SEED: xxhash.xxh64_intdigest(w, seed=seed)
        counts = lambda d: Counts(np.array(list(d), np.uint64), np.array(list(d.values()), np.int64))
        variants: dict[str, list[str]] = {}
        plain = str.maketrans(*X._tone_pairs())
        for w in sorted(uni):
            variants.setdefault(w.translate(plain), []).append(w)
        return cls(counts({digest(w): n for w, n in uni.items()}), counts({digest(b, digest(a)): n for (a, b), n in bi.items()}), variants, sum(uni.values()), len(uni))

    def __getstate__(self) -> dict:
        return {k: v for k, v in vars(self).items() if k not in ("options", "step", "first")}

    @cached_property
    def options(self):
        @lru_cache(1 << 16)
        def of(low: str) -> tuple[str, ...]:
            return (low,) if low != low.translate(self.plain) else tuple(self.variants.get(low, (low,)))

        return of

    @cached_property
    def step(self):
        word = lru_cache(1 << 16)(lambda w: (h := xxhash.xxh64_intdigest(w, seed=self.SEED), self.uni.get(h)))

        @lru_cache(1 << 18)
        def of(a: str, b: str) -> float:
            h, n = word(a)
            both = self.bi.get(xxhash.xxh64_intdigest(b, seed=h))
            return float(np.log(self.WEIGHT * (both / n if both and n else 0.0) + (1 - self.WEIGHT) * (word(b)[1] + 1) / (self.total + self.size)))

        return of

    @cached_property
    def first(self):
        return lru_cache(1 << 16)(lambda w: float(np.log((self.uni.get(xxhash.xxh64_intdigest(w, seed=self.SEED)) + 1) / (self.total + self.size))))

    def best(self, layers: list[tuple[str, ...]]) -> list[str]:
        """The likeliest chain; at a tie the predecessor that sorts last, at the end the candidate that sorts first.

        Where a word and the one before have one spelling each there is nothing to weigh, and scores begin anew.
        """
        scores = {c: self.first(c) if len(layers[0]) > 1 else 0.0 for c in layers[0]}
        back: list[dict[str, str]] = [{}]
        for layer in layers[1:]:
            if len(layer) == 1 and len(scores) == 1:
                back.append({layer[0]: next(iter(scores))})
                scores = {layer[0]: 0.0}
                continue
            made, new = {}, {}
            for c in layer:
                new[c], made[c] = max((s + self.step(a, c), a) for a, s in scores.items())
            back.append(made)
            scores = new
        at = max(scores, key=scores.__getitem__)
        out = [at]
        for t in reversed(back[1:]):
            at = t[at]
            out.append(at)
        return out[::-1]

    def chains(self, parts: list[str]) -> list[list[tuple[int, str, str, str, bool]]]:
        """Runs of words and numbers; anything else, and punctuation between, breaks them."""
        out, run, closed = [], [], False
        for k, part in enumerate(parts):
            if not part or part.isspace():
                continue
            core = part.strip(self.EDGE)
            left, right = part[: len(part) - len(part.lstrip(self.EDGE))], part[len(part.rstrip(self.EDGE)) :]
            number = bool(self.NUMBER.fullmatch(core))
            if not number and not self.WORD.fullmatch(core):
                out, run, closed = ([*out, run] if run else out), [], False
                continue
            if run and (closed or left):
                out, run = [*out, run], []
            run.append((k, left, core, right, number))
            closed = bool(right)
        return [*out, run] if run else out

    def restore(self, text: str | None) -> str | None:
        if not text:
            return text
        parts = self.CUT.split(text)
        for run in self.chains(parts):
            for (k, left, core, right, number), w in zip(run, self.best([("<num>",) if n else self.options(c.lower()) for _, _, c, _, n in run])):
                if not number and w != core.lower():
                    shaped = w.upper() if core.isupper() and len(core) > 1 else w[:1].upper() + w[1:] if core[:1].isupper() else w
                    parts[k] = left + shaped + right
        return "".join(parts)


#: Words and pairs that a restorer may hold: some 500 MB a worker.
MOST_COUNTS = 30_000_000


def restorer(uni: DataFrame, bi: DataFrame) -> Restorer:
    """From counts (w, n) and (w1, w2, n), pruned before: they come to the driver as hashes and counts, up to MOST_COUNTS of them, and only
    words with other spellings as text. ValueError for more."""
    plain = X.remove_tone("w")
    u = uni.select("w", F.col("n").cast("long").alias("n"), F.xxhash64("w").alias("h"), plain.alias("plain"))
    size = uni.count()
    if size + bi.count() > MOST_COUNTS:
        raise ValueError(f"prune the counts: more than {MOST_COUNTS} words and pairs")
    hashed = lambda d: (lambda t: Counts(t.column(0).to_numpy().view(np.uint64), t.column(1).to_numpy()))(d.toArrow())
    pairs = bi.select(F.xxhash64("w1", "w2").alias("h"), F.col("n").cast("long").alias("n"))
    other = u.groupBy("plain").agg(F.array_sort(F.collect_list("w")).alias("ws")).where((F.size("ws") > 1) | (F.get("ws", F.lit(0)) != F.col("plain")))
    variants = {r.plain: r.ws for r in other.toLocalIterator()}
    counts = hashed(u.select("h", "n"))
    return Restorer(counts, hashed(pairs), variants, int(counts.n.sum()), size)


def restore_marks(df: DataFrame, model: Restorer, text: str, out: str) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(model)  # MOST_COUNTS at most

    @F.arrow_udf("string")
    def run(v: pa.Array) -> pa.Array:
        return pa.array([shared.value.restore(x) for x in v.to_pylist()], pa.string())

    return df.withColumn(out, run.asNondeterministic()(F.col(text)))
