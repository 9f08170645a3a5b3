"""Word statistics: frequencies, vocabularies, stop words, language-model counts, TF-IDF.

A token table has columns (doc_id, word); all statistics come from (doc_id, word, tf) counted once with map-side combine.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from math import ceil
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions import text as X
from loomtext.operators.summing import summed
from loomtext.operators.written import written


#: Kept unigrams are broadcast up to so many (some 30 MB).
BROADCAST_WORDS = 1_000_000


def tokens(docs: DataFrame, text: str = "text", *keep: str) -> DataFrame:
    """(doc_id, *keep, word): lower-case runs of letters, digits and underscores."""
    return docs.select("doc_id", *keep, F.explode(X.lower_tokens(text)).alias("word"))


#: Words that are counted at once, but for a single longer text: bounds the memory of a task.
COUNTED = 1 << 18


def _counts(v: pa.Array, low: int, high: int, only: pa.Array | None = None) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(row, word, tf) of lists of words, or of their runs of ``low`` to ``high`` words joined by blanks, by row.

    Counted by whole numbers: each distinct word is met once as text, a run only where it is new to the lists.
    """
    flat = v.flatten().dictionary_encode()
    n = v.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(v)), n)
    word = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    code, names, made = word, flat.dictionary, []
    for k in range(1, high + 1):
        if k > 1:
            inside = row[:-1] == row[1:]
            pair, row = (word[:-1] * len(flat.dictionary) + word[1:])[inside], row[1:][inside]
            seen, code = np.unique(pair, return_inverse=True)
            names = pc.binary_join_element_wise(names.take(pa.array(seen // len(flat.dictionary))), flat.dictionary.take(pa.array(seen % len(flat.dictionary))), " ")
        if k >= low:
            keep = slice(None) if only is None else pc.is_in(names, value_set=only).to_numpy(zero_copy_only=False)[code]
            key, tf = np.unique((row * max(1, len(names)) + code)[keep], return_counts=True)
            made.append((key // max(1, len(names)), names.take(pa.array(key % max(1, len(names)))), tf))
    rows = np.concatenate([r for r, _, _ in made])
    order = np.argsort(rows, kind="stable")
    return rows[order], pa.concat_arrays([w for _, w, _ in made]).take(pa.array(order)), np.concatenate([t for _, _, t in made])[order]


def _counted(lists: pa.Array, most: int, counts: Callable[[pa.Array], tuple]) -> Iterator[tuple]:
    """(first row, *what ``counts`` makes) of runs of rows of ``most`` words each, but for a longer row."""
    ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(lists):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield at, *counts(lists.slice(at, to - at))
        at = to


def document_counts(docs: DataFrame, words: Column, *keep: str, name: str = "word", low: int = 1, high: int = 1, only: list[str] | None = None) -> DataFrame:
    """(doc_id, *keep, word, tf), a row a document and word (or run of ``low`` to ``high`` words); made where the documents are.

    Counts leave in batches of about COUNTED words, however many documents Spark hands over at once. ``only``: a vocabulary
    outside of which nothing is wanted.
    """
    if not 1 <= low <= high <= 2:
        raise ValueError("runs of one or two words")
    d = docs.select("doc_id", *keep, words.alias("_words"))
    names = ["doc_id", *keep, name, "tf"]
    wanted = None if only is None else docs.sparkSession.sparkContext.broadcast(only)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = wanted and pa.array(wanted.value, pa.string())
        for b in batches:
            for at, row, word, tf in _counted(b.column(b.num_columns - 1), COUNTED, lambda v: _counts(v, low, high, known)):
                row = pa.array(row + at)
                yield pa.RecordBatch.from_arrays([*[b.column(k).take(row) for k in range(b.num_columns - 1)], word, pa.array(tf, pa.int64())], names=names)

    kept = [f"`{c}` {d.schema[c].dataType.simpleString()}" for c in ("doc_id", *keep)]
    return d.mapInArrow(run, ", ".join([*kept, f"`{name}` string", "tf bigint"]))


def frequencies(t: DataFrame) -> DataFrame:
    return t.groupBy("word").agg(F.count("*").alias("n"))


def doc_frequencies(t: DataFrame) -> DataFrame:
    return t.groupBy("doc_id", "word").agg(F.count("*").alias("tf"))


def idf_log10(doc_words: DataFrame, n_docs: int) -> DataFrame:
    return doc_words.groupBy("word").agg(F.count("*").alias("df")).withColumn("idf", F.log10(F.lit(float(n_docs)) / F.col("df")))


def kl_stopwords(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, f, l_x, score): P_x log2(P_x / P_c), P_x the word's share in the documents that hold it, P_c in all.

    A document's counts and length are made in its row; only sums by word are shuffled.
    """
    w = X.lower_tokens(text)
    d = document_counts(docs.select("doc_id", text).withColumn("_len", F.size(w).cast("long")), w, "_len")
    per = d.groupBy("word").agg(F.sum("tf").alias("f"), F.sum("_len").alias("l_x"))
    per = written(per)
    total = per.agg(F.sum("f").alias("total"))  # one row
    px, pc = F.col("f") / F.col("l_x"), F.col("f") / F.col("total")
    return per.join(F.broadcast(total)).select("word", "f", "l_x", (px * F.log2(px / pc)).alias("score"))


def vocabulary(freq: DataFrame, min_freq: int, specials: tuple[str, ...] = ("<pad>", "<unk>")) -> DataFrame:
    """(id, word, n): specials first, then words of at least ``min_freq`` in alphabetical order.

    Ids follow a range sort: ranks inside a range plus the sizes of the ranges before it.
    """
    k = dense_ids(freq.where(F.col("n") >= min_freq), ["word"])
    spark = freq.sparkSession
    first = spark.createDataFrame([(i, s, None) for i, s in enumerate(specials)], "id long, word string, n long")
    return first.unionByName(k.select((F.col("rank") + len(specials)).alias("id"), "word", F.col("n").cast("long").alias("n")))


#: Rows whose keys are looked at to cut a table into ranges, and how many ranges.
RANGE_SAMPLE, RANGES = 4096, 256


def in_ranges(df: DataFrame, order: list[str]) -> DataFrame:
    """``df``, written, with ``_p``: the range of its key that a row lies in.

    Ranges are cut at keys of a bounded sample (picked by hash), so a row's range follows from the row alone and is the same
    wherever the plan reads it.
    """
    df = written(df)
    seen = sorted((tuple(r) for r in df.select(*order).dropna().orderBy(F.xxhash64(*order)).limit(RANGE_SAMPLE).collect()))
    cuts = sorted({seen[i * len(seen) // RANGES] for i in range(1, RANGES)}) if len(seen) == RANGE_SAMPLE else []
    kinds = [df.schema[c].dataType for c in order]
    key = F.struct(*order)
    marks = [F.struct(*[F.lit(v).cast(k).alias(c) for v, k, c in zip(cut, kinds, order)]) for cut in cuts]
    return df.withColumn("_p", F.size(F.filter(F.array(*marks), lambda m: m <= key)) if marks else F.lit(0))


def dense_ids(df: DataFrame, order: list[str]) -> DataFrame:
    """Add ``rank`` from 0 in the order of unique columns, by ranges: no task sees more than its range.

    Ranks are ranks inside a range plus the sizes of the ranges before it.
    """
    d = in_ranges(df, order)
    inside = Window.partitionBy("_p").orderBy(*order)
    sizes = d.groupBy("_p").agg(F.count("*").alias("_n"))
    sizes = sizes.select(F.col("_p").alias("_q"), F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))  # one row a range
    d = d.withColumn("_r", F.row_number().over(inside) - 1)
    return d.join(F.broadcast(sizes), F.col("_p") == F.col("_q")).withColumn("rank", (F.col("_r") + F.col("_b")).cast("long")).drop("_p", "_q", "_r", "_b")


def sums_before(df: DataFrame, group: str, order: list[str], value: Column, out: str = "before") -> DataFrame:
    """Add ``out``: the sum of ``value`` (whole numbers) over the rows of the same group that come first in ``order``.

    A group of any size is summed in ranges: within a range by a window, over the ranges before it by their sums, a row a range and group.
    """
    d = in_ranges(df.withColumn("_v", value.cast("long")), [group, *order])
    sums = d.groupBy("_p", group).agg(F.sum("_v").alias("_n"))
    upto = Window.partitionBy(group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("_p").alias("_q"), F.col(group).alias("_g"), F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_b"))
    inside = Window.partitionBy("_p", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_w", F.coalesce(F.sum("_v").over(inside), F.lit(0)))
    d = d.join(sums, (F.col("_p") == F.col("_q")) & F.col(group).eqNullSafe(F.col("_g")))
    return d.withColumn(out, F.col("_w") + F.col("_b")).drop("_p", "_q", "_g", "_v", "_w", "_b")


def first_share(df: DataFrame, group: str, order: str, share: float) -> DataFrame:
    """The first ``share`` of each group's rows, in the order of a unique column."""
    n = df.groupBy(F.col(group).alias("_of")).agg(F.count("*").alias("_n"))
    d = sums_before(df, group, [order], F.lit(1), "_before").join(n, F.col(group).eqNullSafe(F.col("_of")))
    return d.where(F.col("_before") < F.floor(F.col("_n") * share)).drop("_of", "_n", "_before")


LM_WORD = "[a-zA-ZÀ-ɏḀ-ỿ]+|[0-9]+"


def lm_tokens(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, pos, token, gap): alphabetic runs and <num> for digit runs, with what stands before each."""
    word = LM_WORD
    pairs = F.arrays_zip(F.regexp_extract_all(F.col(text), F.lit(word), F.lit(0)).alias("w"), F.split(text, word, -1).alias("g"))
    d = docs.select("doc_id", F.posexplode(pairs).alias("pos", "x")).select("doc_id", "pos", F.lower("x.w").alias("w"), F.col("x.g").alias("gap"))
    return d.where("w IS NOT NULL").select("doc_id", "pos", F.when(F.col("w").rlike("^[0-9]+$"), F.lit("<num>")).otherwise(F.col("w")).alias("token"), "gap")


def valid_syllable(c) -> object:
    x = F.col(c) if isinstance(c, str) else c
    return (x == "<num>") | ((F.length(x) <= 7) & ~x.rlike("[fjwz]"))


def lm_counts(docs: DataFrame, text: str = "text", min_uni: int = 5, min_bi: int = 5) -> tuple[DataFrame, DataFrame]:
    """Unigrams (w, n) and bigrams (w1, w2, n) of valid syllables; bigrams only across white space, of kept unigrams."""
    t = lm_tokens(docs, text)
    uni = written(t.where(valid_syllable("token")).groupBy(F.col("token").alias("w")).agg(F.count("*").alias("n")).where(F.col("n") >= min_uni))
    return uni, lm_bigrams(docs, uni, text, min_bi)


def lm_bigrams(docs: DataFrame, uni: DataFrame, text: str, min_bi: int) -> DataFrame:
    """Pairs are made of a text's tokens where they stand, so that only counts are shuffled."""
    word = F.regexp_extract_all(F.col(text), F.lit(LM_WORD), F.lit(0))
    gap = F.split(text, LM_WORD, -1)
    named = lambda x: F.when(x.rlike("^[0-9]+$"), F.lit("<num>")).otherwise(F.lower(x))
    both = F.struct(F.transform(word, named).alias("w"), gap.alias("g"))
    pairs = X.let(both, lambda s: F.transform(s["w"], lambda w, i: F.struct(w.alias("w1"), F.get(s["w"], i + 1).alias("w2"), F.get(s["g"], i + 1).alias("g"))))
    p = docs.select(F.explode(pairs).alias("x")).select("x.*").where(F.col("g").rlike(r"^\s+$") & valid_syllable("w1") & valid_syllable("w2"))
    bi = p.groupBy("w1", "w2").agg(F.count("*").alias("n")).where(F.col("n") >= min_bi)
    uni = F.broadcast(uni.select("w")) if uni.count() <= BROADCAST_WORDS else uni
    return bi.join(uni.select(F.col("w").alias("w1")), "w1", "left_semi").join(uni.select(F.col("w").alias("w2")), "w2", "left_semi").select("w1", "w2", "n")


def tfidf_vocabulary(doc_terms: DataFrame, n_docs: int, min_df: int = 1, max_df: float = 1.0, max_features: int | None = None) -> DataFrame:
    """(term, df, cf, idf, feature_id): df from ``min_df`` to the ceiling of ``max_df`` times the documents; of those the
    ``max_features`` most frequent, ties alphabetical; ids alphabetical; idf = ln((N + 1) / (df + 1)) + 1."""
    return _numbered(_kept(doc_terms.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")), n_docs, min_df, max_df, max_features), n_docs)


def _kept(v: DataFrame, n_docs: int, min_df: int, max_df: float, max_features: int | None) -> DataFrame:
    v = v.where((F.col("df") >= min_df) & (F.col("df") <= ceil(max_df * n_docs)))
    return v.orderBy(F.desc("cf"), "term").limit(max_features) if max_features else v


def _numbered(v: DataFrame, n_docs: int) -> DataFrame:
    v = v.withColumn("idf", F.ln(F.lit(n_docs + 1.0) / (F.col("df") + 1)) + 1)
    return dense_ids(v, ["term"]).withColumnRenamed("rank", "feature_id")


#: Sums that terms share by hash: 4 MB a task and on the driver.
BOUNDS = 1 << 19


def _runs(v: pa.Array, high: int, sums: int) -> tuple[pa.Array, list[tuple[np.ndarray, list[np.ndarray], np.ndarray]]]:
    """Distinct words of lists of words; of runs of 1 and up to ``high`` words each the rows, the words' places among them and which of ``sums`` counts them."""
    flat = v.flatten().dictionary_encode()
    row = np.repeat(np.arange(len(v)), v.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    word = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    runs = [(row, [word])]
    if high == 2:
        inside = row[:-1] == row[1:]
        runs.append((row[1:][inside], [word[:-1][inside], word[1:][inside]]))
    h = np.fromiter(map(crc32, flat.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)), np.uint64, len(flat.dictionary))
    both = lambda w: h[w[0]] if len(w) == 1 else h[w[0]] << np.uint64(32) | h[w[1]]
    return flat.dictionary, [(r, w, (both(w) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64) % sums) for r, w in runs]


def _term_sums(v: pa.Array, high: int, wanted: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(term, df, cf) of lists of words, of the terms whose sum is ``wanted``."""
    words, runs = _runs(v, high, len(wanted))
    terms, df, cf = [], [], []
    for row, w, at in runs:
        keep = wanted[at]
        key, code = np.unique((w[0] * len(words) + w[1] if len(w) == 2 else w[0])[keep], return_inverse=True)
        found = np.unique(code * len(v) + row[keep]) // len(v)
        terms.append(pc.binary_join_element_wise(*[words.take(pa.array(k)) for k in (divmod(key, len(words)) if len(w) == 2 else [key])], " "))
        df.append(np.bincount(found, minlength=len(key)))
        cf.append(np.bincount(code, minlength=len(key)))
    return pa.concat_arrays(terms), np.concatenate(df), np.concatenate(cf)


def document_vocabulary(docs: DataFrame, words: Column, n_docs: int, min_df: int = 1, max_df: float = 1.0, max_features: int | None = None, high: int = 1) -> DataFrame:
    """``tfidf_vocabulary`` of the documents' words and runs of up to ``high`` words. A row is a document.

    The ``max_features`` most frequent terms are found without a shuffle of all terms: BOUNDS sums, each of the counts of all terms of
    a hash, bound these from above; only terms whose bound reaches a floor are counted by name. Where those kept aren't all above
    that floor, they are counted again from the least count kept, or all are where too few were kept; so the result is exact.
    """
    if not 1 <= high <= 2:
        raise ValueError("runs of one or two words")
    if not max_features:
        return tfidf_vocabulary(document_counts(docs, words, name="term", high=high), n_docs, min_df, max_df)
    d, n = docs.select(words.alias("_words")), BOUNDS

    def part(batches: Iterable[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros(n)
        for b in batches:
            for _, at in _counted(b.column(0), COUNTED, lambda v: (np.concatenate([x for _, _, x in _runs(v, high, n)[1]]),)):
                out += np.bincount(at, minlength=n)
        return out

    bounds = summed(d, part, n)
    floor = max(1, int(np.partition(bounds, -max_features)[-max_features]) // 2) if max_features <= n else 1
    while True:
        wanted = d.sparkSession.sparkContext.broadcast(bounds >= floor)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for _, term, df, cf in _counted(b.column(0), COUNTED, lambda v: _term_sums(v, high, wanted.value)):
                    yield pa.RecordBatch.from_arrays([term, pa.array(df, pa.int64()), pa.array(cf, pa.int64())], names=["term", "df", "cf"])

        sums = d.mapInArrow(run, "term string, df bigint, cf bigint").groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
        v = written(_kept(sums, n_docs, min_df, max_df, max_features))
        kept, least = v.agg(F.count("*"), F.min("cf")).first()
        if floor == 1 or (kept == max_features and least >= floor):
            return _numbered(v, n_docs)
        floor = least if kept == max_features else 1


def tfidf_vectors(doc_terms: DataFrame, vocab: DataFrame, sublinear: bool = False) -> DataFrame:
    """(doc_id, feature_id, value), each document of length 1; unknown terms are left out."""
    tf = 1 + F.ln("tf") if sublinear else F.col("tf")
    v = vocab.select("term", "feature_id", "idf")
    x = doc_terms.join(F.broadcast(v) if v.count() <= BROADCAST_WORDS else v, "term").withColumn("raw", tf * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("doc_id")))
    return x.select("doc_id", "feature_id", (F.col("raw") / norm).alias("value"))


def document_vectors(docs: DataFrame, words: Column, vocab: DataFrame, high: int = 1) -> DataFrame:
    """``tfidf_vectors`` of the documents' words and runs of up to ``high`` words, made in their rows: nothing is joined or shuffled.

    A row is a document. ``vocab`` is shared with the tasks.
    """
    v = vocab.select("term", "feature_id", "idf").toArrow()
    shared = docs.sparkSession.sparkContext.broadcast((v.column("term").to_pylist(), v.column("feature_id").to_numpy(), v.column("idf").to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, ids, idf = shared.value
        known = pa.array(names, pa.string())
        for b in batches:
            for at, row, word, tf in _counted(b.column(1), COUNTED, lambda v: _counts(v, 1, high, known)):
                k = pc.index_in(word, value_set=known).to_numpy(zero_copy_only=False).astype(np.int64)
                raw = tf * idf[k]
                value = raw / np.sqrt(np.bincount(row, weights=raw * raw))[row]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row + at)), pa.array(ids[k], pa.int64()), pa.array(value)], names=["doc_id", "feature_id", "value"])

    d = docs.select("doc_id", words.alias("_words"))
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, feature_id bigint, value double")


def expand_rules(rules: DataFrame) -> DataFrame:
    """(key, value) of rules (seq, key, value): each also capitalized (the rest in small letters) and in capitals.

    Of rules for one key the last holds, at the place of the first; forms that were made go before rules as given, later
    ones before earlier ones.
    """
    d = rules.groupBy("key").agg(F.max_by("value", "seq").alias("value"), F.min("seq").alias("seq"))
    cap = lambda c: F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 2147483647)))
    form = lambda made, o, f: F.struct(F.lit(made).alias("made"), F.col("seq"), F.lit(o).alias("o"), f("key").alias("key"), f("value").alias("value"))
    e = d.select(F.explode(F.array(form(0, 0, F.col), form(1, 1, cap), form(1, 2, F.upper))).alias("x")).select("x.*")
    return e.groupBy("key").agg(F.max_by("value", F.struct("made", "seq", "o")).alias("value"))


def reversed_index(df: DataFrame, key: str, values: str, order: str) -> DataFrame:
    """(value, key): the key under which a value stands; of several the last one in ``order``."""
    return df.select(F.explode(values).alias("value"), F.col(key).alias("_k"), F.col(order).alias("_o")).groupBy("value").agg(F.max_by("_k", F.struct("_o", "_k")).alias(key))


def tag_problems(senses: DataFrame, tags: DataFrame, least: int) -> DataFrame:
    """(word, tag, problem) of a dictionary (word, tag): tags that aren't among ``tags``, and a row when it has too few words."""
    bad = senses.join(F.broadcast(tags.select("tag")), "tag", "left_anti").select("word", "tag", F.lit("tag").alias("problem"))  # tags: a tag set of tens
    few = senses.agg(F.count_distinct("word").alias("n")).where(F.col("n") < least)
    none = F.lit(None).cast("string")
    return bad.unionByName(few.select(none.alias("word"), none.alias("tag"), F.lit("words").alias("problem")))


def sense_votes(candidates: DataFrame, others: DataFrame) -> DataFrame:
    """(token, pos, votes, agreed) of candidates (token, pos): the senses of other dictionaries (token, tag) of that token, and whether one is of that class."""
    s = others.groupBy("token").agg(F.collect_list("tag").alias("tags"))
    j = candidates.join(s, "token", "left")
    return j.select("token", "pos", F.coalesce(F.when(F.col("tags").isNotNull(), F.size("tags")), F.lit(0)).alias("votes"), F.coalesce(F.array_contains("tags", F.col("pos")), F.lit(False)).alias("agreed"))


def grown(have: DataFrame, verified: DataFrame) -> DataFrame:
    """``have`` with the verified (token, pos) that it lacks."""
    return have.unionByName(verified.join(have, ["token", "pos"], "left_anti"))
