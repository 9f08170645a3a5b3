"""Corpus formats: plain text, labelled lines, CoNLL columns, universal-dependency blocks, underscores, verticals, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomtext.operators.lexicon import dense_ids, sums_before
from loomtext.operators.trees import is_projective

# --- files --------------------------------------------------------------------------------------------------------------


def read_text_folder(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(doc_id, line_no, line): one document a file, named by its file; empty lines stay."""
    d = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(path, wholetext=True)
    d = d.select(F.regexp_extract(F.input_file_name(), "([^/]+?)(?:\\.[^./]*)?$", 1).alias("doc_id"), "value")
    return d.select("doc_id", F.posexplode(F.split("value", "\n")).alias("line_no", "line"))


def write_text_folder(df: DataFrame, path: str, id_col: str = "doc_id", lines: str = "lines") -> None:
    """A folder a document, in it its lines."""
    df.select(id_col, F.concat_ws("\n", lines).alias("value")).write.partitionBy(id_col).mode("overwrite").text(path)


def read_blocks(spark: SparkSession, path: str, over: int = 0) -> DataFrame:
    """(path, body): blank-line separated blocks of more than ``over`` characters, of one file or many; a file is split by Spark at block ends, not read whole."""
    d = spark.read.option("lineSep", "\n\n").text(path)
    return d.where(F.trim("value") != "").select(F.input_file_name().alias("path"), F.regexp_replace("value", "^\n+|\n+$", "").alias("body")).where(F.length("body") > over)


def read_words(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("word")).where("word <> ''")


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("text string, source string").json(path)


def read_wiki(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of a markdown tree."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(path)
    return d.select("path", F.decode("content", "UTF-8").alias("content"), F.col("modificationTime").alias("modified"))


def folder_tree(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, modified) of all files under a folder, by relative path; contents are not read."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = path.split("://")[-1].removeprefix("file:").rstrip("/") + "/"
    return d.select(F.element_at(F.split("path", root, 2), -1).alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def list_directory(tree: DataFrame, directory: str = "", suffixes: tuple[str, ...] = ("md", "txt", "html", "json", "csv")) -> DataFrame:
    """(name, is_dir, size, modified) of one folder of a tree: folders (with a closing /) and files of these suffixes, by name.

    Hidden entries are left out.
    """
    base = directory.strip("/") + "/" if directory.strip("/") else ""
    rest = F.substring(F.col("path"), len(base) + 1, 2147483647)
    d = tree.where(F.col("path").startswith(base)).withColumn("_r", rest).withColumn("is_dir", F.contains(F.col("_r"), F.lit("/")))
    d = d.withColumn("name", F.when(F.col("is_dir"), F.concat(F.substring_index("_r", "/", 1), F.lit("/"))).otherwise(F.col("_r"))).where(~F.col("name").startswith("."))
    d = d.where(F.col("is_dir") | F.substring_index("name", ".", -1).isin(*suffixes) & F.contains(F.col("name"), F.lit(".")))
    own = lambda c: F.when(~F.col("is_dir"), F.max(c))
    return d.groupBy("name", "is_dir").agg(own("size").alias("size"), own("modified").alias("modified")).orderBy("name")


def missing_paths(sample: DataFrame, current: DataFrame) -> DataFrame:
    """(path) of the sample tree's files that the current tree lacks."""
    return sample.join(current, "path", "left_anti").select("path").orderBy("path")


def article_blocks(pages: DataFrame) -> DataFrame:
    """(id, value): a <doc> block of each (id, title, url, text)."""
    head = F.format_string('<doc id="%s" url="%s" title="%s">\n', F.col("id").cast("string"), F.coalesce("url", F.lit("")), F.coalesce("title", F.lit("")))
    return pages.select("id", F.concat(head, F.coalesce("title", F.lit("")), F.lit("\n\n"), F.coalesce("text", F.lit("")), F.lit("\n</doc>\n")).alias("value"))


def write_articles(pages: DataFrame, path: str, most: int = 10_000, compression: str = "none") -> None:
    """<doc> blocks, at most ``most`` articles a file."""
    article_blocks(pages).select("value").write.option("maxRecordsPerFile", most).option("compression", compression).text(path)


def file_numbers(rows: DataFrame, order: str, size: Column, most: int) -> DataFrame:
    """Add ``file`` from 0, rising with ``order`` (unique): rows of one file have ``most`` bytes together at the most.

    Rows over half of ``most`` have files of their own (over ``most`` too: a row isn't cut). The others are cut where the bytes before them pass a
    multiple of half of ``most``; so a file starts within one half and ends within the next. Sums run in ranges: no task sees all rows.
    """
    half = most // 2
    d = rows.withColumn("_all", F.lit(0)).withColumn("_size", size.cast("long")).withColumn("_big", (F.col("_size") > half).cast("int"))
    d = sums_before(d, "_all", [order], F.when(F.col("_big") == 0, F.col("_size")).otherwise(0), "_small")
    d = sums_before(d, "_all", [order], F.col("_big"), "_bigs")
    d = d.withColumn("_cell", F.when(F.col("_big") == 1, F.lit(0).cast("long")).otherwise(F.floor(F.col("_small") / max(1, half))))
    files = dense_ids(d.select("_bigs", "_big", "_cell").distinct(), ["_bigs", "_big", "_cell"]).withColumnRenamed("rank", "file")
    return d.join(files, ["_bigs", "_big", "_cell"]).drop("_all", "_size", "_big", "_small", "_bigs", "_cell")


def write_articles_by_bytes(pages: DataFrame, path: str, most: int = 1 << 20, compression: str = "none") -> None:
    """<doc> blocks in the order of ids, in folders file=0, file=1, ... of one file each with ``most`` bytes at the most (but for longer blocks)."""
    d = file_numbers(article_blocks(pages), "id", F.octet_length("value"), most)
    # Each block ends its own line; the writer ends it again.
    d = d.select("file", "id", F.regexp_replace("value", "\n$", "").alias("value"))
    d.repartition("file").sortWithinPartitions("file", "id").drop("id").write.partitionBy("file").option("compression", compression).text(path)


def read_traces(spark: SparkSession, path: str, most: int = 50) -> DataFrame:
    """The newest traces of a folder of JSON files."""
    d = spark.read.option("multiLine", "true").json(path).withColumn("modified", F.col("_metadata.file_modification_time"))
    return d.orderBy(F.desc("modified")).limit(most)


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """(token, vector) of a text file: a token and its numbers, by blanks."""
    p = F.split("value", " ")
    return spark.read.text(path).select(F.get(p, F.lit(0)).alias("token"), F.transform(F.filter(p, lambda x, i: i > 0), lambda x: x.cast("float")).alias("vector"))


def read_wikipedia(spark: SparkSession, path: str) -> DataFrame:
    """Pages of the main namespace that are no redirects."""
    d = spark.read.format("xml").option("rowTag", "page").load(path)
    if "redirect" in d.columns:
        d = d.where("redirect IS NULL")
    return d.where("ns = 0").select("id", "title", F.col("revision.text").alias("text"))


# --- labelled lines -------------------------------------------------------------------------------------------------------


def parse_labelled(c: str) -> list[Column]:
    """labels and text of ``__label__a __label__b text``; what stood before and after a label stays."""
    return [F.regexp_extract_all(F.col(c), F.lit(r"__label__([\w#]+)"), F.lit(1)).alias("labels"), F.regexp_replace(c, r"__label__[\w#]+", "").alias("text")]


def format_labelled(labels: Column, text: Column) -> Column:
    return F.concat_ws(" ", F.transform(labels, lambda x: F.concat(F.lit("__label__"), x)), text)


# --- columns --------------------------------------------------------------------------------------------------------------


def token_rows(blocks: DataFrame, key: str = "block", body: str = "body", strict: bool = False) -> DataFrame:
    """(block, pos, cells): TAB-separated rows without # lines; strict: cells trimmed, blocks with an empty token dropped."""
    rows = F.filter(F.split(body, "\n"), lambda x: ~x.startswith("#") & (x != ""))
    cells = F.transform(rows, lambda r: F.transform(F.split(r, "\t"), lambda c: F.trim(c) if strict else c))
    d = blocks.select(key, cells.alias("rows"))
    if strict:
        d = d.where(F.forall("rows", lambda r: F.get(r, F.lit(0)) != ""))
    return d.select(key, F.posexplode("rows").alias("pos", "cells"))


CONLL = ("id", "form", "lemma", "cpos", "pos", "feats", "head", "deprel", "phead", "pdeprel")


def conll_tokens(blocks: DataFrame, key: str = "block", body: str = "body", projective: bool = False, shorter_than: int | None = None) -> DataFrame:
    """The ten columns of token rows whose id is a number; comments and ranges stay out (see conll_notes).

    ``projective`` leaves out sentences with crossing arcs, ``shorter_than`` those of that many tokens or more.
    """
    if projective or shorter_than is not None:
        rows = F.filter(F.split(body, "\n"), lambda x: x.rlike("^[0-9]+\t"))
        heads = F.transform(rows, lambda r: F.coalesce(F.get(F.split(r, "\t"), F.lit(6)).try_cast("int"), F.lit(-1)))
        if shorter_than is not None:
            blocks = blocks.where(F.size(rows) < shorter_than)
        if projective:
            blocks = blocks.where(is_projective(heads))
    t = token_rows(blocks, key, body).where(F.get("cells", F.lit(0)).rlike("^[0-9]+$"))
    return t.select(key, *[F.get("cells", F.lit(k)).alias(n) for k, n in enumerate(CONLL)]).withColumn("id", F.col("id").cast("int"))


def conll_notes(blocks: DataFrame, key: str = "block", body: str = "body") -> DataFrame:
    """(block, line_no, note): comments and rows with other ids, with their place."""
    d = blocks.select(key, F.posexplode(F.split(body, "\n")).alias("line_no", "note"))
    return d.where(F.col("note").startswith("#") | ~F.col("note").rlike("^[0-9]+\t"))


def to_conll(tokens: DataFrame, key: str, order: str, form: str, tag: str | None = None) -> DataFrame:
    """(key, body): ten columns a token, _ where nothing is known."""
    none = F.lit("_")
    n = F.row_number().over(Window.partitionBy(key).orderBy(order)).cast("string")
    row = F.concat_ws("\t", n, F.col(form), none, F.col(tag) if tag else none, *[none] * 6)
    d = tokens.select(key, F.col(order).alias("_o"), row.alias("_r"))
    return d.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_r"))), lambda x: x["_r"]), "\n").alias("body"))


def ud_headers(blocks: DataFrame, key: str = "block", body: str = "body") -> DataFrame:
    """(block, name, value) of ``# name = value`` lines."""
    h = F.filter(F.split(body, "\n"), lambda x: x.rlike("^# [^=]+ = "))
    return blocks.select(key, F.explode(h).alias("h")).select(key, F.regexp_extract("h", "^# ([^=]+?) = ", 1).alias("name"), F.regexp_extract("h", "^# [^=]+? = (.*)$", 1).alias("value"))


def ud_body(headers: Column, rows: Column) -> Column:
    """A block of ``# name = value`` lines from array<struct<name, value>> in order, and TAB-separated rows from array<array<string>>."""
    head = F.transform(headers, lambda h: F.concat(F.lit("# "), h["name"], F.lit(" = "), h["value"]))
    return F.array_join(F.concat(head, F.transform(rows, lambda r: F.array_join(r, "\t"))), "\n")


def write_blocks(df: DataFrame, path: str, body: str = "body") -> None:
    """Blocks parted by blank lines, as many files as partitions."""
    df.select(F.col(body).alias("value")).write.option("lineSep", "\n\n").text(path)


def raw_ud_headers(raw: str) -> Column:
    """array<struct<name, value>> of a raw block: its first three header lines, its last line as text, and the type bronze."""
    lines = F.split(raw, "\n")
    given = F.transform(F.filter(F.slice(lines, 1, 3), lambda x: x.rlike("^# [^=]+? = ")), lambda x: F.struct(F.regexp_extract(x, "^# ([^=]+?) = ", 1).alias("name"), F.regexp_extract(x, "^# [^=]+? = (.*)$", 1).alias("value")))
    return F.concat(given, F.array(*[F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in (("text", F.element_at(lines, -1)), ("type", F.lit("bronze")))]))


def labelled_paragraphs(d: DataFrame, text: str, label: str, *keep: str) -> DataFrame:
    """(*keep, line): ``__label__X text`` of the blank-line separated texts of a file of one class."""
    parts = F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), "\n\n")
    return d.select(*keep, F.explode(F.transform(parts, lambda p: F.concat(F.lit("__label__"), F.col(label), F.lit(" "), p))).alias("line"))


def alternating(d: DataFrame, line_no: str, line: str, *keys: str) -> DataFrame:
    """(*keys, line_no, text, label) of files of texts (even lines from 0), each followed by its label; a last text without one stays out."""
    pair, last = F.floor(F.col(line_no) / 2), F.col(line_no) % 2 == 1
    of = lambda c: F.max(F.when(c, F.trim(line)))
    g = d.groupBy(*keys, pair.alias("_p")).agg(of(~last).alias("text"), of(last).alias("label"), F.bool_or(last).alias("_both"))
    return g.where("_both").select(*keys, (F.col("_p") * 2).alias("line_no"), "text", "label")


def zipped(a: Column, b: Column) -> Column:
    """array<struct<a, b>> by position, as long as the shorter one."""
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: F.struct(x.alias("a"), y.alias("b")))


def sung_lines(text: str) -> Column:
    """Lines without music signs, trimmed; those with nothing else stay out."""
    return F.filter(F.transform(F.split(F.regexp_replace(text, "♪", ""), "\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")


def stacked(*parts: DataFrame) -> DataFrame:
    """Splits one after another by column name; a column that a split lacks is null there."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def catalogue(entries: DataFrame, everything: bool = False) -> DataFrame:
    """(name, type, license, year, directory), newest first, then by type, name and directory downwards; closed ones are starred, or left out."""
    d = entries if everything else entries.where("NOT license <=> 'Close'")
    d = d.select("name", "type", F.when(F.col("license") == "Close", "Close*").otherwise(F.col("license")).alias("license"), "year", "directory")
    return d.orderBy(F.desc("year"), F.desc("type"), F.desc("name"), F.desc("directory"))


def read_catalogue(spark: SparkSession, path: str, everything: bool = True) -> DataFrame:
    """A YAML mapping of names to type, license, year and cache_dir: a configuration file, read on the driver."""
    import yaml

    with open(path, encoding="utf-8") as f:
        known = yaml.safe_load(f) or {}
    rows = [(n, *[None if e.get(k) is None else str(e[k]) for k in ("type", "license", "year", "cache_dir")]) for n, e in known.items()]
    return catalogue(spark.createDataFrame(rows, "name string, type string, license string, year string, directory string"), everything)


def write_dictionary(words: DataFrame, path: str) -> None:
    words.select("text", "source").write.json(path)


def write_traces(traces: DataFrame, path: str, trace: str = "trace_id") -> None:
    """JSON files in a folder a trace."""
    traces.write.partitionBy(trace).mode("overwrite").json(path)


def underscore_bio(c: str) -> Column:
    """array<struct<token, tag>> of ``a_b c``: the first piece of a word begins it; empty pieces are skipped."""
    words = F.filter(F.split(c, r"\s+"), lambda x: x != "")
    pieces = F.transform(words, lambda w: F.filter(F.split(w, "_"), lambda x: x != ""))
    return F.flatten(F.transform(pieces, lambda ps: F.transform(ps, lambda p, i: F.struct(p.alias("token"), F.when(i == 0, F.lit("B-W")).otherwise(F.lit("I-W")).alias("tag")))))


def join_words(tokens: Column, tags: Column, inside: str = "I_W") -> Column:
    """A text of tokens: an inside tag is led by _, any other by a blank."""
    z = F.zip_with(tokens, tags, lambda t, g: F.concat(F.when(g == inside, F.lit("_")).otherwise(F.lit(" ")), t))
    return F.ltrim(F.array_join(z, ""))


def vertical(tokens: DataFrame, key: str, order: str, word: str, tag: str) -> DataFrame:
    """(key, body): <s>, a row of word, tag and lower-case word a token, </s>."""
    row = F.concat_ws("\t", F.col(word), F.col(tag), F.lower(word))
    d = tokens.select(key, F.col(order).alias("_o"), row.alias("_r")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_o", "_r"))).alias("x"))
    return d.select(key, F.concat(F.lit("<s>\n"), F.array_join(F.transform("x", lambda v: v["_r"]), "\n"), F.lit("\n</s>")).alias("body"))


def parse_aspects(c: str) -> Column:
    """array<struct<aspect, polarity>> of ``{aspect, polarity}, ...``"""
    pat = r"\{([^,{}]+),\s*([^{}]+)\}"
    get = lambda k: F.regexp_extract_all(F.col(c), F.lit(pat), F.lit(k))
    return F.zip_with(get(1), get(2), lambda a, p: F.struct(F.trim(a).alias("aspect"), F.trim(p).alias("polarity")))


def session_markdown(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, body): turns under headings."""
    part = F.concat(F.lit("## "), F.col(role), F.lit(" "), F.col(turn).cast("string"), F.lit("\n\n"), F.col(text), F.lit("\n"))
    d = turns.select(conv, F.col(turn).alias("_o"), part.alias("_r")).groupBy(conv).agg(F.array_sort(F.collect_list(F.struct("_o", "_r"))).alias("x"))
    return d.select(conv, F.array_join(F.transform("x", lambda v: v["_r"]), "\n").alias("body"))


def parse_session(d: DataFrame, conv: str, body: str) -> DataFrame:
    """(conv, turn, role, text) back from a session."""
    heads = F.regexp_extract_all(F.col(body), F.lit(r"(?m)^## (system|user|assistant) [0-9]+\n\n"), F.lit(0))
    texts = F.filter(F.split(body, r"(?m)^## (?:system|user|assistant) [0-9]+\n\n", -1), lambda x, i: i > 0)
    x = d.select(conv, F.explode(F.arrays_zip(heads.alias("h"), texts.alias("t"))).alias("x"))
    return x.select(conv, F.regexp_extract("x.h", "([0-9]+)", 1).cast("long").alias("turn"), F.regexp_extract("x.h", "## ([a-z]+)", 1).alias("role"), F.regexp_replace("x.t", "\n\n?$", "").alias("text"))


def merge_corrected(made: DataFrame, corrected: DataFrame, key: str, type_: str, kind: str, values: list[str]) -> DataFrame:
    """Rows of ``made``; where ``corrected`` has the key with the type ``kind``, its type and values instead."""
    old = corrected.where(F.col(type_) == kind).select(F.col(key).alias("_k"), F.col(type_).alias("_t"), *[F.col(v).alias(f"_v_{v}") for v in values])
    d = made.join(old, F.col(key) == F.col("_k"), "left")
    swap = lambda a, b: F.when(F.col("_k").isNotNull(), F.col(a)).otherwise(F.col(b)).alias(b)
    return d.select(key, swap("_t", type_), *[swap(f"_v_{v}", v) for v in values])
