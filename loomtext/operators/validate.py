"""Line and corpus checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions import text as X


def clean_line(c: str) -> Column:
    """30 characters or more and no markup at the start."""
    return (F.length(c) >= 30) & ~F.col(c).startswith("<")


def of_day_before(df: DataFrame, ts: str, day: str) -> DataFrame:
    """Rows of the day before ``day``: a range on the column itself, so that it reaches the scan."""
    end = F.to_date(F.lit(day))
    return df.where((F.col(ts) >= F.date_sub(end, 1)) & (F.col(ts) < end))


def accented(df: DataFrame, text: str, low: int = 6, high: int = 60) -> DataFrame:
    w = F.regexp_extract_all(F.col(text), F.lit("[a-zA-ZÀ-ɏḀ-ỿ]+"), F.lit(0))
    d = df.withColumn("_w", w).withColumn("n_tokens", F.size("_w").cast("long"))
    d = d.withColumn("n_marked", F.size(F.filter("_w", lambda x: ~x.rlike("^[a-zA-Z]+$"))).cast("long"))
    return d.where(F.col("n_tokens").between(low, high) & (2 * F.col("n_marked") >= F.col("n_tokens"))).drop("_w")


def text_stats(c: str) -> list[Column]:
    words = F.filter(F.split(c, r"\s+"), lambda x: x != "")
    return [F.length(c).cast("long").alias("n_chars"), F.size(words).cast("long").alias("n_words"), (F.regexp_count(c, F.lit("\n")) + 1).cast("long").alias("n_lines")]


def _rows(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("_lines", F.split("body", "\n"))


def missing_headers(blocks: DataFrame) -> DataFrame:
    """(block, missing) for blocks without a sent_id or text header."""
    has = lambda k: F.exists("_lines", lambda x: x.startswith(f"# {k} = "))
    asked = F.array(*[F.when(~has(k), F.lit(k)) for k in ("sent_id", "text")])
    return _rows(blocks).select("block", F.explode(F.array_compact(asked)).alias("missing"))


def bad_rows(blocks: DataFrame, tags: tuple[str, ...] = ("B-W", "I-W")) -> DataFrame:
    """(block, row_no, kind): the first fault of each token row."""
    rows = _rows(blocks).select("block", F.posexplode(F.filter("_lines", lambda x: ~x.startswith("#"))).alias("row_no", "row"))
    cells = F.split("row", "\t")
    rows = rows.withColumn("token", F.get(cells, F.lit(0))).withColumn("tag", F.get(cells, F.lit(1))).withColumn("n", F.size(cells))
    rows = rows.withColumn("again", X.regex_tokens("token"))
    kind = (
        F.when(F.col("n") != 2, "columns")
        .when(F.trim("token") != F.col("token"), "edge space")
        .when(~F.col("tag").isin(*tags), "tag")
        .when((F.size("again") != 1) | (F.get("again", F.lit(0))["token"] != F.col("token")), "tokens")
    )
    return rows.withColumn("kind", kind).where("kind IS NOT NULL").select("block", "row_no", "kind")


def content_words(tokens: DataFrame, word: str, tag: str, left_out: tuple[str, ...] = ("Np", "CH")) -> DataFrame:
    """Tokens in small letters, without proper names and marks."""
    return tokens.where(~F.col(tag).isin(*left_out)).withColumn(word, F.lower(word))
