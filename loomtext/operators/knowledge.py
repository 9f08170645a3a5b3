"""A knowledge base of pages: markdown, search, links, checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.operators.lexicon import sums_before

# --- fixed values: what becomes what, in order (pattern, replacement) ---------------------------------------------------

HTML_RULES = [
    *[(rf"(?is)<{t}[\s>].*?</{t}>", "") for t in ("script", "style", "nav", "footer", "header", "aside")],
    (r"(?s)<!--.*?-->", ""),
    *[(rf"(?is)<h{n}[^>]*>\s*(.*?)\s*</h{n}>", "\n" + "#" * n + " $1\n") for n in range(1, 7)],
    (r"(?i)<(?:p|div)[^>]*>", "\n"),
    (r"(?i)</(?:p|div)>", "\n"),
    (r"(?i)<br\s*/?>", "\n"),
    (r"(?is)<(?:b|strong)[^>]*>(.*?)</(?:b|strong)>", "**$1**"),
    (r"(?is)<(?:i|em)[^>]*>(.*?)</(?:i|em)>", "*$1*"),
    (r'(?is)<a[^>]*href="([^"]*)"[^>]*>(.*?)</a>', "[$2]($1)"),
    (r"(?i)<li[^>]*>", "\n- "),
    (r"(?i)</li>", ""),
    (r"<[^>]+>", ""),
]
HTML_ENTITIES = [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " ")]
HTML_TIDY = [(r"(?m)^[ \t\r\f\x0b]+|[ \t\r\f\x0b]+$", ""), (r"\n{3,}", "\n\n"), (r"\A\s+|\s+\z", "")]


def html_to_markdown(html: str) -> Column:
    x = reduce(lambda c, r: F.regexp_replace(c, r[0], r[1]), HTML_RULES, F.col(html))
    x = reduce(lambda c, r: F.replace(c, F.lit(r[0]), F.lit(r[1])), HTML_ENTITIES, x)
    return reduce(lambda c, r: F.regexp_replace(c, r[0], r[1]), HTML_TIDY, x)


def title(html: str) -> Column:
    t = F.trim(F.regexp_replace(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))
    return F.when(F.col(html).rlike("(?is)<title[^>]*>.*?</title>"), t).otherwise("Untitled")


def front_matter(url: Column, page_title: Column, captured: Column) -> Column:
    lines = ["---\nsource_url: ", url, "\ntype: webpage\ntitle: \"", page_title, "\"\ncaptured_at: \"", captured, "\"\n---\n\n"]
    return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in lines])


def parse_front_matter(c: str) -> Column:
    """map<string,string> of the lines between the first two ---."""
    body = F.regexp_extract(c, r"(?s)\A---\n(.*?)\n---\n", 1)
    pairs = F.filter(F.split(body, "\n"), lambda x: F.contains(x, F.lit(": ")))
    return F.map_from_entries(F.transform(pairs, lambda x: F.struct(F.split_part(x, F.lit(": "), F.lit(1)).alias("key"), F.regexp_replace(F.regexp_replace(x, "^[^:]*: ", ""), '^"|"$', "").alias("value"))))


def search(df: DataFrame, text: str, terms: list[str], around: int = 60) -> DataFrame:
    """Add score (the number of terms that occur, as substrings) and snippet; rows without any go."""
    low = F.lower(text)
    hits = [F.contains(low, F.lit(t)) for t in terms]
    at = F.coalesce(*[F.when(h, F.instr(low, F.lit(t))) for h, t in zip(hits, terms)])
    size = F.coalesce(*[F.when(h, F.lit(len(t))) for h, t in zip(hits, terms)])
    d = df.withColumn("score", sum((h.cast("int") for h in hits[1:]), hits[0].cast("int"))).where("score > 0")
    d = d.withColumn("_at", at - 1).withColumn("_n", size)
    start = F.greatest(F.lit(0), F.col("_at") - around)
    cut = F.substring(F.col(text), start + 1, F.least(F.length(text), F.col("_at") + F.col("_n") + around) - start)
    return d.withColumn("snippet", F.trim(F.replace(cut, F.lit("\n"), F.lit(" ")))).drop("_at", "_n")


def first_heading(text: str, otherwise: Column) -> Column:
    h = F.regexp_extract(text, r"(?m)^# (.*)$", 1)
    return F.when(F.col(text).rlike("(?m)^# "), F.trim(h)).otherwise(otherwise)


def link_targets(md: str) -> Column:
    """Targets of markdown links."""
    return F.regexp_extract_all(F.col(md), F.lit(r"\[[^\]]*\]\(([^)]*)\)"), F.lit(1))


def backlinks(articles: DataFrame, key: str, links: str) -> DataFrame:
    """(article, source): who links to whom, as an equi-join on the target's last part: no regex meets all pairs."""
    last = F.lower(F.regexp_replace(F.regexp_extract("t", "([^/]*)/?$", 1), r"\.md$", ""))
    out = articles.select(F.col(key).alias("source"), F.explode(links).alias("t")).select("source", last.alias("article")).where("article <> ''").distinct()
    return out.join(articles.select(F.lower(key).alias("article")).distinct(), "article", "left_semi").select("article", "source")


def lint(articles: DataFrame, key: str, links: str) -> DataFrame:
    """(kind, name): links that lead nowhere, and articles nobody links to."""
    last = F.lower(F.regexp_replace(F.regexp_extract("t", "([^/]*)/?$", 1), r"\.md$", ""))
    out = articles.select(F.explode(links).alias("t")).select(last.alias("name")).where("name <> ''").distinct()
    have = articles.select(F.lower(key).alias("name")).distinct()
    return out.join(have, "name", "left_anti").select(F.lit("broken").alias("kind"), "name").unionByName(have.join(out, "name", "left_anti").select(F.lit("orphan").alias("kind"), "name"))


def quality_score(text: str) -> Column:
    """1 to 10 from length (40 %), sentences (30 %) and their density (30 %), less for markup left behind."""
    n = F.length(text).cast("double")
    sents = F.regexp_count(text, F.lit(r"[.?!]+")).cast("double")
    size = F.least(n / 5000, F.lit(1.0))
    count = F.least(sents / 50, F.lit(1.0))
    density = F.when(sents == 0, 0.0).otherwise(F.least(F.greatest(1 - F.abs(n / sents - 100) / 200, F.lit(0.0)), F.lit(1.0)))
    penalty = F.least(F.regexp_count(text, F.lit(r"[\[\]{}<>|=]")).cast("double") / 50, F.lit(1.0))
    return F.greatest(F.lit(1), F.least(F.lit(10), F.round(1 + 9 * (0.4 * size + 0.3 * count + 0.3 * density) - 2 * penalty))).cast("int")


def _without_tags(c: Column, to: str) -> Column:
    return F.trim(F.regexp_replace(c, "<[^>]+>", to))


def paper_fields(url: str, html: str) -> list[Column]:
    """Id, title, authors and abstract of a paper's page; the id stands for a missing title."""
    number = F.nullif(F.regexp_extract(url, r"(\d{4}\.\d{4,5})", 1), F.lit(""))
    inner = lambda cls, end: F.regexp_extract(html, rf'(?is)class="{cls}"[^>]*>(.*?)</{end}>', 1)
    title = _without_tags(inner('title[^"]*', "h1"), " ")
    return [number.alias("paper_id"), F.coalesce(F.nullif(title, F.lit("")), number).alias("title"), _without_tags(inner("authors", "div"), "").alias("authors"), _without_tags(inner('abstract[^"]*', "blockquote"), "").alias("abstract")]


def post_fields(url: str) -> list[Column]:
    """Account, number and file name of a post's address; nulls if it is none."""
    part = lambda k: F.nullif(F.regexp_extract(url, r"^[a-z]+://[^/?#]+/([^/?#]+)/status/([^/?#]+)", k), F.lit(""))
    return [part(1).alias("account"), part(2).alias("post_id"), F.concat(part(1), F.lit("-"), part(2), F.lit(".md")).alias("file_name")]


# --- what comes in and goes out ---------------------------------------------------------------------------------------------

#: name = stem, a number that was added, ending.
_NAME = r"^(.*?)(?:-([0-9]{1,9}))?(\.[^./]*)?$"


def ingested(taken: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """``new`` with ``name`` made free: no row takes the name of another, nor one of ``taken`` (name).

    A name that nobody has stays, for the first row in ``order`` (unique) that wants it; others get the next free number of their stem. Rows
    of one stem are numbered in ranges, however many there are.
    """
    part = lambda k: F.regexp_extract("name", _NAME, k)
    family, wish = F.struct(part(1).alias("stem"), part(3).alias("end")), F.coalesce(part(2).try_cast("long"), F.lit(0))
    key = lambda d: d.withColumn("_stem", F.concat_ws("\0", family["stem"], family["end"])).withColumn("_wish", wish)
    old = key(taken.select("name").distinct())
    d = sums_before(key(new), "name", [order], F.lit(1), "_same").join(old.select("name", F.lit(True).alias("_has")), "name", "left")
    d = d.withColumn("_free", F.col("_has").isNull() & (F.col("_same") == 0))
    top = old.select("_stem", "_wish").unionByName(d.where("_free").select("_stem", "_wish")).groupBy(F.col("_stem").alias("_s")).agg(F.max("_wish").alias("_top"))
    d = sums_before(d, "_stem", [order], F.when(~F.col("_free"), 1).otherwise(0), "_moved").join(top, F.col("_stem") == F.col("_s"), "left")
    number = (F.coalesce("_top", F.lit(0)) + F.col("_moved") + 1).cast("string")
    name = F.when(F.col("_free"), F.col("name")).otherwise(F.concat(part(1), F.lit("-"), number, part(3)))
    return d.withColumn("name", name).select(*new.columns)


def deletions(tree: DataFrame, asked: DataFrame, protected: str = "raw/") -> DataFrame:
    """(path, status) of paths to be deleted: ``protected`` for what lies in that branch (also by way of dots), ``missing`` for what ``tree`` lacks, else ``deleted``."""
    plain = F.regexp_replace(F.regexp_replace("path", r"^(?:\./|/)+", ""), r"/(?:\./)+", "/")
    d = asked.withColumn("_p", plain).join(tree.select(F.col("path").alias("_p"), F.lit(True).alias("_there")).distinct(), "_p", "left")
    guarded = F.col("_p").startswith(protected) | F.col("_p").contains("..") | (F.col("_p") == protected.rstrip("/"))
    return d.select("path", F.when(guarded, "protected").when(F.col("_there").isNull(), "missing").otherwise("deleted").alias("status"))
