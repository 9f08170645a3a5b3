"""Pages as a knowledge base, agent logs and event streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext.operators import agentlog as A
from loomtext.operators import knowledge as K
from loomtext.operators.written import new_folder
from loomtext.plans.catalog import query, table
from loomtext.streaming import windows as S


def _md_sql(col: str) -> str:
    x = col
    for pat, rep in K.HTML_RULES:
        opts = "g"
        if pat.startswith("(?"):
            flags, pat = pat[2 : pat.index(")")], pat[pat.index(")") + 1 :]
            opts += flags
        rep = rep.replace("$", "\\")
        x = f"regexp_replace({x}, '{pat}', '{rep}', '{opts}')"
    for a, b in K.HTML_ENTITIES:
        b = b.replace("'", "''")
        x = f"replace({x}, '{a}', '{b}')"
    x = f"array_to_string(list_transform(string_split({x}, chr(10)), lambda l: trim(l, ' ' || chr(9) || chr(13) || chr(12) || chr(11))), chr(10))"
    return f"trim(regexp_replace({x}, '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13))"


@query(f"SELECT page_id, {_md_sql('html')} AS markdown FROM pages")
def html_to_markdown(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", K.html_to_markdown("html").alias("markdown"))


@query(
    r"""
SELECT page_id, '---' || chr(10) || 'source_url: ' || url || chr(10) || 'type: webpage' || chr(10) || 'title: "' || trim(regexp_replace(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is'), '\s+', ' ', 'g')) || '"' || chr(10)
 || 'captured_at: "2024-01-01"' || chr(10) || '---' || chr(10) || chr(10) AS head FROM pages"""
)
def page_frontmatter(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", K.front_matter(F.col("url"), K.title("html"), F.lit("2024-01-01")).alias("head"))


@query("SELECT page_id, url FROM pages")
def frontmatter_parse(spark, sf_dir):
    f = page_frontmatter(spark, sf_dir).withColumn("m", K.parse_front_matter("head"))
    return f.select("page_id", F.col("m")["source_url"].alias("url"))


TERMS = ["the", "thand", "reeaution", "zzzz"]
_SC = " + ".join(f"contains(lower(text), '{t}')::INT" for t in TERMS)
_AT = "coalesce(" + ", ".join(f"CASE WHEN contains(lower(text), '{t}') THEN instr(lower(text), '{t}') - 1 END" for t in TERMS) + ")"
_LN = "coalesce(" + ", ".join(f"CASE WHEN contains(lower(text), '{t}') THEN {len(t)} END" for t in TERMS) + ")"


@query(f"""
WITH s AS (SELECT doc_id, text, {_SC} AS score, {_AT} AS p0, {_LN} AS n FROM documents), h AS (SELECT *, greatest(0, p0 - 60) AS a, least(length(text), p0 + n + 60) AS z FROM s WHERE score > 0)
SELECT doc_id, score, trim(replace(substr(text, a + 1, z - a), chr(10), ' ')) AS snippet FROM h ORDER BY score DESC, doc_id LIMIT 20""")
def kb_search(spark, sf_dir):
    """The twenty best documents for a query's terms, with what stands around the first."""
    return K.search(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", TERMS).select("doc_id", "score", "snippet").orderBy(F.desc("score"), "doc_id").limit(20)


@query(r"""
SELECT count(*) AS n_articles, sum(CASE WHEN trim(html) = '' THEN 0 ELSE len(string_split_regex(trim(html), '\s+')) END)::BIGINT AS n_words, count(DISTINCT split_part(regexp_extract(url, '^[a-z]+://[^/]*/([^?#]*)', 1), '/', 1)) AS n_categories FROM pages""")
def kb_stats(spark, sf_dir):
    words = F.size(F.filter(F.split("html", r"\s+"), lambda x: x != ""))
    cat = F.split_part(F.regexp_extract("url", "^[a-z]+://[^/]*/([^?#]*)", 1), F.lit("/"), F.lit(1))
    return table(spark, sf_dir, "pages").agg(F.count("*").alias("n_articles"), F.sum(words).cast("long").alias("n_words"), F.count_distinct(cat).alias("n_categories"))


def articles(spark, sf_dir):
    """Pages under a word of their address, with the links of their menus."""
    md = F.regexp_extract_all("html", F.lit('(?i)<a href="/?([^"]*)">'), F.lit(1))
    return table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^[a-z]+://(?:www[.]|m[.]|blog[.])?([a-z]+)", 1).alias("name"), md.alias("links"))


ART = r"""WITH a AS (SELECT regexp_extract(url, '^[a-z]+://(?:www[.]|m[.]|blog[.])?([a-z]+)', 1) AS name, regexp_extract_all(html, '<a href="/?([^"]*)">', 1) AS links FROM pages),
o AS (SELECT DISTINCT name AS source, lower(regexp_replace(regexp_extract(t, '([^/]*)/?$', 1), '\.md$', '')) AS article FROM (SELECT name, unnest(links) AS t FROM a))
"""


@query(ART + "SELECT article, source FROM o WHERE article <> '' AND article IN (SELECT lower(name) FROM a)")
def backlinks(spark, sf_dir):
    return K.backlinks(articles(spark, sf_dir), "name", "links")


@query(ART + "SELECT DISTINCT 'broken' AS kind, article AS name FROM o WHERE article <> '' AND article NOT IN (SELECT lower(name) FROM a) UNION ALL SELECT DISTINCT 'orphan', lower(name) FROM a WHERE lower(name) NOT IN (SELECT article FROM o)")
def kb_lint(spark, sf_dir):
    return K.lint(articles(spark, sf_dir), "name", "links")


@query(r"""
WITH s AS (SELECT doc_id, length(text)::DOUBLE AS n, len(regexp_extract_all(text, '[.?!]+'))::DOUBLE AS s, len(regexp_extract_all(text, '[\[\]{}<>|=]'))::DOUBLE AS m FROM documents)
SELECT doc_id, greatest(1, least(10, round(1 + 9 * (0.4 * least(n / 5000, 1.0) + 0.3 * least(s / 50, 1.0) + 0.3 * CASE WHEN s = 0 THEN 0.0 ELSE least(greatest(1 - abs(n / s - 100) / 200, 0.0), 1.0) END) - 2 * least(m / 50, 1.0))))::INT AS score FROM s""")
def quality_score(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", K.quality_score("text").alias("score"))


# --- agent logs -----------------------------------------------------------------------------------------------------------


@query("SELECT event_id, CASE WHEN props LIKE '{%' THEN props ELSE '{}' END AS args, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def json_args(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "props", *A.tool_arguments("props"))
    return e.select("event_id", "args", F.get_json_object("args", "$.k").cast("long").alias("k"))


@query("SELECT user_id, count(*) AS calls, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS tokens, round(sum(value), 6) AS total FROM events GROUP BY user_id")
def usage_totals(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return e.groupBy("user_id").agg(F.count("*").alias("calls"), F.sum("k").alias("tokens"), F.round(F.sum("value"), 6).alias("total"))


SP = """WITH p AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, min(ts) FILTER (event_type = 'view') AS started, max(ts) FILTER (event_type = 'purchase') AS ended FROM events WHERE event_type IN ('view', 'purchase') GROUP BY ALL)"""


def spans(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return A.pair_spans(e, ["user_id", "day"], "event_type", "ts", "view", "purchase")


@query(SP + " SELECT user_id, day, started, ended FROM p WHERE started IS NOT NULL")
def span_pairing(spark, sf_dir):
    return spans(spark, sf_dir).drop("duration_ms")


@query(SP + " SELECT user_id, day, trunc((epoch_us(ended) - epoch_us(started)) / 1000)::BIGINT AS duration_ms FROM p WHERE started IS NOT NULL AND ended IS NOT NULL")
def span_durations(spark, sf_dir):
    return spans(spark, sf_dir).where("ended IS NOT NULL").select("user_id", "day", "duration_ms")


@query(SP + ", d AS (SELECT day, trunc((epoch_us(ended) - epoch_us(started)) / 1000) AS ms FROM p WHERE started IS NOT NULL) SELECT day, count(*) AS n, count(ms) AS n_closed, max(ms)::BIGINT AS longest, round(avg(ms), 3) AS mean FROM d GROUP BY day")
def trace_rollup(spark, sf_dir):
    return spans(spark, sf_dir).groupBy("day").agg(F.count("*").alias("n"), F.count("duration_ms").alias("n_closed"), F.max("duration_ms").alias("longest"), F.round(F.avg("duration_ms"), 3).alias("mean"))


@query("SELECT user_id, event_type AS status FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type DESC) AS r FROM events) WHERE r = 1")
def task_status(spark, sf_dir):
    return A.task_status(table(spark, sf_dir, "events"), "user_id", "event_type", "ts")


@query("WITH s AS (SELECT user_id, arg_max(event_type, ts) AS status FROM events GROUP BY user_id) SELECT min(user_id) FILTER (status = 'view') AS next_pending, bool_and(status IN ('purchase', 'signup')) AS complete FROM s")
def task_progress(spark, sf_dir):
    """The pending task with the lowest id, and whether all are done."""
    s = task_status(spark, sf_dir)
    return s.agg(F.min(F.when(F.col("status") == "view", F.col("user_id"))).alias("next_pending"), F.bool_and(F.col("status").isin("purchase", "signup")).alias("complete"))


# --- streams: run over what is there, results as of a batch ----------------------------------------------------------------


def _stream(spark, sf_dir):
    """The events as a stream, whether the table is a file or a folder of files: a stream's path must be a folder or a pattern. All files
    are one batch, so that none is late. Watermarks want instants."""
    s = S.stream_of(spark, f"{sf_dir}/[e]vents.parquet", table(spark, sf_dir, "events").schema, 2**31 - 1)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def _plain(df, *cols):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols})


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def events_tumbling(spark, sf_dir):
    t = S.run_to_files(S.tumbling(_stream(spark, sf_dir), "ts", "1 hour", "event_type"), "complete")
    return _plain(t, "start").withColumn("total", F.round("total", 6))


@query("SELECT time_bucket(INTERVAL '15 minutes', ts) - INTERVAL 15 MINUTE * k AS start, event_type, count(*) AS n FROM events, (SELECT unnest(range(0, 4)) AS k) GROUP BY ALL")
def events_sliding(spark, sf_dir):
    return _plain(S.run_to_files(S.sliding(_stream(spark, sf_dir), "ts", "1 hour", "15 minutes", "event_type"), "complete"), "start")


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR THEN 1 ELSE 0 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def events_sessions(spark, sf_dir):
    return _plain(S.run_to_files(S.sessions(_stream(spark, sf_dir), "ts", "2 hours", "user_id"), "complete"), "start", "end")


@query("SELECT DISTINCT user_id, event_type FROM events")
def events_dedup(spark, sf_dir):
    """A stream without repeats; what is older than a week before the newest event is forgotten."""
    d = S.distinct_events(_stream(spark, sf_dir).select("user_id", "event_type", "ts"), "ts", ["user_id", "event_type"], "7 days")
    return S.run_to_files(d).select("user_id", "event_type")


@query("""
SELECT event_id, ts AS at FROM events WHERE event_type IS DISTINCT FROM 'purchase' OR ts > (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 7 DAY FROM events WHERE event_type IS DISTINCT FROM 'purchase')""")
def events_late(spark, sf_dir):
    """Purchases that come after all other events: those older than the watermark are dropped."""
    e, folder = table(spark, sf_dir, "events"), new_folder(spark)
    for part in ("NOT event_type <=> 'purchase'", "event_type <=> 'purchase'"):
        e.where(part).write.mode("append").parquet(f"{folder}/in")
        s = S.stream_of(spark, f"{folder}/in", e.schema).withColumn("ts", F.col("ts").cast("timestamp"))
        out = S.run_to_files(S.distinct_events(s.select("event_id", "ts"), "ts", ["event_id"], "7 days"), folder=folder)
    return _plain(out, "ts").withColumnRenamed("ts", "at")


@query("SELECT event_type AS word, count(*) AS df FROM events GROUP BY event_type")
def stream_vocabulary(spark, sf_dir):
    """Document frequencies kept up by a stream."""
    s = _stream(spark, sf_dir).groupBy(F.col("event_type").alias("word")).agg(F.count("*").alias("df"))
    return S.run_to_files(s, "complete")


@query("SELECT event_id, upper(event_type) AS kind FROM events")
def stream_projection(spark, sf_dir):
    """Scalar functions on a stream as on a table."""
    return S.run_to_files(_stream(spark, sf_dir).select("event_id", F.upper("event_type").alias("kind")))


@query("""
WITH e AS (SELECT user_id, event_type, ts FROM events WHERE event_type IN ('view', 'purchase')),
g AS (SELECT *, count(*) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS k FROM e),
p AS (SELECT user_id, min(ts) FILTER (event_type = 'view') AS started, max(ts) FILTER (event_type = 'purchase') AS ended FROM g GROUP BY user_id, k)
SELECT * FROM p WHERE started IS NOT NULL AND (ended IS NOT NULL OR date_trunc('milliseconds', started) + INTERVAL 1 HOUR <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE FROM e))""")
def stream_pairs(spark, sf_dir):
    """Starts paired with ends by a stateful operator with a timeout."""
    return _plain(S.run_to_files(S.paired(_stream(spark, sf_dir), "user_id", "event_type", "ts", "view", "purchase")), "started", "ended")
