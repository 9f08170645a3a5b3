"""The registered queries: each applies one operator to its whole table and derives the agreed columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm import ann, chat, codebooks, html, langid, mixing, negatives, packing, quality, rpforest, secrets, sharding, simhash
from loomtext.llm.common import table


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return d.select("doc_id", simhash.fingerprint_hex().alias("fingerprint"), F.col("component").alias("component_id"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = secrets.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin([r.name for r in secrets.BASE]))
    return d.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op5_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op6_fair_queue_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = mixing.mix(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "size", "source_size", "target", "taken", F.col("finish").alias("finish_time"), "mix_offset")


def op7_cross_polytope_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return ann.nearest(e, e.where(F.col("vec_id") % 20 == 0))


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text leaves 2 modulo 4; false for a null id."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "utf-8")) % 4 == 2, F.lit(False))


def learn_languages(docs: DataFrame) -> langid.Model:
    return langid.fit(docs.where(~held_out() & F.col("doc_id").isNotNull()), key=F.col("doc_id"))


def op8_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    got = langid.identify(d.select("doc_id", "text"), learn_languages(d))
    return got.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "mixture")


def op9_forest_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rpforest.link_table(table(spark, sf_dir, "embeddings"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = html.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return d.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def quality_held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text is divisible by 5; false for a null id."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "utf-8")) % 5 == 0, F.lit(False))


def op11_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    d = quality.rate(docs.select("doc_id", "text"), labels.select("doc_id", "quality"), learn=~quality_held_out())
    return d.select("doc_id", quality_held_out().alias("held_out"), "score", "predicted")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.col("label").cast("long").alias("label"))
    e = e.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.mine(e, F.col("vec_id") % 100 == 0)


def op13_heap_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codebooks.code_table(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_simhash_near_dedup, op2_secret_scan, op3_packing, op4_chat_format, op5_hilbert_sharding, op6_fair_queue_mixing, op7_cross_polytope_search, op8_language_mixture, op9_forest_near_dedup, op10_html_extraction, op11_pairwise_quality, op12_hard_negatives, op13_heap_codes)}


def _secrets_sql() -> str:
    """Each rule in a pattern that RE2 takes as well, the group that counts, and its least length."""
    either = "".join
    names = ["|".join(either(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token")), "[Aa][Pp][Ii]_?[Kk][Ee][Yy]"]
    rules = [("assign", f"""({'|'.join(names)})["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]{24,}", 0, 24)]
    rules += [(r.name, r.pattern, r.group, r.least) for r in secrets.EXTRA]
    each = " UNION ALL ".join(f"SELECT rid, '{n}' AS kind, {k} AS ord, {least} AS least, regexp_extract_all(t, '{p}', 0) AS m, regexp_extract_all(t, '{p}', {g}) AS g, string_split_regex(t, '{p}') AS p FROM d" for k, (n, p, g, least) in enumerate(rules))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS rid FROM documents),
f AS ({each}),
i AS (SELECT rid, kind, ord, least, m, g, p, unnest(range(1, len(m) + 1)) AS k FROM f WHERE len(m) > 0),
s AS (SELECT rid, kind, ord, list_sum(list_transform(p[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k-1], lambda x: length(x))), 0) AS a, length(m[k]) AS n
      FROM i WHERE length(g[k]) >= least),
w AS (SELECT *, kind || ':' || CAST(a AS BIGINT) || ':' || CAST(a + n AS BIGINT) AS span FROM s),
j AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
      string_agg(span, ',' ORDER BY a, ord) AS spans, string_agg(span, ',' ORDER BY a, ord) FILTER (ord < 3) AS base FROM w GROUP BY rid)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN j USING (rid)
"""


def _codes_sql(rounds: int = 6, parts: int = 8, width: int = 8) -> str:
    """Plain Lloyd rounds over every part and entry, for vectors of ``parts`` times ``width`` components."""
    far = "list_dot_product(t.y, t.y) - 2 * list_dot_product(t.y, c.y) + list_dot_product(c.y, c.y)"
    mean = ", ".join(f"floor(sum(y[{i}]) / count(*))" for i in range(1, width + 1))
    out = f"""
WITH d AS (SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT v, row_number() OVER (ORDER BY vec_id, v) - 1 AS e FROM d QUALIFY e < 16),
p AS (SELECT unnest(range({parts})) AS p),
t AS MATERIALIZED (SELECT rid, p, v[p * {width} + 1 : p * {width} + {width}] AS y FROM d, p),
c0 AS MATERIALIZED (SELECT p, e, v[p * {width} + 1 : p * {width} + {width}] AS y FROM s, p)"""
    for r in range(rounds + 1):
        out += f""",
a{r} AS MATERIALIZED (SELECT t.rid, t.p, t.y, c.e, {far} AS far FROM t JOIN c{r} c USING (p) QUALIFY row_number() OVER (PARTITION BY t.rid, t.p ORDER BY far, c.e) = 1)"""
        if r < rounds:
            out += f""",
m{r} AS (SELECT p, e, [{mean}] AS y FROM a{r} GROUP BY p, e),
c{r + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(m.y, c.y) AS y FROM c{r} c LEFT JOIN m{r} m USING (p, e))"""
    return out + f""",
h AS (SELECT sha256(string_agg(array_to_string(list_transform(y, lambda x: x::BIGINT::VARCHAR), ','), ',' ORDER BY p, e)) AS h FROM c{rounds}),
r AS (SELECT rid, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(far)::BIGINT AS error FROM a{rounds} GROUP BY rid)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM d JOIN r USING (rid), h
"""


ORACLES: dict[str, str] = {
    "op12_hard_negatives": """
WITH d AS (SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.rid AS anchor, a.vec_id AS anchor_id, b.rid, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score FROM d a JOIN d b ON a.rid <> b.rid WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.anchor, p.rid ORDER BY s.score DESC, s.vec_id) AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score QUALIFY rank <= 10
""",
    "op13_heap_codes": _codes_sql(),
    "op2_secret_scan": _secrets_sql(),
    "op4_chat_format": """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
c AS (SELECT conv_id, list(struct_pack(r := role, x := text) ORDER BY turn, role, text) AS v, count(*) AS n FROM t GROUP BY conv_id),
u AS (SELECT min(conv_id) AS conv_id, v, n, count(*) AS copies FROM c GROUP BY v, n),
k AS (SELECT * FROM u a WHERE NOT EXISTS (SELECT 1 FROM u b WHERE b.n > a.n AND b.v[1] = a.v[1] AND b.v[1:a.n] = a.v))
SELECT conv_id, (g.s)::INTEGER AS segment, n AS turns, copies,
       array_to_string(list_transform(v[g.s * 1024 + 1 : g.s * 1024 + 1024], lambda q: '<|im_start|>' || replace(coalesce(q.r, 'user'), '<|im_', '< |im_') || chr(10) || replace(coalesce(q.x, ''), '<|im_', '< |im_') || '<|im_end|>' || chr(10)), '') AS rendered
FROM k, LATERAL (SELECT unnest(range(0, (n + 1023) // 1024)) AS s) g
""",
}
