"""Trees, span trees and chains over the conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext.functions import text as X
from loomtext.operators import sequence as S
from loomtext.operators import trees as T
from loomtext.operators.written import written
from loomtext.plans.catalog import query, table

#: A head for each turn of a conversation: of even ones always an earlier turn or the root, of odd ones any.
HEADS = """
WITH RECURSIVE c AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id),
h AS (SELECT conv_id, n, list_transform(range(1, n + 1), lambda i: CASE WHEN conv_id % 2 = 0 THEN (conv_id + i) % i ELSE (i * 7 + conv_id * 3) % (n + 1) END) AS h FROM c),
t AS (SELECT conv_id, n, h AS hs, i, h[i] AS h FROM h, LATERAL (SELECT unnest(range(1, n + 1)) AS i)),
w AS (SELECT conv_id, n, hs, i, h AS p, 1 AS k FROM t UNION ALL SELECT conv_id, n, hs, i, hs[p], k + 1 FROM w WHERE p > 0 AND k <= n)
"""


def turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").cast("int").alias("n"))


def heads(spark, sf_dir):
    conv = F.col("conv_id")
    head = lambda i: F.when(conv % 2 == 0, (conv + i) % i).otherwise((i * 7 + conv * 3) % (F.col("n") + 1)).cast("int")
    return turns(spark, sf_dir).select("conv_id", F.transform(F.sequence(F.lit(1), F.col("n")), head).alias("heads"))


@query(HEADS + "SELECT conv_id, coalesce(string_agg(r.i::VARCHAR, ',' ORDER BY r.i), '') AS ring FROM c LEFT JOIN (SELECT DISTINCT conv_id, i FROM w WHERE p = i AND k > 1 AND hs[i] <> i) r USING (conv_id) GROUP BY conv_id")
def tree_cycles(spark, sf_dir):
    return heads(spark, sf_dir).select("conv_id", F.array_join(T.in_cycle(F.col("heads")), ",").alias("ring"))


@query(HEADS + """, g AS (SELECT conv_id, i, bool_or(p = 0) AS ok FROM w GROUP BY conv_id, i), r AS (SELECT conv_id, count(*) FILTER (h = 0) AS roots FROM t GROUP BY conv_id)
SELECT conv_id, bool_and(ok) AND any_value(roots) = 1 AS one_root, bool_and(ok) AND any_value(roots) >= 1 AS multi_root FROM g JOIN r USING (conv_id) GROUP BY conv_id""")
def is_tree(spark, sf_dir):
    return heads(spark, sf_dir).select("conv_id", T.is_tree(F.col("heads")).alias("one_root"), T.is_tree(F.col("heads"), multiroot=True).alias("multi_root"))


@query(HEADS + """, x AS (SELECT conv_id, i AS d, h, least(h, i) AS l, greatest(h, i) AS r FROM t),
b AS (SELECT a.conv_id, bool_or((a.l <= b.h AND b.h <= a.r AND a.h = b.d) OR (b.l <= a.h AND a.h <= b.r AND b.h = a.d)
   OR (((a.l < b.l AND b.l < a.r) OR (a.l < b.r AND b.r < a.r)) AND (a.l - b.l) * (a.r - b.r) > 0)) AS bad FROM x a JOIN x b ON a.conv_id = b.conv_id AND a.d < b.d GROUP BY a.conv_id)
SELECT conv_id, NOT coalesce(bad, false) AS projective FROM c LEFT JOIN b USING (conv_id)""")
def is_projective(spark, sf_dir):
    return heads(spark, sf_dir).select("conv_id", T.is_projective(F.col("heads")).alias("projective"))


@query(HEADS + """, s AS (SELECT a.conv_id, a.i, CASE WHEN a.i < a.h THEN min(b.i) FILTER (b.i > a.i AND b.i < b.h) ELSE max(b.i) FILTER (b.i < a.i AND b.i > b.h) END AS s
  FROM t a LEFT JOIN t b ON a.conv_id = b.conv_id AND a.h = b.h AND a.i <> b.i AND a.h <> a.i GROUP BY a.conv_id, a.i, a.h)
SELECT conv_id, string_agg(coalesce(s, -1)::VARCHAR, ',' ORDER BY i) AS sibs FROM s GROUP BY conv_id""")
def next_siblings(spark, sf_dir):
    return heads(spark, sf_dir).select("conv_id", F.array_join(T.next_siblings(F.col("heads")), ",").alias("sibs"))


def arc_scores(spark, sf_dir):
    """(conv_id, s): scores in which one tree stands out, a spine of odd turns with a leaf after each; all others score under 1."""
    gold = lambda d: F.when(d == 1, 0).when(d % 2 == 0, d - 1).otherwise(d - 2)
    least = lambda d, h: F.pmod(d * 3 + h * 5 + F.col("conv_id"), F.lit(11)) / 11.0
    every = lambda: F.sequence(F.lit(0), F.col("n"))
    s = F.transform(every(), lambda d: F.transform(every(), lambda h: F.when((d > 0) & (gold(d) == h), F.lit(100.0)).otherwise(least(d, h))))
    return written(turns(spark, sf_dir).select("conv_id", s.alias("s")))


SPINE = "WITH c AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id), g AS (SELECT conv_id, '0,' || array_to_string(list_transform(range(1, n + 1), lambda d: CASE WHEN d = 1 THEN 0 WHEN d % 2 = 0 THEN d - 1 ELSE d - 2 END), ',') AS heads FROM c)"


@query(SPINE + " SELECT conv_id, kind, heads FROM g, (VALUES ('eisner'), ('mst')) k(kind)")
def mst_decode(spark, sf_dir):
    d = arc_scores(spark, sf_dir)
    both = [d.select("conv_id", F.lit(k).alias("kind"), F.array_join(T.decode(F.col("s"), k), ",").alias("heads")) for k in ("eisner", "mst")]
    return both[0].unionByName(both[1])


@query(SPINE + " SELECT conv_id, heads FROM g")
def sibling_decode(spark, sf_dir):
    """By arcs and neighbouring dependents, whose scores are too small to change the tree."""
    every = lambda: F.sequence(F.lit(0), F.size("s") - 1)
    t = F.transform(every(), lambda d: F.transform(every(), lambda h: F.transform(every(), lambda k: F.pmod(d + 2 * h + 3 * k, F.lit(7)) / 7.0)))
    return written(arc_scores(spark, sf_dir).withColumn("t", t)).select("conv_id", F.array_join(T.decode_siblings(F.col("s"), F.col("t")), ",").alias("heads"))


@query("""
WITH c AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)
SELECT conv_id, array_to_string(list_concat(flatten(list_transform(range(n - 1), lambda k: [k || '-' || n, k || '-' || (k + 1)])), [(n - 1) || '-' || n]), ',') AS spans FROM c""")
def constituency_decode(spark, sf_dir):
    """Span scores in which all spans to the end stand out."""
    every = lambda: F.sequence(F.lit(0), F.col("n"))
    s = F.transform(every(), lambda i: F.transform(every(), lambda j: F.when(i >= j, 0.0).when(j == F.col("n"), F.lit(100.0)).otherwise(F.pmod(i * 3 + j * 5 + F.col("conv_id"), F.lit(7)) / 7.0)))
    d = written(turns(spark, sf_dir).select("conv_id", s.alias("s")))
    return d.select("conv_id", F.array_join(F.transform(T.constituents(F.col("s")), lambda x: F.concat_ws("-", x["start"], x["stop"])), ",").alias("spans"))


STATE = [("r=user", "B-W", 1.0), ("r=user", "I-W", 0.2), ("r=assistant", "I-W", 0.7), ("r=assistant", "B-W", 0.1), ("long=1", "I-W", 0.45), ("long=0", "B-W", 0.3)]
TRANS = [("B-W", "I-W", 0.5), ("I-W", "I-W", -0.2), ("B-W", "B-W", -0.3)]


def chain(spark):
    return S.load_chain(spark.createDataFrame(STATE, "attr string, label string, w double"), spark.createDataFrame(TRANS, "src string, dst string, w double"))


def dialogues(spark, sf_dir):
    """(conv_id, feats): of each turn its role and whether it is long."""
    one = F.struct("turn", F.array(F.concat(F.lit("r="), F.col("role")), F.concat(F.lit("long="), (F.length("text") > 200).cast("int").cast("string"))).alias("f"))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["f"]).alias("feats"))


STEPS = """
WITH RECURSIVE e AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k,
  CASE role WHEN 'user' THEN 1.0 WHEN 'assistant' THEN 0.1 ELSE 0 END + CASE WHEN length(text) > 200 THEN 0 ELSE 0.3 END AS b, CASE role WHEN 'user' THEN 0.2 WHEN 'assistant' THEN 0.7 ELSE 0 END + CASE WHEN length(text) > 200 THEN 0.45 ELSE 0 END AS i FROM conversations),
v AS (SELECT conv_id, k, b::DOUBLE AS sb, i::DOUBLE AS si, ['B-W'] AS pb, ['I-W'] AS pi FROM e WHERE k = 1
  UNION ALL SELECT v.conv_id, e.k, e.b + CASE WHEN sb - 0.3 >= si THEN sb - 0.3 ELSE si END, e.i + CASE WHEN sb + 0.5 >= si - 0.2 THEN sb + 0.5 ELSE si - 0.2 END,
    list_append(CASE WHEN sb - 0.3 >= si THEN pb ELSE pi END, 'B-W'), list_append(CASE WHEN sb + 0.5 >= si - 0.2 THEN pb ELSE pi END, 'I-W') FROM v JOIN e ON e.conv_id = v.conv_id AND e.k = v.k + 1)
"""


@query(STEPS + "SELECT conv_id, array_to_string(CASE WHEN sb >= si THEN pb ELSE pi END, ' ') AS tags FROM v QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY k DESC) = 1")
def crf_decode(spark, sf_dir):
    return S.decode(dialogues(spark, sf_dir), chain(spark)).select("conv_id", F.array_join("tags", " ").alias("tags"))


@query("""
WITH RECURSIVE e AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, count(*) OVER (PARTITION BY conv_id) AS n,
  CASE role WHEN 'user' THEN 1.0 WHEN 'assistant' THEN 0.1 ELSE 0 END + CASE WHEN length(text) > 200 THEN 0 ELSE 0.3 END AS b, CASE role WHEN 'user' THEN 0.2 WHEN 'assistant' THEN 0.7 ELSE 0 END + CASE WHEN length(text) > 200 THEN 0.45 ELSE 0 END AS i FROM conversations),
f AS (SELECT conv_id, k, n, exp(b::DOUBLE) AS fb, exp(i::DOUBLE) AS fi FROM e WHERE k = 1
  UNION ALL SELECT f.conv_id, e.k, f.n, exp(e.b) * (fb * exp(-0.3) + fi), exp(e.i) * (fb * exp(0.5) + fi * exp(-0.2)) FROM f JOIN e ON e.conv_id = f.conv_id AND e.k = f.k + 1),
g AS (SELECT conv_id, k, 1.0::DOUBLE AS gb, 1.0::DOUBLE AS gi FROM e WHERE k = n
  UNION ALL SELECT g.conv_id, g.k - 1, exp(-0.3) * exp(e.b) * gb + exp(0.5) * exp(e.i) * gi, exp(e.b) * gb + exp(-0.2) * exp(e.i) * gi FROM g JOIN e ON e.conv_id = g.conv_id AND e.k = g.k WHERE g.k > 1)
SELECT conv_id, (k - 1)::INT AS pos, round(fb * gb / (fb * gb + fi * gi), 9) AS begins FROM f JOIN g USING (conv_id, k)""")
def crf_marginals(spark, sf_dir):
    """The chance of the first label at each turn."""
    m = S.marginals(dialogues(spark, sf_dir), chain(spark))
    return m.select("conv_id", F.posexplode("marginals").alias("pos", "p")).select("conv_id", "pos", F.round(F.get("p", F.lit(0)), 9).alias("begins"))


@query(r"""
WITH t AS (SELECT item_id, regexp_extract_all(text, '[\p{L}\p{N}_]+') AS w FROM benchmark)
SELECT item_id, ((k - 1) * 100)::INT AS start, w[k] AS word, 'E' || (k - 1) % 3 AS entity, ((k - 1) * 100 + length(w[k]))::INT AS last FROM t, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS k)""")
def wordpiece_merge(spark, sf_dir):
    """Words cut into pieces of four letters, the later ones led by ##, and put together again where they are."""
    w = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(X.simple_tokens("text")).alias("p", "w"))
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.length("w") - 1) / 4).cast("int")), lambda k: F.struct((F.col("p") * 100 + k * 4).alias("start"), F.concat(F.when(k > 0, "##").otherwise(""), F.substring("w", k * 4 + 1, F.lit(4))).alias("piece"), F.when(k > 0, "X").otherwise(F.concat(F.lit("E"), (F.col("p") % 3).cast("string"))).alias("entity"), F.least(F.col("p") * 100 + k * 4 + 4, F.col("p") * 100 + F.length("w")).alias("end")))
    pieces = w.groupBy("item_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("p", cut.alias("x")))), lambda v: v["x"])).alias("pieces"))
    return pieces.select("item_id", F.explode(S.merged_pieces(F.col("pieces"))).alias("x")).select("item_id", "x.*")
