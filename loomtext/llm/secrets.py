"""Secret scans through a trigram inverted index, in DataFrame operations only.

Each rule's regular expression is turned into a Boolean query over lower-case trigrams (any of several sets, all
trigrams of a set). Postings (trigram, document) are made for every trigram that some rule asks for, intersected per
document, and give candidate documents; the expression then verifies those on whole texts. A rule without mandatory
trigrams scans every document. A candidate set is a superset by construction, so the index never loses a match.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import materialize

_parser = re._parser


@dataclass(frozen=True)
class Rule:
    """``pattern``: for Java's and Python's engine alike; a match counts if its ``group`` has ``least`` characters or more."""

    name: str
    pattern: str
    group: int = 0
    least: int = 1


#: The assigned value is group 2; keys and hexadecimal runs state their length in the pattern, which finds the same runs
#: as the plain runs do before the short ones are dropped, since no run can start later and be longer.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Formats that are told by their prefixes: private keys, tokens of forges, chats, maps and payments, signed web tokens.
EXTRA = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("forge", r"gh[opsru]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("maps", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("payment", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*"),
)
RULES = BASE + EXTRA
#: Candidate ids are broadcast up to this number (8 MB); beyond it the join is shuffled.
BROADCAST_IDS = 1_000_000
#: Columns of the candidate table, under names that no input has.
_ID, _FOUND = "__loomtext_secrets_id", "__loomtext_secrets_rules"

Query = frozenset[frozenset[str]]
_ALL: Query = frozenset([frozenset()])


def _grams(s: str) -> frozenset[str]:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def _rarity(g: str) -> tuple[int, str]:
    """Rare trigrams first, by how common their letters are; anything but a letter is rare."""
    return sum("zqxjkvbpygfwmucldrhsnioate".find(c) for c in g), g


def _both(a: Query, b: Query) -> Query:
    return frozenset(x | y for x, y in product(a, b))


def trigram_query(pattern: str, most: int = 64) -> Query:
    """Sets of lower-case trigrams of which one must lie whole in the lower-cased text; one empty set: nothing is mandatory."""

    def node(items) -> list:
        """A sequence of frozensets of exact strings, or None where anything may stand."""
        out: list = []
        for op, arg in items:
            name = str(op)
            if name == "LITERAL":
                c = chr(arg).lower()
                out.append(frozenset([c]) if ord(c) < 128 else None)
            elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
                out.append(frozenset(chr(v).lower() for _, v in arg))
            elif name == "SUBPATTERN":
                out += node(arg[3])
            elif name == "BRANCH":
                sides = [flat(node(x)) for x in arg[1]]
                out.append(None if any(x is None for x in sides) else frozenset().union(*sides))
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[1] == 1 and (x := flat(node(arg[2]))) is not None:
                out.append(x | {""})
            else:
                out.append(None)
        return out

    def flat(parts: list) -> frozenset | None:
        whole = frozenset([""])
        for p in parts:
            if p is None or len(whole) * len(p) > most:
                return None
            whole = frozenset(a + b for a, b in product(whole, p))
        return whole

    query, run = _ALL, frozenset([""])
    for part in [*node(_parser.parse(pattern)), None]:
        if part is not None and len(run) * len(part) <= most:
            run = frozenset(a + b for a, b in product(run, part))
            continue
        if all(len(x) >= 3 for x in run):
            query = _both(query, frozenset(_grams(x) for x in run))
        run = part or frozenset([""])
    return frozenset(q for q in query if not any(o < q for o in query))


def candidates(docs: DataFrame, rules: tuple[Rule, ...], id_col: str, text_col: str) -> DataFrame:
    """(_ID, _FOUND): for documents that may match an indexed rule, the names of those rules."""
    spark = docs.sparkSession
    wanted = [(r.name, k, sorted(q, key=_rarity)) for r in rules for k, q in enumerate(sorted(map(sorted, trigram_query(r.pattern)))) if q]
    first: dict[str, list[str]] = {}
    for _, _, q in wanted:
        first[q[0]] = sorted({*first.get(q[0], []), *q[1:]}, key=_rarity)
    # Lowered in a projection of its own: once a text, not once a trigram.
    low = docs.select(F.col(id_col).alias(_ID), F.lower(F.col(text_col)).alias("low"))
    # The rarest trigram of a set is looked for first; postings of its others are only made where it is found.
    posting = lambda g: F.when(F.contains("low", F.lit(g)), F.lit(g))
    under = [F.when(F.contains("low", F.lit(g)), F.array(F.lit(g), *map(posting, rest))) for g, rest in sorted(first.items())]
    postings = low.select(_ID, F.explode(F.array_compact(F.flatten(F.array_compact(F.array(*under))))).alias("gram"))
    asked = spark.createDataFrame([(g, name, k, 1 << i, (1 << len(q)) - 1) for name, k, q in wanted for i, g in enumerate(q)], "gram string, rule string, k int, bit long, need long")
    met = postings.join(F.broadcast(asked), "gram").groupBy(_ID, "rule", "k").agg(F.bit_or("bit").alias("have"), F.max("need").alias("need")).where("have = need")
    return met.groupBy(_ID).agg(F.collect_set("rule").alias(_FOUND))


#: Matches of a text that are walked at once: a running list is copied with each of its items, so it is kept to a block.
BLOCK = 256
_KIND = "array<struct<start:bigint,kind_no:int,end:bigint,kind:string>>"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _blocks(items: Column, fold) -> Column:
    """array<struct<items, at, then>>: blocks of BLOCK items with the running value from 0 before and after each."""
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int")), lambda j: F.slice(items, j * BLOCK + 1, F.lit(BLOCK)))

    def step(acc: Column, b: Column) -> Column:
        then = F.aggregate(b, acc["at"], fold)
        return F.struct(then.alias("at"), F.concat(acc["out"], F.array(then)).alias("out"))

    def zipped(bs: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("at"), F.array(F.lit(0).cast("long")).alias("out"))
        at = F.aggregate(bs, start, step, lambda acc: acc["out"])
        return _let(at, lambda t: F.transform(bs, lambda b, j: F.struct(b.alias("items"), F.get(t, j).alias("at"), F.get(t, j + 1).alias("then"))))

    return _let(cut, zipped)


def _running(items: Column, fold, emit, kind: str) -> Column:
    """``emit(before, item)`` of each item, of type ``kind``; ``before`` is the fold from 0 over the items before it. Not for empty arrays."""

    def one(b: Column) -> Column:
        step = lambda acc, x: F.struct(fold(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(emit(acc["at"], x).cast(kind))).alias("out"))
        return F.aggregate(b["items"], F.struct(b["at"].alias("at"), F.array().cast(f"array<{kind}>").alias("out")), step, lambda acc: acc["out"])

    return _let(items, lambda xs: F.flatten(F.transform(_blocks(xs, fold), one)))


def _spans(text: Column, rule: Rule, order: int, likely: bool) -> Column:
    """Structs (start, kind_no, end, kind) of a rule's matches; code points, end exclusive. Texts that aren't ``likely`` to match are asked first."""
    pat = F.lit(rule.pattern)
    none = F.array().cast(_KIND)

    def walk(m: Column) -> Column:
        kept = lambda h: F.length(F.regexp_extract(h, rule.pattern, rule.group)) >= rule.least if rule.group else F.length(h) >= rule.least
        sized = F.transform(m["hits"], lambda h, i: F.struct(F.length(F.get(m["gaps"], i)).alias("gap"), F.length(h).alias("n"), kept(h).alias("ok")))
        span = lambda at, x: F.struct((at + x["gap"]).alias("start"), F.lit(order).alias("kind_no"), (at + x["gap"] + x["n"]).alias("end"), F.lit(rule.name).alias("kind"))
        made = _running(sized, lambda at, x: at + x["gap"] + x["n"], lambda at, x: F.struct(span(at, x).alias("span"), x["ok"].alias("ok")), f"struct<span:{_KIND[6:-1]},ok:boolean>")
        return F.transform(F.filter(made, lambda x: x["ok"]), lambda x: x["span"])

    # Bound once by a lambda: each regular expression runs once over a text for its matches and, where there are some, once for what stands between.
    gaps = lambda hits: F.struct(hits.alias("hits"), F.split(text, rule.pattern, -1).alias("gaps"))
    found = _let(F.regexp_extract_all(text, pat, F.lit(0)), lambda hits: F.when(F.size(hits) > 0, _let(gaps(hits), walk)).otherwise(none))
    return found if likely else F.when(text.rlike(rule.pattern), found).otherwise(none)


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", out: str = "spans") -> DataFrame:
    """``docs`` with a column ``out``: array of (start, kind_no, end, kind) over the whole text, by start, then rule order.

    Matches are leftmost and non-overlapping within a rule; rules may overlap each other. A null text counts as empty and
    has no spans. Ids may be null or repeated: candidates are looked up by id and verified on each row's own text, so every
    row keeps its own spans. Extra columns stay; an input column named as ``out`` is replaced.
    """
    base = docs.drop(out)
    indexed = tuple(r for r in rules if frozenset() not in trigram_query(r.pattern))
    text = F.coalesce(F.col(text_col), F.lit(""))
    if indexed:
        found = materialize(candidates(base.select(id_col, text_col), indexed, id_col, text_col))
        side = F.broadcast(found) if found.count() <= BROADCAST_IDS else found
        base = base.join(side, F.col(id_col).eqNullSafe(F.col(_ID)), "left")
    parts = []
    for k, r in enumerate(rules):
        spans = _spans(text, r, k, r in indexed)
        parts.append(F.when(F.array_contains(_FOUND, r.name), spans).otherwise(F.array().cast(_KIND)) if r in indexed else spans)
    return base.withColumn(out, F.array_sort(F.concat(*parts))).drop(_ID, _FOUND)


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span of a secret cut out of the text and [SECRET] put there; overlapping spans are one.

    Documents without secrets, null texts included, are left as they are. All rows stay.
    """
    own = "__loomtext_secrets_spans"
    found = scan_secrets(docs, rules, id_col, text_col, own)

    furthest = lambda at, x: F.greatest(at, x["end"])
    part = lambda t, at, to: F.substring(t, (at + 1).cast("int"), (to - at).cast("int"))

    def pieces(b: Column) -> Column:
        """A block's stretch of the text, cut out once, and from it what stands before each secret."""

        def step(t: Column) -> Column:
            put = lambda at, x: F.when(x["start"] >= at, F.concat(part(t, at - b["at"], x["start"] - b["at"]), F.lit("[SECRET]"))).otherwise("")
            return F.aggregate(b["items"], F.struct(b["at"].alias("at"), F.array().cast("array<string>").alias("out")), lambda acc, x: F.struct(furthest(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(put(acc["at"], x))).alias("out")), lambda acc: F.array_join(acc["out"], ""))

        return _let(part(F.col(text_col), b["at"], b["then"]), step)

    rest = lambda bs: F.substring(F.col(text_col), (F.element_at(bs, -1)["then"] + 1).cast("int"), F.lit(2147483647))
    cut = _let(_blocks(F.col(own), furthest), lambda bs: F.concat(F.array_join(F.transform(bs, pieces), ""), rest(bs)))
    return found.withColumn(text_col, F.when(F.size(own) > 0, cut).otherwise(F.col(text_col))).select(*[F.col(f"`{c}`") for c in docs.columns])
