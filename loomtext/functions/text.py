"""Scalar text functions as Column builders: Unicode, normalization, tokens, letters and sounds.

Everything that Spark's own functions can say is said with them. NFC/NFKD, the class-tagging tokenizer and the sentence
splitter are Arrow-batched UDFs, marked non-deterministic so that Catalyst evaluates them once.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache, reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf, pandas_udf
from pyspark.sql.types import StringType

from loomtext.functions import tables as T


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# --- Unicode ---------------------------------------------------------------------------------------------------------


def _normalizer(form: str):
    def run(v: pa.Array) -> pa.Array:
        is_in, to = unicodedata.is_normalized, unicodedata.normalize
        return pa.array([x if x is None or is_in(form, x) else to(form, x) for x in v.to_pylist()], pa.string())

    return arrow_udf(run, StringType())


# Non-deterministic for Catalyst: never evaluated twice, never moved into a lambda.
nfc, nfkc, nfkd = (_normalizer(f).asNondeterministic() for f in ("NFC", "NFKC", "NFKD"))


def strip_diacritics(c) -> Column:
    """NFKD without combining marks; đ becomes d."""
    return F.translate(F.regexp_replace(nfkd(_col(c)), r"\p{M}", ""), "đĐ", "dD")


def normalize_key(c) -> Column:
    """Lower case, trimmed, without marks, only a-z and 0-9."""
    return F.regexp_replace(strip_diacritics(F.trim(F.lower(_col(c)))), "[^a-z0-9]", "")


@cache
def _tone_pairs() -> tuple[str, str]:
    plain = dict(zip(T.MARKED, T.PLAIN))
    a, b = "", ""
    for toned in T.TONES.values():
        a += toned
        b += "".join(plain.get(x, x) for x in T.LEVEL)
    a, b = a + T.MARKED, b + T.PLAIN
    return a + a.upper(), b + b.upper()


def remove_tone(c) -> Column:
    """Vietnamese letters without tones and marks, one for one; anything else is left."""
    return F.translate(_col(c), *_tone_pairs())


def without_tone(c) -> Column:
    """Lower-case vowels without tone; ă, â, ê, ô, ơ, ư stay."""
    return F.translate(_col(c), "".join(T.TONES.values()), T.LEVEL * len(T.TONES))


def tone(c) -> Column:
    """level, falling, rising, dipping, broken or heavy, by the last vowel that bears a tone."""
    last = F.regexp_extract(_col(c), f"(?s).*([{''.join(T.TONES.values())}])", 1)
    out = F.lit("level")
    for name, letters in T.TONES.items():
        out = F.when(last.rlike(f"^[{letters}]$"), F.lit(name)).otherwise(out)
    return out


# --- normalization ---------------------------------------------------------------------------------------------------


def replace_in_order(c, rules: list[tuple[str, str]]) -> Column:
    """Replacements one after another, each over the result of those before."""
    return reduce(lambda x, r: F.replace(x, F.lit(r[0]), F.lit(r[1])), rules, _col(c))


def literal_map(m: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in m.items() for x in kv])


def normalize_token(c, chars: list[tuple[str, str]], tokens: dict[str, str], character_normalize: bool = True) -> Column:
    """Tokens of more than 6 characters are left; others are composed, character-mapped and looked up whole."""
    t = _col(c)
    n = replace_in_order(nfc(t), chars) if character_normalize else t
    if tokens:
        n = F.coalesce(F.try_element_at(literal_map(tokens), n), n)
    return F.when(F.length(t) > 6, t).otherwise(n)


def expand_abbreviations(c, rules: dict[str, str] | None = None) -> Column:
    """Lower case, trimmed, abbreviations replaced wherever they stand, longest first, trimmed."""
    rules = T.ADDRESS_ABBREVIATIONS if rules is None else rules
    return F.trim(replace_in_order(F.trim(F.lower(_col(c))), sorted(rules.items(), key=lambda x: -len(x[0]))))


TRIMMED = ".,!?;:"


def preprocess_words(text, lowercase=True, urls=True, repeats=True, punct=True, teencode: dict[str, str] | None = T.TEENCODE) -> Column:
    """The words of a composed social-media text: lower case, without URLs, letters repeated twice at most, marks
    squeezed, shorthand spelled out. A word is looked up without the marks around it, which a hit drops."""
    c = _col(text)
    c = F.lower(c) if lowercase else c
    c = F.regexp_replace(c, r"https?://\S+|www\.\S+", " ") if urls else c
    c = F.regexp_replace(c, r"([^\p{Punct}])\1{2,}", "$1$1") if repeats else c
    if punct:
        c = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "!{2,}", "!"), r"\?{2,}", "?"), r"\.{4,}", "...")
    w = F.filter(F.split(c, r"(?U)\s+"), lambda x: x != "")
    if teencode:
        known = literal_map(teencode)
        w = F.transform(w, lambda x: F.coalesce(F.try_element_at(known, trim_marks(x)), x))
    return w


def trim_marks(x: Column) -> Column:
    return F.regexp_replace(x, rf"^[{TRIMMED}]+|[{TRIMMED}]+$", "")


def mark_negation(words: Column, negations=T.NEGATIONS, window: int = 2) -> Column:
    """NEG_ before each of the ``window`` words after a negation; scopes are read off the unmarked words, so none doubles."""
    both = F.struct(words.alias("w"), F.transform(words, lambda x: trim_marks(x).isin(*negations)).alias("neg"))

    def mark(s: Column) -> Column:
        near = lambda i: F.slice(s["neg"], F.greatest(i - window, F.lit(0)) + 1, F.least(i, F.lit(window)))
        return F.transform(s["w"], lambda x, i: F.when(F.exists(near(i), lambda f: f), F.concat(F.lit("NEG_"), x)).otherwise(x))

    return let(both, mark)


def with_social_preprocess(df: DataFrame, text: str, out: str, negations=T.NEGATIONS, window: int = 2, unicode: bool = True, **kw) -> DataFrame:
    """Add ``out``, the preprocessed text. Stages are columns of their own: an Arrow UDF can't feed a lambda directly."""
    d = df.withColumn("_c", nfc(text) if unicode else F.col(text)).withColumn("_w", preprocess_words("_c", **kw))
    return d.withColumn(out, F.array_join(mark_negation(F.col("_w"), negations, window) if negations else F.col("_w"), " ")).drop("_c", "_w")


def tts_text(c) -> Column:
    """Compatibility-composed lower case with pauses for punctuation."""
    x = F.lower(nfkc(_col(c)))
    x = F.regexp_replace(x, r"[\n.,:]+", " sil ")
    x = F.replace(x, F.lit('"'), F.lit(" "))
    x = F.regexp_replace(x, r"\s+", " ")
    x = F.regexp_replace(x, r"[.,:;?!]+", " sil ")
    x = F.regexp_replace(x, r"[ ]+", " ")
    return F.trim(F.regexp_replace(x, r"( sil+ )+", " sil "))


def safe_filename(url, suffix: str = ".md", most: int = 80) -> Column:
    """Host and path with anything but word characters and hyphens as single underscores, cut to ``most``."""
    u = _col(url)
    name = F.regexp_extract(u, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://)?([^?#]*)", 1)
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"(?U)[^\w\-]", "_"), "^_+|_+$", ""), "_+", "_")
    return F.concat(F.substring(name, 1, most), F.lit(suffix))


def slug(c, most: int = 50) -> Column:
    return F.regexp_replace(F.substring(F.regexp_replace(_col(c), r"(?U)[^\w]", "_"), 1, most), "^_+|_+$", "")


def url_type(url) -> Column:
    low = F.lower(_col(url))
    path = F.lower(F.regexp_extract(_col(url), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1))
    has = lambda *xs: reduce(lambda a, b: a | b, [F.contains(low, F.lit(x)) for x in xs])
    return (
        F.when(has("twitter.com", "x.com"), "tweet")
        .when(has("arxiv.org"), "arxiv")
        .when(has("github.com"), "github")
        .when(has("youtube.com", "youtu.be"), "youtube")
        .when(path.endswith(".pdf"), "pdf")
        .when(path.rlike(r"\.(png|jpg|jpeg|webp|gif)$"), "image")
        .otherwise("webpage")
    )


# --- letters ----------------------------------------------------------------------------------------------------------


def is_title(c) -> Column:
    """Each space-separated part starts with a character that is its own upper case."""
    return F.forall(F.split(_col(c), " "), lambda p: F.substring(p, 1, 1) == F.upper(F.substring(p, 1, 1)))


def is_digit(c) -> Column:
    """A whole 32-bit number, a sign allowed."""
    x = _col(c)
    return x.rlike(r"^[+-]?[0-9]+$") & F.coalesce(x.try_cast("decimal(38,0)").between(-(2**31), 2**31 - 1), F.lit(False))


def is_all_caps(c) -> Column:
    return F.forall(F.split(_col(c), ""), lambda x: x == F.upper(x))


def is_punct(c) -> Column:
    return _col(c).rlike(r"^\p{P}+$")


def is_latin(c) -> Column:
    """Every character is of the Latin script; true for an empty text."""
    return _col(c).rlike(r"^\p{IsLatin}*$")


def half_width(c) -> Column:
    """Compatibility forms, full-width letters among them, as their plain ones (NFKC)."""
    return _normalizer("NFKC")(_col(c))


def is_full_width(c) -> Column:
    """Every character is wide, full-width or of ambiguous width."""

    @F.pandas_udf("boolean")
    def run(v: pd.Series) -> pd.Series:
        from unicodedata import east_asian_width

        return pd.Series([None if x is None else all(east_asian_width(ch) in "WFA" for ch in x) for x in v], dtype=object)

    return run(_col(c))


#: Rhymes by spelling. <...> is a vowel with any tone, <...!> one with an acute or a dot only.
RHYMES = (
    "<aeêioôơuưy>", "<o>[ae]", "<u>[êy]", "o<ae>", "u<êy>",
    "(<ăâeou!>|i<ê!>|o?<a!>|u?<ô!>|ư<ơ!>)[cpt]", "<êiơ!>[pt]", "(<ư!>|o<ă!>)[ct]", "o<o!>c", "(o<e!>|u<â!>|uy<ê!>?)t", "(<êi!>|o?<a!>|u<êy!>)ch",
    "(<iuư>|uy)a", "(<ouư>|o?<a>|u?<ô>|ư?<ơ>)i", "o?<ae>o", "(<aâiư>|u<y>|ư<ơ>|i?<ê>)u", "(o?<a>|u?<â>)y",
    "(<âeouư>|o?<aă>|i<ê>|u?<ô>|ư<ơ>)(m|ng?)", "(<êiơ>|o<e>)[mn]", "u<â>ng?", "uy<ê>?n", "o<o>ng", "(<êi>|o?<a>|u<êy>)nh",
)


def rhyme_pattern() -> str:
    """All rhymes as one pattern; letters with tones are composed from their base letter and the tone's mark."""
    from unicodedata import normalize

    def letters(m: re.Match) -> str:
        marks = ["\u0301", "\u0323"] if m[2] else ["", "\u0300", "\u0301", "\u0309", "\u0303", "\u0323"]
        return "[" + "".join(normalize("NFC", b + t) for b in m[1] for t in marks) + "]"

    return "^(?:" + "|".join(re.sub(r"<([^<>!]+)(!?)>", letters, p) for p in RHYMES) + ")$"


def rhyme(c) -> Column:
    """A valid rhyme without its tone; null for any other text."""
    x = _col(c)
    return F.when(x.rlike(rhyme_pattern()), without_tone(x))


def match_case(shape, word) -> Column:
    """``word`` in the case of ``shape``: all capitals, a capital first, or as it is."""
    s, w = _col(shape), _col(word)
    caps = (F.upper(s) == s) & (F.lower(s) != s)
    first = F.substring(s, 1, 1)
    return F.when(caps & (F.length(s) > 1), F.upper(w)).when((F.upper(first) == first) & (F.lower(first) != first), F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 2147483647))).otherwise(w)


def phonemes(words, lexicon: dict[str, str]) -> Column:
    """Array of sounds of an array of words: as the lexicon says, else letter by letter."""
    known = literal_map(lexicon)
    return F.flatten(F.transform(_col(words), lambda w: F.coalesce(F.split(F.try_element_at(known, w), " "), F.split(w, ""))))


def vi_sort_key(c) -> Column:
    """Ranks of the letters in the Vietnamese alphabet; null for any other character."""
    return F.transform(F.split(_col(c), ""), lambda x: F.nullif(F.instr(F.lit(T.ALPHABET), x), F.lit(0)) - 1)


# --- sounds -------------------------------------------------------------------------------------------------------------

_CONS = "gi|qu|ch|gh|kh|ng|ngh|nh|ph|th|tr|[bcdđghklmnpqrstvx]"
_C1, _C2 = f"({_CONS})?", f"({_CONS}|[uio])?"
_VOWEL = "([aăâeêuưyoôơi]|oo|i[aăâ]|iê|yê|y[aăâ]|[uư][oôơ]|[uư][aăâ]|ay|ây|ua)"
_SHAPES = [f"^{_C1}(u)([yâ]){_C2}$", f"^{_C1}(o)([eaă]){_C2}$", f"^{_C1}(){_VOWEL}{_C2}$", f"^{_C1}(u)(ê){_C2}$", f"^{_C1}(u)(yê){_C2}$", f"^{_C1}(u)(y[aăâ]){_C2}$"]


def syllable_parts(c) -> Column:
    """struct(onset, glide, vowel, coda) of a lower-case syllable, without tone; null where no shape fits."""
    x = without_tone(_col(c))
    out = F.lit(None).cast("struct<onset:string,glide:string,vowel:string,coda:string>")
    for shape in reversed(_SHAPES):
        got = F.struct(*[F.regexp_extract(x, shape, k + 1).alias(n) for k, n in enumerate(("onset", "glide", "vowel", "coda"))])
        out = F.when(x.rlike(shape), got).otherwise(out)
    return out


def syllable_ipa(c, dialect: str = "north", eight: bool = False, tones: str = "number") -> Column:
    """The sounds of a syllable; empty where it has no known shape or sound."""
    get = lambda m, k: F.try_element_at(literal_map(m), k)
    raw = F.struct(syllable_parts(c).alias("p"), tone(c).alias("t"))

    def sounds(x: Column) -> Column:
        onset, vowel, coda = x["p"]["onset"], x["p"]["vowel"], x["p"]["coda"]
        double = (vowel == "o") & (coda == "o")
        nuc = F.when((vowel == "a") & (coda == "u"), F.lit("a")).when(double, F.lit("ↄ:")).otherwise(get(T.NUCLEI, vowel))
        cod = F.when((coda == "") | double, F.lit("")).otherwise(get(T.CODAS, coda))
        ons = F.when(onset == "", F.lit("")).otherwise(get(T.ONSETS, onset))
        return F.struct(ons.alias("ons"), x["p"]["glide"].alias("glide"), nuc.alias("nuc"), cod.alias("cod"), x["t"].alias("t"))

    def onsets(x: Column) -> Column:
        nuc = F.when((x["ons"] == "z") & (x["nuc"] == "e"), F.lit("iə")).otherwise(x["nuc"])
        ons = F.when((x["ons"] == "ɣ") & (x["nuc"] == "i"), F.lit("z")).when(x["ons"] == "", F.lit("ʔ")).when(x["ons"] == "ʂ", F.lit("s"))
        if dialect == "north":
            ons = ons.when(x["ons"].isin("j", "r"), F.lit("z")).when(x["ons"].isin("c", "ʈ"), F.lit("tɕ"))
        cod = x["cod"]
        if dialect == "south":
            back = nuc.isin("u", "o", "ↄ")
            cod = F.when(back & (cod == "ŋ"), F.lit("ŋ͡m")).when(back & (cod == "k"), F.lit("k͡p")).otherwise(cod)
        return F.struct(ons.otherwise(x["ons"]).alias("ons"), x["glide"].alias("glide"), nuc.alias("nuc"), cod.alias("cod"), x["t"].alias("t"))

    def rhymes(x: Column) -> Column:
        nuc, cod = x["nuc"], x["cod"]
        velar = cod.isin("ŋ", "k")
        nuc = (
            F.when(velar & (nuc == "ɛ"), F.lit("ɛː"))
            .when(velar & (nuc == "e"), F.lit("eː"))
            .when((nuc == "aː") & cod.isin("c", "ɲ"), F.lit("ɛ"))
            .when((cod == "") & (nuc == "aː"), F.lit("a"))
            .when((cod == "") & (nuc == "əː"), F.lit("ə"))
            .otherwise(nuc)
        )
        cod = F.when(cod == "c", F.lit("k")).when(cod == "ɲ", F.lit("ŋ")).otherwise(cod)
        ton = get(T.TONE_NUMBERS if tones == "number" else T.TONE_LETTERS, x["t"])
        if eight:
            stop = cod.isin("p", "t", "k")
            ton = F.when(stop & (x["t"] == "rising"), F.lit("⁴⁵")).when(stop & (x["t"] == "heavy"), F.lit("²¹")).otherwise(ton)
        return F.concat(x["ons"], F.when(x["glide"] == "", F.lit("")).otherwise(F.lit("ʷ")), nuc, cod, ton)

    return F.coalesce(let(let(let(raw, sounds), onsets), rhymes), F.lit(""))


# --- tokens and sentences -------------------------------------------------------------------------------------------------

WORD = r"[\p{L}\p{N}_]+"


def simple_tokens(c) -> Column:
    return F.regexp_extract_all(_col(c), F.lit(WORD), F.lit(0))


def lower_tokens(c) -> Column:
    return F.transform(simple_tokens(c), F.lower)


def wrapped(tokens: Column) -> Column:
    """Each token as a list of its own."""
    return F.transform(tokens, lambda x: F.array(x))


def space_tokens(c) -> Column:
    return F.filter(F.split(_col(c), r"\s+"), lambda x: x != "")


def word_ngrams(tokens: Column, low: int = 1, high: int = 2) -> Column:
    """All n-grams of low to high tokens, space-joined."""
    parts = []
    for n in range(low, high + 1):
        starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - (n - 1))).otherwise(F.array().cast("array<int>"))
        parts.append(F.transform(starts, _gram(tokens, n)))
    return F.concat(*parts)


def _gram(tokens: Column, n: int):
    return lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " ")


def char_ngrams(c, n: int = 3) -> Column:
    """Character n-grams; a shorter text is its own."""
    x = _col(c)
    cut = lambda i: F.substring(x, i, F.lit(n))
    return F.when(F.length(x) < n, F.array(x)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - (n - 1), F.lit(1))), cut))


def subword_ngrams(c, low: int = 3, high: int = 6) -> Column:
    """n-grams of <word> without the whole of it."""
    x = F.concat(F.lit("<"), _col(c), F.lit(">"))
    parts = []
    for n in range(low, high + 1):
        starts = F.when(F.length(x) >= n, F.sequence(F.lit(1), F.greatest(F.length(x) - (n - 1), F.lit(1)))).otherwise(F.array().cast("array<int>"))
        parts.append(F.transform(starts, _cut(x, n)))
    return F.filter(F.concat(*parts), lambda g: g != x)


def _cut(x: Column, n: int):
    return lambda i: F.substring(x, i, F.lit(n))


_ENDS = ".?!"
_BLANKS, _GAPS = re.compile(r"[ \t]*"), re.compile(r"[ \t\n\r]*")
_END_RUN, _DOTS, _END = re.compile(r"[.?!]+"), re.compile(r"\.+"), re.compile(r"[.?!]")


def split_sentences(text: str | None, abbreviations: frozenset[str]) -> list[str]:
    """Sentences by their end marks.

    Three or more dots end one at the end of the text or before a capital only. A dot between digits or after an abbreviation
    ends none. Other marks do, with those that follow. Newlines alone end nothing.
    """
    if not text or text.isspace():
        return []
    out, start, at = [], 0, 0
    while m := _END.search(text, at):
        pos = m.start()
        if text[pos] == ".":
            dots = _DOTS.match(text, pos).end()
            if dots - pos >= 3:
                nxt = _BLANKS.match(text, dots).end()
                if nxt >= len(text) or text[nxt].isupper():
                    out.append(text[start:dots].strip())
                    start = _GAPS.match(text, dots).end()
                at = dots
                continue
            inside = text[pos - 1 : pos].isdigit() and text[pos + 1 : pos + 2].isdigit()
            left = pos
            while left and (text[left - 1].isalnum() or text[left - 1] == "."):
                left -= 1
            word = text[left:pos].lower()
            if inside or len(word) == 1 and word.isascii() and word.isalpha() or word in abbreviations:
                at = pos + 1
                continue
        end = _END_RUN.match(text, pos).end()
        out.append(text[start:end].strip())
        start = at = _GAPS.match(text, end).end()
    out.append(text[start:].strip())
    return [s for s in out if s]


def sentences(c, abbreviations=T.ABBREVIATIONS) -> Column:
    known = frozenset(a.lower() for a in abbreviations)

    @pandas_udf("array<string>")
    def split(v: pd.Series) -> pd.Series:
        return pd.Series([split_sentences(t, known) for t in v], dtype=object)

    return split.asNondeterministic()(_col(c))


@cache
def _pattern(fixed: tuple[str, ...]) -> re.Pattern:
    parts = []
    if fixed:
        parts.append("(?P<fixed_words>" + "|".join(rf"\b{re.escape(w)}\b" for w in fixed) + ")")
    parts += [f"(?P<{name}>{'|'.join(alts)})" for name, alts in T.TOKEN_CLASSES.items()]
    return re.compile("|".join(parts))


def tokenize(text: str | None, fixed: tuple[str, ...] = ()) -> list[tuple[str, str]]:
    """(token, class) of a composed text; fixed words come first and are taken literally."""
    return [(m.group(), m.lastgroup) for m in _pattern(fixed).finditer(text or "")]


def regex_tokens(c, fixed: tuple[str, ...] = ()) -> Column:
    """array<struct<token, cls>>; the text is composed (NFC) first."""

    @pandas_udf("array<struct<token:string,cls:string>>")
    def run(v: pd.Series) -> pd.Series:
        return pd.Series([[{"token": t, "cls": k} for t, k in tokenize(unicodedata.normalize("NFC", x) if x else x, fixed)] for x in v], dtype=object)

    return run.asNondeterministic()(_col(c))


#: Characters of texts whose tokens leave a task at once, but for a single longer text.
TOKENIZED = 1 << 18


def regex_token_rows(docs: DataFrame, text: str, fixed: tuple[str, ...] = ()) -> DataFrame:
    """A row a token, in place of ``text``: ``pos`` from 0, token, cls, as of ``regex_tokens``.

    Tokens leave in batches of a few texts: those of all the texts that Spark hands over at once would not fit an executor.
    """
    keep = [c for c in docs.columns if c != text]
    d = docs.select(*keep, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(b: pa.RecordBatch, rows: list[int], held: list[tuple[int, str, str]]) -> pa.RecordBatch:
            pos, token, cls = zip(*held) if held else ((), (), ())
            cols = [pa.array(pos, pa.int32()), pa.array(token, pa.string()), pa.array(cls, pa.string())]
            return pa.RecordBatch.from_arrays([*[b.column(k).take(pa.array(rows, pa.int64())) for k in range(len(keep))], *cols], names=[*keep, "pos", "token", "cls"])

        for b in batches:
            rows, held, size = [], [], 0
            for i, x in enumerate(b.column(len(keep))):
                if x.as_py():
                    got = tokenize(unicodedata.normalize("NFC", x.as_py()), fixed)
                    held += [(k, t, c) for k, (t, c) in enumerate(got)]
                    rows += [i] * len(got)
                    size += len(x.as_py())
                if size >= TOKENIZED:
                    yield made(b, rows, held)
                    rows, held, size = [], [], 0
            yield made(b, rows, held)

    kinds = [f"`{c}` {d.schema[c].dataType.simpleString()}" for c in keep]
    return d.mapInArrow(run, ", ".join([*kinds, "pos int, token string, cls string"]))
