"""SQL surface: ``register(spark)`` adds scalar functions and table functions for LATERAL joins."""

from __future__ import annotations

import typing
import unicodedata
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql.functions import pandas_udf, udtf

from loomtext.functions import tables as T
from loomtext.functions import text as X

_HINTS = {str: "string", int: "long", float: "double", bool: "boolean", bytes: "binary"}


def sql_type(hint) -> str:
    """The Spark type of a Python type hint; Optional is its own type, as every column may be null."""
    origin, args = typing.get_origin(hint), typing.get_args(hint)
    if origin in (list, tuple):
        return f"array<{sql_type(args[0])}>"
    if origin is dict:
        return f"map<{sql_type(args[0])},{sql_type(args[1])}>"
    if origin is typing.Literal:
        return sql_type(type(args[0]))
    if args and type(None) in args:
        return sql_type(next(a for a in args if a is not type(None)))
    return _HINTS[hint]


def register_function(spark: SparkSession, f: Callable, name: str | None = None) -> None:
    """A user's Python function as an Arrow-batched SQL function, typed by its hints."""
    out = sql_type(typing.get_type_hints(f)["return"])

    @pandas_udf(out)
    def run(*columns):
        import pandas as pd

        return pd.Series([f(*row) for row in zip(*columns)], dtype=object)

    spark.udf.register(name or f.__name__, run)


def _as_udf(spark: SparkSession, name: str, out: str, one: Callable) -> None:
    @pandas_udf(out)
    def run(v):
        import pandas as pd

        return pd.Series([one(x) for x in v], dtype=object)

    spark.udf.register(name, run)


def register(spark: SparkSession, abbreviations=T.ABBREVIATIONS) -> None:
    """Scalar: nfc, strip_marks, vi_remove_tone, sent_tokenize, regex_tokenize. Table: tokens(text), sentences(text)."""
    known = frozenset(a.lower() for a in abbreviations)
    plain = str.maketrans(*X._tone_pairs())
    nfc = lambda x: None if x is None else unicodedata.normalize("NFC", x)
    _as_udf(spark, "nfc", "string", nfc)
    _as_udf(spark, "strip_marks", "string", lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)).replace("đ", "d").replace("Đ", "D"))
    _as_udf(spark, "vi_remove_tone", "string", lambda x: None if x is None else x.translate(plain))
    _as_udf(spark, "sent_tokenize", "array<string>", lambda x: X.split_sentences(x, known))
    _as_udf(spark, "regex_tokenize", "array<string>", lambda x: [t for t, _ in X.tokenize(nfc(x))])

    @udtf(returnType=S.StructType().add("pos", S.IntegerType()).add("token", S.StringType()).add("cls", S.StringType()))
    class Tokens:
        def eval(self, text: str) -> Iterator[tuple]:
            for k, (t, c) in enumerate(X.tokenize(nfc(text))):
                yield k, t, c

    @udtf(returnType=S.StructType().add("pos", S.IntegerType()).add("sentence", S.StringType()))
    class Sentences:
        def eval(self, text: str) -> Iterator[tuple]:
            yield from enumerate(X.split_sentences(text, known))

    spark.udtf.register("tokens", Tokens)
    spark.udtf.register("sentences", Sentences)


def ascii_table(rows: list[list], headers: list[str]) -> str:
    """Rows under headers, in columns as wide as their widest cell."""
    cells = [[str(c) for c in r] for r in [headers, *rows]]
    wide = [max(len(r[k]) for r in cells) for k in range(len(headers))]
    line = "+" + "+".join("-" * (w + 2) for w in wide) + "+"
    body = ["|" + "|".join(f" {c:<{w}} " for c, w in zip(r, wide)) + "|" for r in cells]
    return "\n".join([line, body[0], line, *body[1:], line])


def describe(spark: SparkSession):
    """The registered functions, for a catalogue."""
    return spark.sql("SHOW USER FUNCTIONS").orderBy(F.col("function"))
