"""Wiki markup to plain text."""

from __future__ import annotations

import re
from html import unescape

from pyspark.sql import Column
from pyspark.sql import functions as F

_OPEN = re.compile(r"\{\{|\}\}|\{\||\|\}")
_STEPS = [
    (re.compile(r"<!--.*?-->", re.S), ""),
    (re.compile(r"<(ref|math|gallery|timeline|score|syntaxhighlight|nowiki)\b[^>/]*>.*?</\1\s*>|<ref\b[^>]*/>", re.S | re.I), ""),
    (re.compile(r"<[^>]+>"), ""),
    (re.compile(r"'{2,5}"), ""),
    (re.compile(r"\[https?://\S+ ([^\]]*)\]"), r"\1"),
    (re.compile(r"\[https?://\S+\]"), ""),
    (re.compile(r"^=+\s*(.*?)\s*=+\s*$", re.M), r"\1"),
    (re.compile(r"^[*#;:]+\s*", re.M), ""),
    (re.compile(r"__[A-Z]+__"), ""),
    (re.compile(r"[ \t]+"), " "),
    (re.compile(r" *\n *"), "\n"),
    (re.compile(r"\n{3,}"), "\n\n"),
]
_FILES = ("file:", "image:", "category:", "tập tin:", "hình:", "thể loại:")


def without_nested(text: str) -> str:
    """Without templates and tables, however deep they nest; an unclosed one ends with the text."""
    out, depth, at = [], 0, 0
    for m in _OPEN.finditer(text):
        opens = m.group() in ("{{", "{|")
        if depth == 0 and opens:
            out.append(text[at : m.start()])
        if opens:
            depth += 1
        elif depth:
            depth -= 1
            if depth == 0:
                at = m.end()
    if depth == 0:
        out.append(text[at:])
    return "".join(out)


def _links(text: str) -> str:
    """Links as their label; files and categories go, with links inside their captions."""
    while True:
        m = re.search(r"\[\[([^\[\]]*)\]\]([a-zà-ỹ]*)", text)
        if not m:
            return text
        body = m[1]
        keep = "" if body.strip().lower().startswith(_FILES) else body.rpartition("|")[2] + m[2]
        text = text[: m.start()] + keep + text[m.end() :]


def plain(text: str | None) -> str | None:
    if text is None:
        return None
    text = _links(without_nested(_STEPS[0][0].sub("", text)))
    for pattern, to in _STEPS[1:]:
        text = pattern.sub(to, text)
    return unescape(text).strip()


def wiki_text(c: str) -> Column:
    @F.pandas_udf("string")
    def run(v):
        import pandas as pd

        return pd.Series([plain(x) for x in v], dtype=object)

    return run(F.col(c))
