"""Main text of web pages by consensus of a host's pages.

Every page scores its containers by the text in them and votes for the best one's generalised path (tags and classes,
numbers replaced). Votes are summed per host in Spark, and each page is extracted again with its host's winning path; a
page on which that path has no text uses its own best. Whatever is a menu, header, footer, sidebar, notice, advert, form,
script, style or reader comment by tag, role or class is left out in either pass.

Pages are read in one pass with the implied end tags of HTML, and paths are nodes of a tree that a page shares among equal
paths, so the work is linear in the page however it nests or fails to close. Names count as noise by whole class names and
only below the winning path: a container is not dropped for its own or its parents' names where the host's pages agree
on it. Names that articles bear too (WEAK) are let in on a page where they hold over twice the rest of the text, and all
names where nothing else has text. An article or main inside a form or such a name begins anew, and so does the body.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import materialize

#: Winning paths are broadcast up to this many hosts (about 20 MB); beyond it the join is shuffled.
BROADCAST_HOSTS = 100_000
_HOST = "__loomtext_html_host"

#: Quotes count right after an equals sign only, where they close again; else a tag ends at the next >. Nothing is tried twice.
_ATTRS = r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    rf"|<(?P<raw>script|style|title|textarea|noscript|template|iframe|noembed|noframes|annotation|annotation-xml)(?![\w:.-]){_ATTRS}>.*?(?:</(?P=raw)\s*>|\Z)"
    rf"|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attrs>{_ATTRS})>"
    r"|</?[a-z][^>]*\Z|</\Z",
    re.I | re.S,
)
_ATTR = re.compile(r"""([a-z_:][\w:.-]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>][^\s>]*+)))?+""", re.I)
#: What an inline element's attributes may hold that counts.
_TELLING = re.compile(r"class|id|role|hidden|style", re.I)
_CONTAINERS = frozenset("html head body div section article main aside nav header footer form table tbody thead tfoot tr td th ul ol dl menu figure fieldset details blockquote center dialog".split())
_BREAKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre hr address figcaption summary caption legend hgroup".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Inline elements whose content is no text of the page.
_SILENT = frozenset("svg select datalist object video audio canvas".split())
_DROPPED = frozenset("nav aside footer form menu dialog head".split())
#: Why a container is left out; from FORM on whatever its path. A main begins anew inside TAG ones too, nothing in HIDDEN ones.
WEAK, NAMED, FORM, TAG, HIDDEN = 1, 2, 3, 4, 5
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
_NAMED = re.compile(
    r"(?:nav|navbar|navigation|menus?|sub-?menu|sidebars?|side-?bar|aside|ads?|adverts?|advertisements?|ad-?(?:box|slot|unit|banner|container|wrapper)|adsbygoogle|banners?|promos?|sponsor(?:ed|s)?"
    r"|cookies?|cookie-?(?:bar|banner|notice|consent)|consent|gdpr|footers?|site-?(?:header|footer|nav)|page-?footer|masthead|topbar|top-?bar|bottom-?bar|comments?|comment-?(?:list|form|section|area)|commentlist|replies|respond|disqus"
    r"|share|sharing|related|recommend(?:ed|ations)?|more-?(?:posts|stories)|newsletter|subscribe|search-?(?:form|box)|breadcrumbs?|pagination|pager|popup|pop-?up|modal|skip-?link)",
    re.I,
)
_WEAK = re.compile(
    r"(?:notices?|alerts?|headers?|page-?header|foot|promotion|social|read-?more|subscription|sign-?up|login|search|pages|overlay|widgets?|toolbar|tags|tag-?(?:list|cloud)|byline-?share|hidden|sr-only|visually-hidden|toc|legal|copyright|disclaimer)",
    re.I,
)
_GOOD = re.compile(r"(?:^|[\s_-])(?:article|content|main|post|entry|story|text|body)(?:$|[\s_-])", re.I)
_DIGITS = re.compile(r"\d+")
#: Start tag -> (open elements it ends, elements that it ends nothing beyond).
_P = frozenset("address article aside blockquote center details dialog dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul div li dt dd summary".split())
_CELL = ("table", "td", "th", "caption", "button")
_ENDS = {
    "li": (("li",), ("ul", "ol", "menu", *_CELL)),
    "dt": (("dt", "dd"), ("dl", *_CELL)),
    "dd": (("dt", "dd"), ("dl", *_CELL)),
    "td": (("td", "th"), ("table",)),
    "th": (("td", "th"), ("table",)),
    "tr": (("tr", "td", "th", "caption"), ("table",)),
    **dict.fromkeys(("tbody", "thead", "tfoot"), (("tbody", "thead", "tfoot", "tr", "td", "th", "caption"), ("table",))),
}


class Page:
    """The text blocks of a page, in page order, and the tree of their containers' paths.

    Path k has the parent ``parent[k]`` (smaller than k), its own ``name[k]``, the noise ``own[k]`` of that name, and begins
    anew if ``fresh[k]``. ``blocks`` holds (path, text, characters in links, tag, noise) of what isn't left out whatever its path.
    """

    def __init__(self, html: str):
        self.parent, self.name, self.own, self.fresh, self.in_article = [-1], [""], [0], [True], [False]
        self.child: dict[tuple[int, str], int] = {}
        self.blocks: list[tuple[int, str, int, str, int]] = []
        self._read(html)

    def _path(self, above: int, name: str, own: int, fresh: bool, article: bool) -> int:
        k = self.child.get((above, name))
        if k is None:
            k = self.child[above, name] = len(self.parent)
            self.parent.append(above)
            self.name.append(name)
            self.own.append(own)
            self.fresh.append(fresh)
            self.in_article.append(article or self.in_article[above])
        return k

    def _read(self, html: str) -> None:
        stack: list[tuple[str, int, int]] = [("", 0, 0)]  # tag, path, noise
        open_: dict[str, list[int]] = {}  # tag: its places in the stack
        kept = 0  # open articles and mains that aren't left out
        buf: list[str] = []
        link, in_link, tag_now, held = 0, False, "", 0  # held: the noise of what buf holds

        def flush() -> None:
            nonlocal link
            if buf:
                text = " ".join("".join(buf).split())
                if text:
                    self.blocks.append((stack[-1][1], text, link, tag_now, held))
                buf.clear()
            link = 0

        def push(tag: str, path: int, noise: int) -> None:
            nonlocal kept
            kept += tag in ("article", "main") and not noise
            open_.setdefault(tag, []).append(len(stack))
            stack.append((tag, path, noise))

        def pop_to(depth: int) -> None:
            nonlocal kept
            while len(stack) > depth:
                tag, _, noise = stack.pop()
                kept -= tag in ("article", "main") and not noise
                open_[tag].pop()

        def last(*tags: str) -> int:
            return max((open_[t][-1] for t in tags if open_.get(t)), default=0)

        def text(piece: str) -> None:
            nonlocal link, held
            if stack[-1][0] == "head" and not piece.isspace():
                flush()
                pop_to(len(stack) - 1)
            if stack[-1][2] < FORM:
                piece, held = unescape(piece), stack[-1][2]
                buf.append(piece)
                if in_link:
                    link += len(piece)

        at = 0
        for m in _TOKEN.finditer(html):
            if m.start() > at:
                text(html[at : m.start()])
            at = m.end()
            tag = m["tag"]
            if tag is None:
                continue
            tag = tag.lower()
            block = tag in _CONTAINERS or tag in _BREAKS
            if m["end"]:
                if tag == "a":
                    in_link = False
                elif block:
                    flush()
                    tag_now, in_link = "", False
                here = open_.get(tag)
                if here and tag not in ("body", "html"):
                    inner = here[-1] == len(stack) - 1
                    if not inner:
                        flush()
                    if inner or tag == "table" or here[-1] > (last("table") if tag in _ENDS or tag == "caption" else last("table", "td", "th")):
                        pop_to(here[-1])
                continue
            if tag == "br" or tag in ("img", "input"):
                buf.append(" ")
                continue
            if tag == "a":
                in_link = True
            if block:
                flush()
                tag_now = tag if tag in _BREAKS else ""
                in_link = False
                if stack[-1][0] == "head":
                    pop_to(len(stack) - 1)  # its end tag may be left out
                if open_.get("svg") and (here := last("svg")) > last(*_CELL):
                    pop_to(here)
                if tag in _P and open_.get("p") and (here := last("p")) > last(*_CELL):
                    pop_to(here)
                if tag in _ENDS and (here := min((open_[t][-1] for t in _ENDS[tag][0] if open_.get(t) and open_[t][-1] > last(*_ENDS[tag][1])), default=0)):
                    pop_to(here)
            if tag in _VOID or (tag in _SILENT and m["attrs"].endswith("/")):
                continue
            raw, above = m["attrs"], stack[-1]
            label, role, noise = "", "", 0
            good = tag in ("article", "main", "body", "html")
            if raw and (block or _TELLING.search(raw)) and not raw.isspace():
                a = {k.lower(): unescape(x or y or z or "") for k, x, y, z in _ATTR.findall(raw)}
                role = a.get("role", "").lower()
                classes = a.get("class", "").split()
                label = ".".join(sorted(_DIGITS.sub("#", c.lower()) for c in classes))
                style = a.get("style", "").replace(" ", "").lower()
                names = [*classes, *a.get("id", "").split()]
                good = good or role == "main"
                noise = NAMED if any(map(_NAMED.fullmatch, names)) else WEAK if any(map(_WEAK.fullmatch, names)) else 0
                if tag in ("body", "html") or (good and (tag != "article" or noise == WEAK)):
                    noise = 0
                if role in _ROLES:
                    noise = FORM
                if "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style:
                    noise = HIDDEN
            if not block:
                # Inline elements count where they hide something, and to find the ends of those that do.
                noise = TAG if tag == "button" else HIDDEN if tag in _SILENT or noise >= NAMED else 0
                if noise or open_.get(tag):
                    push(tag, above[1], max(noise, above[2]))
                continue
            if tag in _DROPPED or (tag == "header" and not kept):
                noise = max(noise, FORM if tag in ("form", "head") else TAG)
            fresh = tag == "body"
            if fresh:
                noise = 0
            elif (tag in ("article", "main") or role == "main") and noise < NAMED and not kept:
                fresh = above[2] in (WEAK, FORM) or (above[2] in (NAMED, TAG) and tag != "article")
            if tag in _BREAKS and not noise and not good:
                push(tag, above[1], above[2])
                continue
            name = tag + ("." + label if label else "") + ("!main" if role == "main" else "") + "~" * noise + ("^" if fresh else "")
            push(tag, self._path(above[1], name, noise, fresh, tag in ("article", "main") or role == "main"), noise if fresh else max(noise, above[2]))
        if at < len(html):
            text(html[at:])
        flush()

    def spelled(self, k: int) -> str:
        names = []
        while k > 0:
            names.append(self.name[k])
            k = self.parent[k]
        return ">".join(reversed(names))

    def find(self, path: str) -> int | None:
        """The path of this spelling, if the page has it; 0 is the whole page."""
        k = 0
        for name in path.split(">") if path else ():
            k = self.child.get((k, name))
            if k is None:
                return None
        return k

    def below(self, root: int) -> list[int | None]:
        """For each path the noise of its names below ``root``, None outside it."""
        out: list[int | None] = [None] * root + [0]
        for k in range(root + 1, len(self.parent)):
            up = out[self.parent[k]]
            out.append(None if up is None else self.own[k] if self.fresh[k] else max(up, self.own[k]))
        return out

    def taken(self, root: int, let_in: int = 0) -> list[str]:
        """The texts under ``root``. Where that is the whole page, menus outside its articles are left out."""
        noise = self.below(root)
        page = re.split(r"[.!~^]", self.name[root])[0] in ("", "html", "body")
        out = []
        for k, text, link, tag, _ in self.blocks:
            if noise[k] is not None and noise[k] <= let_in and not (page and _menu(text, link, tag) and not self.in_article[k]):
                out.append(text)
        return out


def _menu(text: str, link: int, tag: str) -> bool:
    """Lists and bare containers of links are menus outside the article."""
    return link > 0.8 * len(text) and tag in ("li", "", "dt", "dd")


def best_path(page: Page) -> tuple[int, int, float] | None:
    """(path, noise let in, score) of the container with most text: it gets a share of what lies deeper, and a prior by its name."""
    size = [0.0, 0.0, 0.0]
    for _, text, link, tag, noise in page.blocks:
        if not _menu(text, link, tag):
            size[noise] += max(0, len(text) - link)
    let_in = WEAK if size[WEAK] > 2 * size[0] else 0
    if not sum(size[: let_in + 1]):
        let_in = NAMED
    mass = [0.0] * len(page.parent)
    some = [False] * len(page.parent)
    for k, text, link, tag, noise in page.blocks:
        if noise <= let_in and not _menu(text, link, tag):
            mass[k] += max(0, len(text) - link)
            some[k] = True
    for k in range(len(mass) - 1, 0, -1):
        mass[page.parent[k]] += 0.85 * mass[k]
        some[page.parent[k]] |= some[k]
    if not any(some):
        return None

    def score(k: int) -> float:
        tag, _, label = page.name[k].rstrip("~^").partition(".")
        if tag in ("article", "main") or page.name[k].rstrip("~^").endswith("!main"):
            return 1.3 * mass[k]
        if tag in ("body", "html", ""):
            return 0.7 * mass[k]
        return mass[k] * (1.15 if label and _GOOD.search(label.replace(".", " ")) else 1.0)

    scores = [score(k) if some[k] else -1.0 for k in range(len(mass))]
    best = max(scores)
    top = next(k for k, s in enumerate(scores) if s == best)
    return top, let_in, best


def vote(html: str) -> tuple[str, float] | None:
    """The spelling of a page's best path, with the noise that is let in as leading marks, and its score."""
    page = Page(html)
    got = best_path(page)
    return got and ("~" * got[1] + page.spelled(got[0]), got[2])


def main_text(html: str | None, path: str | None = None) -> str:
    """The blocks under ``path``, or under the page's own best container if that holds none, joined by newlines."""
    page = Page(html or "")
    took: list[str] = []
    if path is not None:
        bare = path.lstrip("~")
        root = page.find(bare)
        took = page.taken(root, len(path) - len(bare)) if root is not None else []
    if not took and (own := best_path(page)):
        took = page.taken(own[0], own[1])
    return "\n".join(took)


def host_of(url: str) -> Column:
    """The lower-case host without www; empty for a null url or one without a host."""
    h = F.regexp_extract(F.lower(F.col(url)), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(?:www\.)?([^/?#:]*)", 1)
    return F.coalesce(h, F.lit(""))


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path, votes): each host's winning path. A page votes with the square root of its best score; ties to the first path."""

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums: dict[tuple[str, str], float] = {}
            for host, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if html and (got := vote(html)) and got[1] > 0:
                    k = (host, got[0])
                    sums[k] = sums.get(k, 0.0) + got[1] ** 0.5
            if sums:
                yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in sums], pa.string()), pa.array([p for _, p in sums], pa.string()), pa.array(list(sums.values()))], names=["host", "path", "votes"])

    each = pages.select(host_of(url_col).alias("host"), F.col(html_col).alias("html")).mapInArrow(votes, "host string, path string, votes double")
    sums = each.groupBy("host", "path").agg(F.round(F.sum("votes"), 3).alias("votes"))
    return sums.groupBy("host").agg(F.min_by(F.struct("path", "votes"), F.struct(-F.col("votes"), F.col("path"))).alias("w")).select("host", "w.path", "w.votes")


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``pages`` with host, path (the host's winner, null if none) and text, the main text of each page's whole HTML.

    A null or empty page has an empty text. Pages without a host vote together. Repeated rows vote repeatedly; all rows and
    other columns stay, and inputs named host, path or text are replaced.
    """
    base = pages.drop("host", "path", "text")
    won = materialize(host_paths(base, url_col, html_col).select(F.col("host").alias(_HOST), F.col("path").alias("path")))
    side = F.broadcast(won) if won.count() <= BROADCAST_HOSTS else won
    d = base.withColumn("host", host_of(url_col)).join(side, F.col("host") == F.col(_HOST), "left").drop(_HOST)

    @F.pandas_udf("string")
    def text(html, path):
        import pandas as pd

        return pd.Series([main_text(h, p) for h, p in zip(html, path)], dtype=object)

    return d.withColumn("text", text(F.col(html_col), F.col("path")))
