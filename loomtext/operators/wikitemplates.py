"""Templates of wiki markup: parameters, parser functions, transclusion."""

from __future__ import annotations

import operator
import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

_MARK = re.compile(r"\{\{\{(?!\{)|\{\{|\}\}\}|\}\}|\[\[|\]\]|\|")
_SHOWN = re.compile(r"<noinclude>.*?(?:</noinclude>|\Z)|</?includeonly>", re.S | re.I)
_ONLY = re.compile(r"<onlyinclude>(.*?)(?:</onlyinclude>|\Z)", re.S | re.I)
#: Transclusions inside one another; a deeper one, like a template that calls itself, is empty.
DEPTH = 30


@dataclass
class Group:
    """A {{call}}, {{{parameter}}} or [[link]] with its parts, each a list of strings and groups; kind "" is the text itself."""

    kind: str
    parts: list[list] = field(default_factory=lambda: [[]])


def parse(text: str) -> Group:
    """Groups by their brackets. Brackets without a partner are text."""
    stack, at = [Group("")], 0
    while m := _MARK.search(text, at):
        top, mark = stack[-1], m.group()
        top.parts[-1].append(text[at : m.start()])
        at = m.end()
        if mark in ("{{{", "{{", "[["):
            stack.append(Group(mark))
        elif mark == "|" and top.kind in ("{{{", "{{"):
            top.parts.append([])
        elif (mark, top.kind) in (("}}}", "{{{"), ("}}", "{{"), ("]]", "[["), ("}}}", "{{")):
            if mark == "}}}" and top.kind == "{{":
                at -= 1
            stack.pop()
            stack[-1].parts[-1].append(top)
        else:
            top.parts[-1].append(mark)
    stack[-1].parts[-1].append(text[at:])
    while len(stack) > 1:
        lost = stack.pop()
        rest: list = [lost.kind]
        for k, part in enumerate(lost.parts):
            rest += (["|"] if k else []) + part
        stack[-1].parts[-1] += rest
    return stack[0]


# --- arithmetic -----------------------------------------------------------------------------------------------------------

_PIECE = re.compile(r"\s*(\d+\.?\d*(?:e[+-]?\d+)?|\.\d+|<>|!=|<=|>=|[-+*/^()=<>]|[a-z]+)", re.I)
_BINARY = {
    "or": (1, lambda a, b: float(bool(a) or bool(b))),
    "and": (2, lambda a, b: float(bool(a) and bool(b))),
    **{s: (3, lambda a, b, f=f: float(f(a, b))) for s, f in (("=", operator.eq), ("!=", operator.ne), ("<>", operator.ne), ("<", operator.lt), (">", operator.gt), ("<=", operator.le), (">=", operator.ge))},
    "round": (4, lambda a, b: round(a, int(b))),
    "+": (5, operator.add),
    "-": (5, operator.sub),
    "*": (6, operator.mul),
    "/": (6, operator.truediv),
    "div": (6, operator.truediv),
    "mod": (6, lambda a, b: float(int(a) - int(b) * int(int(a) / int(b)))),
    "^": (7, lambda a, b: float(a) ** b),
}
_UNARY = {"-": operator.neg, "+": operator.pos, "not": lambda a: float(not a), "abs": abs, "trunc": lambda a: float(int(a)), "floor": lambda a: float(a // 1), "ceil": lambda a: float(-(-a // 1))}


def calculate(text: str) -> float:
    """The value of an arithmetic expression; ValueError if it is none."""
    pieces, at = [], 0
    text = text.strip()
    while at < len(text):
        if not (m := _PIECE.match(text, at)):
            raise ValueError(text)
        pieces.append(m[1].lower())
        at = m.end()
    pieces.append("")
    here = 0

    def value(least: int) -> float:
        nonlocal here
        p = pieces[here]
        here += 1
        if p == "(":
            left = value(0)
            if pieces[here] != ")":
                raise ValueError(text)
            here += 1
        elif p in _UNARY:
            left = _UNARY[p](value(8))
        else:
            left = float(p)
        while (op := _BINARY.get(pieces[here])) and op[0] > least:
            here += 1
            left = op[1](left, value(op[0]))
        return left

    try:
        out = value(0)
    except (ZeroDivisionError, OverflowError, TypeError, IndexError) as e:
        raise ValueError(text) from e
    if pieces[here] or isinstance(out, complex):
        raise ValueError(text)
    return out


def number(x: float) -> str:
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else f"{x:.12g}"


def roman(n: int) -> str:
    """From 1 to 4,999; other numbers stay as they are."""
    if not 0 < n < 5000:
        return str(n)
    out = ""
    for v, s in zip((1000, 900, 500, 400, 100, 90, 50, 40, 10, 9, 5, 4, 1), "M CM D CD C XC L XL X IX V IV I".split()):
        out += s * (n // v)
        n %= v
    return out


# --- expansion ------------------------------------------------------------------------------------------------------------


class Expander:
    """Expands calls with ``templates`` (name to body). Names are alike but for the first letter's case and _ for a blank."""

    def __init__(self, templates: dict[str, str]):
        self.bodies = {self.key(n): self.body(b) for n, b in templates.items()}

    @staticmethod
    def key(name: str) -> str:
        n = " ".join(name.replace("_", " ").split())
        n = re.sub(r"^(?:template|bản mẫu)\s*:\s*", "", n, flags=re.I)
        return n[:1].upper() + n[1:]

    @staticmethod
    def body(text: str) -> Group:
        only = _ONLY.findall(text)
        return parse("".join(only) if only else _SHOWN.sub("", text))

    def text(self, nodes: list, args: dict[str, str], depth: int) -> str:
        out = []
        for n in nodes:
            if isinstance(n, str):
                out.append(n)
            elif n.kind == "[[":
                out.append("[[" + self.text(n.parts[0], args, depth) + "]]")
            elif n.kind == "{{{":
                name = self.text(n.parts[0], args, depth).strip()
                out.append(args[name] if name in args else self.text(n.parts[1], args, depth) if len(n.parts) > 1 else "{{{" + name + "}}}")
            else:
                out.append(self.call(n, args, depth))
        return "".join(out)

    def call(self, n: Group, args: dict[str, str], depth: int) -> str:
        if depth >= DEPTH:
            return ""
        head = self.text(n.parts[0], args, depth)
        name, colon, first = head.partition(":")
        f = getattr(self, "f_" + name.strip().lower().lstrip("#"), None) if colon else None
        if f and (name.strip().startswith("#") or name.strip().lower() in ("lc", "uc", "lcfirst", "ucfirst", "padleft", "padright")):
            return f([first.strip()], n.parts[1:], lambda p: self.text(p, args, depth).strip())
        given: dict[str, str] = {}
        place = 0
        for part in n.parts[1:]:
            k = next((i for i, x in enumerate(part) if isinstance(x, str) and "=" in x), None)
            if k is None:
                place += 1
                given[str(place)] = self.text(part, args, depth)
            else:
                left, _, right = part[k].partition("=")
                given[self.text([*part[:k], left], args, depth).strip()] = self.text([right, *part[k + 1 :]], args, depth).strip()
        if self.key(head) == "Roman" and "Roman" not in self.bodies:
            n_ = given.get("1", "").strip()
            return roman(int(n_)) if n_.isdigit() else n_
        found = self.bodies.get(self.key(head))
        return self.text(found.parts[0], given, depth + 1) if found else ""

    # Parser functions: (evaluated first argument, other parts, evaluate).

    @staticmethod
    def pick(parts: list, k: int, ev) -> str:
        return ev(parts[k]) if k < len(parts) else ""

    def f_if(self, a, rest, ev):
        return self.pick(rest, 0 if a[0] else 1, ev)

    def f_ifeq(self, a, rest, ev):
        x, y = a[0], self.pick(rest, 0, ev)
        try:
            same = float(x) == float(y)
        except ValueError:
            same = x == y
        return self.pick(rest, 1 if same else 2, ev)

    def f_iferror(self, a, rest, ev):
        bad = 'class="error"' in a[0]
        return self.pick(rest, 0, ev) if bad else self.pick(rest, 1, ev) if len(rest) > 1 else a[0]

    def f_ifexpr(self, a, rest, ev):
        try:
            yes = calculate(a[0]) != 0 if a[0] else False
        except ValueError:
            return self.f_expr(a, rest, ev)
        return self.pick(rest, 0 if yes else 1, ev)

    def f_expr(self, a, rest, ev):
        try:
            return number(calculate(a[0])) if a[0] else ""
        except ValueError:
            return '<strong class="error">Expression error</strong>'

    def f_switch(self, a, rest, ev):
        otherwise, through = "", False
        for k, part in enumerate(rest):
            at = next((i for i, x in enumerate(part) if isinstance(x, str) and "=" in x), None)
            if at is None:
                if k == len(rest) - 1:
                    return ev(part)
                through = through or ev(part) == a[0]
                continue
            left, _, right = part[at].partition("=")
            label, value = ev([*part[:at], left]), [right, *part[at + 1 :]]
            if through or label == a[0]:
                return ev(value)
            if label == "#default":
                otherwise = ev(value)
        return otherwise

    def f_lc(self, a, rest, ev):
        return a[0].lower()

    def f_uc(self, a, rest, ev):
        return a[0].upper()

    def f_lcfirst(self, a, rest, ev):
        return a[0][:1].lower() + a[0][1:]

    def f_ucfirst(self, a, rest, ev):
        return a[0][:1].upper() + a[0][1:]

    def f_len(self, a, rest, ev):
        return str(len(a[0]))

    def f_pos(self, a, rest, ev):
        at = a[0].find(self.pick(rest, 0, ev) or " ")
        return str(at) if at >= 0 else ""

    def f_sub(self, a, rest, ev):
        start, n = (int(x) if re.fullmatch(r"-?\d+", x) else 0 for x in (self.pick(rest, 0, ev), self.pick(rest, 1, ev)))
        tail = a[0][start:]
        return tail if n == 0 else tail[:n]

    def f_replace(self, a, rest, ev):
        old = self.pick(rest, 0, ev)
        return a[0].replace(old, self.pick(rest, 1, ev)) if old else a[0]

    def pad(self, a, rest, ev) -> str:
        n = self.pick(rest, 0, ev)
        missing = min(500, int(n) if n.isdigit() else 0) - len(a[0])
        fill = self.pick(rest, 1, ev) or "0"
        return (fill * missing)[:missing] if missing > 0 else ""

    def f_padleft(self, a, rest, ev):
        return self.pad(a, rest, ev) + a[0]

    def f_padright(self, a, rest, ev):
        return a[0] + self.pad(a, rest, ev)

    def expand(self, text: str | None) -> str | None:
        return None if text is None else self.text(parse(text).parts[0], {}, 0)


def expand_templates(c: str, templates: dict[str, str]) -> Column:
    """Markup with its templates expanded; unknown ones are empty. ``templates`` goes to every executor: the caller bounds it."""
    model = Expander(templates)

    @F.pandas_udf("string")
    def run(v):
        import pandas as pd

        return pd.Series([model.expand(x) for x in v], dtype=object)

    return run(F.col(c))
