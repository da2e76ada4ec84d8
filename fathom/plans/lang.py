"""The query language: text to a tree. One hand-written parser, no field knowledge."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from fathom.config import QueryError


@dataclass(frozen=True)
class Node:
    pass


@dataclass(frozen=True)
class Text(Node):
    """A term, pattern or phrase, as written; `kind`: term, wildcard, phrase, regex, fuzzy."""

    fields: str | None
    text: str
    kind: str = "term"
    n: int = 0


@dataclass(frozen=True)
class Range(Node):
    fields: str
    low: str
    high: str
    with_low: bool
    with_high: bool


@dataclass(frozen=True)
class MatchAll(Node):
    pass


@dataclass(frozen=True)
class Boost(Node):
    of: Node
    by: float


@dataclass(frozen=True)
class Set_(Node):
    """A raw set: `numbers` for numeric literals, else unanalyzed terms."""

    fields: str
    values: tuple[str, ...]
    numbers: bool


@dataclass(frozen=True)
class Geo(Node):
    """`values`: lat, lon, km; or for a box south, north, west, east."""

    fields: str
    values: tuple[float, ...]
    box: bool = False


@dataclass(frozen=True)
class Intervals(Node):
    fields: str | None
    fn: tuple


@dataclass(frozen=True)
class Bool(Node):
    """(occur, node) with occur one of + - and nothing; at least `mm` of the optional ones."""

    clauses: tuple[tuple[str, Node], ...] = ()
    mm: int | None = field(default=None)


_SPECIAL = set(' \t\r\n()[]{}"^~:=<>+-!/')
INTERVALS = {f.lower(): f for f in ("atLeast", "maxwidth", "maxgaps", "unordered", "unorderedNoOverlaps", "ordered", "or", "phrase", "before", "after", "containing", "notContaining", "containedBy", "notContainedBy", "within", "extend", "notWithin", "overlapping", "nonOverlapping", "wildcard", "fuzzyTerm")}


class Parser:
    def __init__(self, text: str, default_and: bool = False, mm: int | None = None):
        self.s, self.i, self.default_and, self.mm = text, 0, default_and, mm

    def fail(self, what: str):
        raise QueryError(f"query {self.s!r}, at {self.i}: {what}")

    def ws(self):
        while self.i < len(self.s) and self.s[self.i].isspace():
            self.i += 1

    def peek(self, t: str) -> bool:
        return self.s.startswith(t, self.i)

    def word_op(self, *ops: str) -> str | None:
        self.ws()
        for o in ops:
            if self.peek(o) and (not o.isalpha() or (self.i + len(o) >= len(self.s) or self.s[self.i + len(o)] in " \t\n()")):
                self.i += len(o)
                return o
        return None

    def parse(self) -> Node:
        self.ws()
        if self.i == len(self.s):
            return MatchAll()
        out = self.clauses(self.mm)
        self.ws()
        if self.i < len(self.s):
            self.fail("unexpected text")
        return out

    def clauses(self, mm: int | None = None, fields: str | None = None) -> Node:
        out: list[tuple[str, Node]] = []
        while True:
            self.ws()
            if self.i >= len(self.s) or self.peek(")"):
                break
            out.append(self.disjunction(fields))
        return self.group(out, mm)

    def group(self, out: list[tuple[str, Node]], mm: int | None) -> Node:
        if not out:
            self.fail("an empty group")
        if self.default_and and mm is None:
            out = [(o or "+", n) for o, n in out]
        if len(out) == 1 and out[0][0] in ("", "+") and mm is None:
            return out[0][1]
        return Bool(tuple(out), mm)

    def disjunction(self, fields) -> tuple[str, Node]:
        parts = [self.conjunction(fields)]
        while self.word_op("OR", "||"):
            parts.append(self.conjunction(fields))
        return parts[0] if len(parts) == 1 else ("", Bool(tuple(parts)))

    def conjunction(self, fields) -> tuple[str, Node]:
        parts = [self.modified(fields)]
        while self.word_op("AND", "&&"):
            parts.append(self.modified(fields))
        return parts[0] if len(parts) == 1 else ("", Bool(tuple((o or "+", n) for o, n in parts)))

    def modified(self, fields) -> tuple[str, Node]:
        self.ws()
        occur = ""
        if self.word_op("NOT"):
            occur = "-"
        elif self.i < len(self.s) and self.s[self.i] in "+-!":
            occur = "+" if self.s[self.i] == "+" else "-"
            self.i += 1
        self.ws()
        return occur, self.boosted(self.clause(fields))

    def boosted(self, node: Node) -> Node:
        if self.peek("^"):
            self.i += 1
            m = re.compile(r"\d+(?:\.\d+)?(?![^\s()^])").match(self.s, self.i)
            if not m:
                self.fail("a boost must be a number")
            self.i = m.end()
            return Boost(node, float(m[0]))
        return node

    def term(self, stop: str = "") -> str:
        out = []
        while self.i < len(self.s):
            c = self.s[self.i]
            if c == "\\" and self.i + 1 < len(self.s):
                out.append("\\" + self.s[self.i + 1] if self.s[self.i + 1] in "*?\\" else self.s[self.i + 1])
                self.i += 2
            elif (c in _SPECIAL and not (c in "-+/!" and out)) or c in stop:
                break
            else:
                out.append(c)
                self.i += 1
        return "".join(out)

    def field_name(self) -> str | None:
        m = re.compile(r"(\|*[\w.*,?$]+\|*)(?=(?::|=|<=|>=|<|>))").match(self.s, self.i)
        if not m or m[1] == "*" and self.s.startswith("*:*", self.i):
            return None
        if m[1] in ("zl", "fn"):
            return None
        self.i = m.end()
        return m[1]

    def clause(self, fields: str | None) -> Node:
        if self.peek("*:*"):
            self.i += 3
            return MatchAll()
        name = self.field_name()
        if name is not None:
            fields = name
            for o in ("<=", ">=", "<", ">", ":", "="):
                if self.peek(o):
                    self.i += len(o)
                    break
            if o in ("<", "<=", ">", ">="):
                self.ws()
                v = self.quoted() if self.peek('"') else self.number_text()
                return Range(fields, *(("*", v, True, o == "<=") if o[0] == "<" else (v, "*", o == ">=", True)))
        if self.peek("zl:"):
            return self.function(fields)
        if self.peek("fn:"):
            self.i += 3
            return Intervals(fields, self.interval())
        if self.peek("("):
            self.i += 1
            j = self.i
            out: list = []
            while True:
                self.ws()
                if self.i >= len(self.s):
                    self.i = j
                    self.fail("a parenthesis is open")
                if self.peek(")"):
                    self.i += 1
                    break
                out.append(self.disjunction(fields))
            m = re.compile(r"[~@](\d+)").match(self.s, self.i)
            if m:
                self.i = m.end()
            return self.group(out, int(m[1]) if m else None)
        if self.i < len(self.s) and self.s[self.i] in "[{":
            return self.range(fields)
        if self.peek('"'):
            text = self.quoted()
            m = re.compile(r"~(\d+)").match(self.s, self.i)
            if m:
                self.i = m.end()
            return Text(fields, text, "phrase", int(m[1]) if m else 0)
        if self.peek("/"):
            j = self.i + 1
            while j < len(self.s) and self.s[j] != "/":
                j += 2 if self.s[j] == "\\" else 1
            if j >= len(self.s):
                self.fail("a pattern is open")
            text, self.i = self.s[self.i + 1 : j], j + 1
            return Text(fields, text, "regex")
        signed = fields is not None and self.i < len(self.s) and self.s[self.i] in "-+"
        sign = self.s[self.i] if signed else ""
        self.i += len(sign)
        text = sign + self.term()
        if text in ("", "-", "+"):
            self.fail("a term is missing")
        m = re.compile(r"~(-?\d+(?:\.\d+)?)?").match(self.s, self.i)
        if m:
            self.i = m.end()
            n = 2.0 if m[1] is None else float(m[1])
            if n < 0 or (n >= 1 and n != int(n)):
                self.fail("an edit distance must be a whole number")
            return Text(fields, text, "fuzzy", int(n) if n >= 1 else 2)
        wild = re.search(r"(?<!\\)[*?]", text)
        return Text(fields, text, "wildcard" if wild else "term")

    def number_text(self) -> str:
        m = re.compile(r"[^\s()^]+").match(self.s, self.i)
        if not m:
            self.fail("a bound is missing")
        self.i = m.end()
        return m[0]

    def quoted(self) -> str:
        j = self.i + 1
        out = []
        while j < len(self.s) and self.s[j] != '"':
            if self.s[j] == "\\" and j + 1 < len(self.s):
                j += 1
            out.append(self.s[j])
            j += 1
        if j >= len(self.s):
            self.fail("a quote is open")
        self.i = j + 1
        return "".join(out)

    def range(self, fields) -> Node:
        m = re.compile(r'([\[{])\s*("[^"]*"|[^\s\]}]+)\s+TO\s+("[^"]*"|[^\s\]}]+)\s*([\]}])').match(self.s, self.i)
        if not m or fields is None:
            self.fail("a range needs a field and the form [a TO b]")
        self.i = m.end()
        return Range(fields, m[2].strip('"'), m[3].strip('"'), m[1] == "[", m[4] == "]")

    def args(self) -> list[str]:
        if not self.peek("("):
            self.fail("a parenthesis is missing")
        self.i += 1
        out = []
        while True:
            self.ws()
            if self.i >= len(self.s):
                self.fail("a parenthesis is open")
            if self.peek(")"):
                self.i += 1
                return out
            if self.peek('"'):
                out.append(self.quoted())
                continue
            m = re.compile(r'[^\s()"]+').match(self.s, self.i)
            if not m:
                self.fail("an argument is missing")
            out.append(m[0])
            self.i = m.end()

    def function(self, fields) -> Node:
        m = re.compile(r"zl:(\w+)").match(self.s, self.i)
        if not m:
            self.fail("an unknown function")
        name, self.i = m[1], m.end()
        values = self.args()
        if name in ("ns", "numericSet", "tq", "termQuery"):
            if fields is None:
                self.fail("a set needs a field")
            return Set_(fields, tuple(values), name in ("ns", "numericSet"))
        if name in ("geo", "geoBbox"):
            try:
                return Geo(values[0], tuple(float(v) for v in values[1:]), name == "geoBbox")
            except (ValueError, IndexError):
                self.fail("bad numbers for a place")
        self.fail(f"unknown function {name}")

    def interval(self) -> tuple:
        """(name, arguments) with numbers, texts ('text', t) and functions as arguments."""
        m = re.compile(r"(?:fn:)?([A-Za-z]+)\(").match(self.s, self.i)
        if not m or m[1].lower() not in INTERVALS:
            self.fail("an interval function is missing")
        self.i = m.end()
        out: list = []
        while True:
            self.ws()
            if self.i >= len(self.s):
                self.fail("a parenthesis is open")
            if self.peek(")"):
                self.i += 1
                return (INTERVALS[m[1].lower()], tuple(out))
            if re.compile(r"(?:fn:)?[A-Za-z]+\(").match(self.s, self.i):
                out.append(self.interval())
            elif self.peek('"'):
                out.append(("text", self.quoted()))
            else:
                t = re.compile(r'[^\s()"]+').match(self.s, self.i)[0]
                self.i += len(t)
                out.append(int(t) if t.isdigit() else ("text", t))


def parse(text: str, default_and: bool = False, mm: int | None = None) -> Node:
    return Parser(text, default_and, mm).parse()
