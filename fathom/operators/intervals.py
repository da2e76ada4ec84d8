"""Position algebra over one field's tokens: the only predicates that run in Python, in Arrow batches."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable
from fnmatch import fnmatchcase, translate
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from fathom.config import QueryError

#: Functions of tokens themselves.
LEAVES = ("text", "wildcard", "fuzzyTerm")

#: An interval: first position, last position, positions of it that terms take.
Span = tuple[int, int, int]


def edits(a: str, b: str, most: int, swaps: bool = True) -> int:
    """Edit distance with transpositions, or most + 1."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y))
            if swaps and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, rows[-2][j - 2] + 1)
            row.append(d)
        rows.append(row)
    return rows[-1][-1]


def minimal(spans: list[Span]) -> list[Span]:
    """Spans that hold no other span, by their ends; starts then rise, too."""
    out: list[Span] = []
    for s in sorted(spans, key=lambda x: (x[1], -x[0], x[2])):
        if not out or s[0] > out[-1][0]:
            out.append(s)
    return out


def ordered(parts: list[list[Span]], touching: bool = False) -> list[Span]:
    """One span of each part, one behind the other: each takes the latest that ends before it (touching: right before)."""
    now = parts[0]
    for part in parts[1:]:
        ends, out = [s[1] for s in now], []
        for s in part:
            i = bisect_left(ends, s[0]) - 1
            if i >= 0 and (not touching or ends[i] == s[0] - 1):
                out.append((now[i][0], s[1], now[i][2] + s[2]))
        now = minimal(out)
    return now


def unordered(parts: list[list[Span]], least: int) -> list[Span]:
    """Windows that hold spans of at least `least` of the parts, in any order; equal parts take different spans."""
    kinds: dict[tuple, int] = {}
    for part in parts:
        kinds[tuple(part)] = kinds.get(tuple(part), 0) + 1
    last: list[list[Span]] = [[] for _ in kinds]
    out = []
    for s, k in sorted(((s, k) for k, part in enumerate(kinds) for s in part), key=lambda x: (x[0][1], x[0][0])):
        last[k] = [s, *last[k]][: list(kinds.values())[k]]
        held = sorted((x for own in last for x in own), reverse=True)
        if len(held) >= least:
            some = held[:least]
            out.append((some[-1][0], max(x[1] for x in some), sum(x[2] for x in some)))
    return minimal(out)


def operands(fn: tuple) -> list[tuple]:
    """The texts and functions among a function's arguments; bare numbers in their places are texts."""
    name, args = fn
    if name == "atLeast":
        args = args[1:]
    elif name in ("maxwidth", "maxgaps"):
        args = args[1:2]
    elif name == "extend":
        args = args[:1]
    elif name in ("within", "notWithin"):
        args = (args[0], args[2])
    return [("text", [str(a)]) if isinstance(a, int) else a for a in args]


def evaluate(fn: tuple, tokens: list[str | None]) -> list[Span]:
    def leaf(x: tuple) -> list[Span]:
        test = {"text": lambda t: t in x[1], "wildcard": lambda t: fnmatchcase(t, word_of(x)), "fuzzyTerm": lambda t: True}[x[0]]
        at = [i for i, t in enumerate(tokens) if t is not None and test(t)]
        return spans_of(x, at, [tokens[i] for i in at], len(tokens))

    return spans(fn, leaf)


def spans(fn: tuple, leaf: Callable[[tuple], list[Span]]) -> list[Span]:
    """The spans of a function; `leaf` has those of texts, patterns and fuzzy terms.

    Spans of every function are in order of their starts and of their ends alike, so each test looks up one span.
    """
    name, args = fn
    if name in LEAVES:
        return leaf(fn)
    parts = [spans(a, leaf) for a in operands(fn)]
    if name in ("ordered", "phrase"):
        return ordered(parts, name == "phrase")
    if name == "unordered":
        return unordered(parts, len(parts))
    if name == "unorderedNoOverlaps":
        a, b = parts
        return minimal(ordered([a, b]) + ordered([b, a]))
    if name == "or":
        return minimal([s for a in parts for s in a])
    if name == "atLeast":
        return unordered(parts, args[0])
    if name in ("maxwidth", "maxgaps"):
        n = args[0]
        return [s for s in parts[0] if (s[1] - s[0] + 1 <= n if name == "maxwidth" else s[1] - s[0] + 1 - s[2] <= n)]
    if name == "extend":
        return [(max(0, s[0] - args[1]), s[1] + args[2], s[2]) for s in parts[0]]
    n = args[1] if name in ("within", "notWithin") else 0
    a, b = parts
    starts = [r[0] for r in b]

    def ends_behind(low: int, end: int) -> bool:
        """Whether one of b starts at `low` at the latest and ends at `end` at the earliest."""
        i = bisect_right(starts, low) - 1
        return i >= 0 and b[i][1] >= end

    def holds(s: Span) -> bool:
        i = bisect_left(starts, s[0])
        return i < len(b) and b[i][1] <= s[1]

    test = {
        "within": lambda s: ends_behind(s[0] + n, s[1] - n),
        "notWithin": lambda s: not ends_behind(s[1] + n, s[0] - n),
        "before": lambda s: bool(b) and s[1] < b[-1][0],
        "after": lambda s: bool(b) and s[0] > b[0][1],
        "containing": holds,
        "notContaining": lambda s: not holds(s),
        "containedBy": lambda s: ends_behind(s[0], s[1]),
        "notContainedBy": lambda s: not ends_behind(s[0], s[1]),
        "overlapping": lambda s: ends_behind(s[1], s[0]),
        "nonOverlapping": lambda s: not ends_behind(s[1], s[0]),
    }.get(name)
    if not test:
        raise QueryError(f"unknown interval function {name}")
    return [s for s in a if test(s)]


def analyzed(fn: tuple, analyze) -> tuple:
    """Texts of a function as lists of analyzed tokens (patterns and fuzzy terms keep their one word)."""
    name, args = fn
    out = []
    for a in args:
        if isinstance(a, tuple) and a[0] == "text":
            out.append(("text", [a[1].lower()] if name in ("wildcard", "fuzzyTerm") else analyze(a[1])))
        else:
            out.append(analyzed(a, analyze) if isinstance(a, tuple) else a)
    return name, tuple(out)


def possible(fn: tuple, some: Callable[[tuple], Column | None]) -> Column | None:
    """A test that every match passes, from a test of each leaf (None: any row passes)."""
    name, args = fn
    if name in LEAVES:
        return some(fn)
    tests = [possible(a, some) for a in operands(fn)[: 1 if name.startswith("no") else None]]
    known = [t for t in tests if t is not None]
    if name in ("or", "atLeast"):
        if len(known) < len(tests):
            return None
        return reduce(lambda a, b: a | b, known) if name == "or" else reduce(lambda a, b: a + b, [t.cast("int") for t in known]) >= args[0]
    return reduce(lambda a, b: a & b, known) if known else None


def leaves(fn: tuple) -> list[tuple]:
    return [fn] if fn[0] in LEAVES else [x for a in operands(fn) for x in leaves(a)]


def word_of(leaf: tuple) -> str:
    """The one word of a pattern or fuzzy term."""
    word = leaf[1][0][1]
    return word[0] if isinstance(word, list) else word


def wanted(leaf: tuple) -> Callable[[Column], Column]:
    """A native test that all tokens of a leaf pass."""
    name, args = leaf
    if name == "text":
        return lambda t: t.isin([w for w in args if w is not None])
    word = word_of(leaf)
    if name == "wildcard":  # classes of characters are left to Python
        pattern = translate(word if "[" not in word else word[: word.index("[")] + "*").removesuffix("\\Z").removesuffix("\\z")
        return lambda t: t.rlike(f"^{pattern}\\z")
    return lambda t: F.levenshtein(t, F.lit(word), 2 * fuzziness(leaf)) >= 0  # a swap is two edits at most


def fuzziness(leaf: tuple) -> int:
    return next((a for a in leaf[1] if isinstance(a, int)), 2)


def kept(tokens: Column, test: Callable[[Column], Column]) -> Column:
    """The positions of the tokens that pass a test."""
    at = F.filter(F.transform(tokens, lambda t, i: F.when(test(t), i)), lambda i: i.isNotNull())
    return F.coalesce(at, F.array().cast("array<int>"))


def words_at(tokens: Column, at: Column) -> Column:
    return F.transform(at, lambda i: F.get(tokens, i))


def spans_of(leaf: tuple, at: list[int], words: list[str], size: int) -> list[Span]:
    """The spans of a leaf from the positions of its tokens, the tokens if it looks at them, and the number of all tokens."""
    name, args = leaf
    if name == "wildcard":
        word = word_of(leaf)
        return [(i, i, 1) for i, w in zip(at, words, strict=True) if fnmatchcase(w, word)] if "[" in word else [(i, i, 1) for i in at]
    if name == "fuzzyTerm":
        word, most = word_of(leaf), fuzziness(leaf)
        return [(i, i, 1) for i, w in zip(at, words, strict=True) if edits(word, w, most) <= most]
    n = len(args)
    first = next((k for k, w in enumerate(args) if w is not None), None)
    if first is None:  # no word of it is left: it is anywhere
        return [(i, i + n - 1, n) for i in range(size - n + 1)]
    if n == 1:
        return [(i, i, 1) for i in at]
    has = dict(zip(at, words, strict=True))
    begins = [i - first for i, w in has.items() if w == args[first] and 0 <= i - first <= size - n]
    return [(i, i + n - 1, n) for i in begins if all(w is None or has.get(i + k) == w for k, w in enumerate(args))]


def matches(tokens: Column, fn: tuple) -> Column:
    """Rows with spans of a function. Python gets the positions of the function's own tokens, not the texts."""
    parts = list({repr(x): x for x in leaves(fn)}.values())
    columns, where = [F.coalesce(F.size(tokens), F.lit(0))], {}
    for x in parts:
        at = kept(tokens, wanted(x))
        with_words = x[0] == "fuzzyTerm" or (len(x[1]) > 1 if x[0] == "text" else "[" in word_of(x))
        where[repr(x)] = (len(columns), len(columns) + 1 if with_words else None)
        columns += [at, words_at(tokens, at)] if with_words else [at]

    @F.pandas_udf("boolean")
    def run(*given: pd.Series) -> pd.Series:
        def one(row: tuple) -> bool:
            def leaf(x: tuple) -> list[Span]:
                at, words = where[repr(x)]
                return spans_of(x, row[at].tolist(), [] if words is None else list(row[words]), row[0])

            return bool(spans(fn, leaf))

        return pd.Series([one(row) for row in zip(*given, strict=True)], dtype=bool)

    ok = possible(fn, lambda x: all_held(tokens, x[1]) if x[0] == "text" else F.exists(F.filter(tokens, lambda t: t.isNotNull()), wanted(x)))
    found = F.coalesce(run(*columns), F.lit(False)) & tokens.isNotNull()
    return found if ok is None else F.coalesce(ok, F.lit(False)) & found


def all_held(tokens: Column, words: list[str | None]) -> Column | None:
    some = [w for w in dict.fromkeys(words) if w is not None]
    return reduce(lambda a, b: a & b, [F.coalesce(F.array_contains(tokens, w), F.lit(False)) for w in some]) if some else None


def sloppy_match(tokens: list, words: list[str], slop: int, at: list[int] | None = None) -> bool:
    """Sweeps over where each word would have the phrase begin; equal words take different positions.

    `at` has the positions of the tokens if others are left out.
    """
    places = list(zip(range(len(tokens)) if at is None else at, tokens, strict=True))
    begins = sorted((p - i, i, p) for i, w in enumerate(words) for p, t in places if t == w)
    plain, low = len(set(words)) == len(words), 0

    def assigned(some: list[tuple[int, int, int]]) -> bool:
        """Whether every word of the phrase finds a position of its own (augmenting paths)."""
        options: dict[int, list[int]] = {}
        for _, i, p in some:
            options.setdefault(i, []).append(p)
        taken: dict[int, int] = {}

        def place(i: int, seen: set[int]) -> bool:
            for p in options[i]:
                if p not in seen:
                    seen.add(p)
                    if p not in taken or place(taken[p], seen):
                        taken[p] = i
                        return True
            return False

        return all(place(i, set()) for i in options)

    for high, (begin, _, _) in enumerate(begins):
        while begins[low][0] < begin - slop:
            low += 1
        some = begins[low : high + 1]
        if len({i for _, i, _ in some}) == len(words) and (plain or assigned(some)):
            return True
    return False


def sloppy(tokens: Column, words: list[str], slop: int) -> Column:
    """A phrase whose words may move by `slop` positions in all."""

    @F.pandas_udf("boolean")
    def run(at: pd.Series, some: pd.Series) -> pd.Series:
        return pd.Series([sloppy_match(list(t), words, slop, a.tolist()) for a, t in zip(at, some, strict=True)], dtype=bool)

    at = kept(tokens, lambda t: t.isin(words))
    return all_held(tokens, words) & F.coalesce(run(at, words_at(tokens, at)), F.lit(False))
