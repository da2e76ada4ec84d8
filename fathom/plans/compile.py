"""A query tree to columns: which rows match, and their score.

Scalar fields compile to plain comparisons, which reach the scan; lists compile to `exists`. Scores need a few corpus
statistics, which one aggregation collects for all terms of a request.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.config import NUMBERS, FieldConfig, IndexConfig, QueryError
from fathom.functions import analysis, dates, geo
from fathom.operators import intervals
from fathom.plans import lang
from fathom.plans.spread import spread

_YES, _NO = {"true", "t", "yes", "y", "1"}, {"false", "f", "no", "n", "0"}
_LIMITS = {"INT": 2**31 - 1, "LONG": 2**63 - 1}
_CAST = {"INT": "int", "LONG": "long", "FLOAT": "float", "DOUBLE": "double", "DATE": "timestamp", "BOOL": "boolean", "STRING": "string"}


@dataclass
class Compiled:
    """need: a test of stored columns that every match passes, to drop rows before their text is split; None: any row."""

    match: Column
    score: Callable[[dict], Column]
    pure_not: bool = False
    need: Column | None = None


def all_of(tests: list[Column | None]) -> Column | None:
    some = [t for t in tests if t is not None]
    return reduce(lambda a, b: a & b, some) if some else None


def any_of(tests: list[Column | None]) -> Column | None:
    return reduce(lambda a, b: a | b, tests) if tests and all(t is not None for t in tests) else None


@dataclass
class Compiler:
    """Compiles trees for one table. `terms` gathers what scores need; `similarity` may be overridden by field."""

    df: DataFrame
    config: IndexConfig
    similarity: dict[str, str] = field(default_factory=dict)
    terms: set[tuple[str, str]] = field(default_factory=set)
    made: set[str] = field(default_factory=set)

    # fields

    def stored(self, f: FieldConfig) -> Column:
        return F.col(f.name)

    def is_list(self, f: FieldConfig) -> bool:
        t = self.df.select(self.stored(f)).schema[0].dataType
        return isinstance(t, T.ArrayType) and f.type not in ("VECTOR", "UNIT_VECTOR")

    def depth(self, f: FieldConfig) -> int:
        t, n = self.df.select(self.stored(f)).schema[0].dataType, 0
        while isinstance(t, T.ArrayType):
            t, n = t.elementType, n + 1
        return n

    def values(self, f: FieldConfig) -> Column:
        """All values as one array without nulls; null if the field is."""
        c = self.stored(f)
        n = self.depth(f)
        if not n:
            c = F.when(c.isNotNull(), F.array(c))
        for _ in range(n - 1):
            c = F.flatten(F.filter(c, lambda x: x.isNotNull()))
        c = F.filter(c, lambda x: x.isNotNull())
        return F.transform(c, lambda x: x.try_cast(_CAST[f.type])) if f.type in _CAST else c

    def value(self, f: FieldConfig) -> Column:
        """The value of a field that holds one, as its declared type."""
        c = self.stored(f)
        kind = self.df.select(c).schema[0].dataType.simpleString()
        return c if f.type not in _CAST or kind == _CAST[f.type] else c.try_cast(_CAST[f.type])

    def any(self, f: FieldConfig, test: Callable[[Column], Column]) -> Column:
        if not self.is_list(f):
            c = self.stored(f)
            kind = self.df.select(c).schema[0].dataType.simpleString()
            return test(c if kind.split("_")[0] == _CAST.get(f.type, "") else c.try_cast(_CAST[f.type]) if f.type in _CAST else c)
        return F.exists(self.values(f), test)

    def tokens(self, name: str) -> Column:
        """The tokens of a field as a column that `prepared` adds."""
        self.made.add(name)
        return F.col(f"`_tok_{name}`")

    def prepared(self, df: DataFrame, need: Column | None = None) -> DataFrame:
        """The rows of df that pass `need`, with the tokens of every field asked for.

        Tokens stand behind a generator, which the optimiser neither repeats in each use nor pushes tests through, so a
        text is split once, and only if it passes the tests of stored columns, which sink below.
        """
        made = [n for n in sorted(self.made) if f"_tok_{n}" not in df.columns]
        if made:
            df = spread(df.where(need) if need is not None else df, self.config.id_field)
        for n in made:
            f, analyzer = self.search_field(n)
            tokens = self.token_expr(f, analyzer)
            if analyzer and analysis.in_python(analyzer, self.config):
                df = df.withColumn(f"_tok_{n}", tokens)
            else:
                df = df.select("*", F.explode(F.array(tokens)).alias(f"_tok_{n}"))
        return df

    def holds(self, name: str, word: str) -> Column | None:
        """Whether the stored text has the characters of a token, if the analyzer keeps them but for case."""
        f, analyzer = self.search_field(name)
        rest = analysis.steps(analyzer or "whitespace", self.config)
        if self.is_list(f) or rest[0] not in analysis.TOKENIZERS or set(rest[1:]) - {"lower"}:
            return None
        if len(rest) == 1:
            return F.contains(self.stored(f).cast("string"), F.lit(word))
        return F.contains(F.lower(self.stored(f).cast("string")), F.lit(word)) if word.isascii() else None

    def token_expr(self, f: FieldConfig, analyzer: str) -> Column:
        if not self.is_list(f):
            return analysis.tokens(self.stored(f).cast("string"), analyzer or "whitespace", self.config)
        gap = F.array_repeat(F.lit(None).cast("string"), analysis.GAP)
        return F.flatten(F.transform(self.values(f), lambda v: F.concat(analysis.tokens(v.cast("string"), analyzer or "whitespace", self.config), gap)))

    def search_field(self, name: str) -> tuple[FieldConfig, str] | None:
        return self.config.searched(name)

    def spread(self, fields: str | None) -> list[tuple[str, float]]:
        """Search names with their boosts; `a^2` boosts."""
        out = []
        for part in fields.split(",") if fields else self.config.default_search:
            name, _, by = part.strip().partition("^")
            try:
                boost = float(by) if by else 1.0
            except ValueError:
                raise QueryError(f"boost of {part!r} isn't a number") from None
            out += [(n, boost) for n in self.config.expand(name)]
        if not out:
            raise QueryError("no field to search: name one or set default_search")
        return out

    # trees

    def compile(self, node: lang.Node) -> Compiled:
        if isinstance(node, lang.MatchAll):
            return Compiled(F.lit(True), lambda s: F.lit(1.0))
        if isinstance(node, lang.Boost):
            c = self.compile(node.of)
            return Compiled(c.match, lambda s: c.score(s) * F.lit(node.by), c.pure_not, c.need)
        if isinstance(node, lang.Bool):
            return self.bool(node)
        if isinstance(node, lang.Geo):
            return self.constant(self.place(node))
        fields = self.spread(getattr(node, "fields", None))
        return self.either([self.leaf(n, node, b) for n, b in fields])

    def constant(self, match: Column, by: float = 1.0, need: Column | None = None) -> Compiled:
        match = F.coalesce(match, F.lit(False))
        return Compiled(match, lambda s: F.when(match, F.lit(by)).otherwise(0.0), need=need)

    def stored_test(self, match: Column, by: float = 1.0) -> Compiled:
        """A constant score for a test of stored columns alone."""
        return self.constant(match, by, F.coalesce(match, F.lit(False)))

    def either(self, parts: list[Compiled]) -> Compiled:
        if len(parts) == 1:
            return parts[0]
        return Compiled(reduce(lambda a, b: a | b, [p.match for p in parts]), lambda s: reduce(lambda a, b: a + b, [p.score(s) for p in parts]), need=any_of([p.need for p in parts]))

    def bool(self, node: lang.Bool) -> Compiled:
        must, may, never = ([self.compile(n) for o, n in node.clauses if o == k] for k in ("+", "", "-"))
        if not must and not may:  # only exclusions: all rows but those
            match = ~reduce(lambda a, b: a | b, [c.match for c in never])
            return Compiled(match, lambda s: F.when(match, F.lit(1.0)).otherwise(0.0), True)
        tests = [c.match for c in must] + [~c.match for c in never]
        least = node.mm if node.mm is not None else (0 if must else 1)
        if may and least == 1:
            tests.append(reduce(lambda a, b: a | b, [c.match for c in may]))
        elif may and least > 1:
            tests.append(reduce(lambda a, b: a + b, [c.match.cast("int") for c in may]) >= least)
        match = reduce(lambda a, b: a & b, tests)
        need = all_of([c.need for c in must] + [any_of([c.need for c in may]) if least else None])
        return Compiled(match, lambda s: F.when(match, reduce(lambda a, b: a + b, [c.score(s) for c in must + may])).otherwise(0.0), need=need)

    # leaves

    def leaf(self, name: str, node: lang.Node, boost: float) -> Compiled:
        no = self.constant(F.lit(False))
        bars = re.fullmatch(r"(\|{3}|\|)([^|]+)\1", name)
        if bars:
            return self.length(bars[1], bars[2], node, boost)
        found = self.search_field(name)
        if not found:
            return no
        f, _ = found
        if isinstance(node, lang.Text) and node.kind == "wildcard" and node.text == "*":
            return self.stored_test(self.stored(f).isNotNull(), boost)
        if isinstance(node, lang.Intervals):
            fn = intervals.analyzed(node.fn, lambda t: analysis.query_tokens(t, self.search_field(name)[1] or "whitespace", self.config))
            need = intervals.possible(fn, lambda x: all_of([self.holds(name, w) for w in x[1] if w is not None]) if x[0] == "text" else None)
            return self.constant(intervals.matches(self.tokens(name), fn), boost, None if need is None else F.coalesce(need, F.lit(False)))
        if isinstance(node, lang.Set_):
            return self.stored_test(self.numbers(f, node.values), boost) if node.numbers else self.constant(self.raw_terms(name, node.values), boost)
        if f.type in NUMBERS or f.type in ("DATE", "BOOL"):
            return self.stored_test(self.typed(f, node), boost)
        if f.type != "STRING":
            raise QueryError(f"{name}: a {f.type} field has no text search")
        if isinstance(node, lang.Range):
            lo, hi = node.low.lower(), node.high.lower()
            test = lambda t: ((t >= lo if node.with_low else t > lo) if lo != "*" else F.lit(True)) & ((t <= hi if node.with_high else t < hi) if hi != "*" else F.lit(True))
            return self.constant(F.exists(self.tokens(name), test), boost)
        return self.text(name, node, boost)

    def text(self, name: str, node: lang.Text, boost: float) -> Compiled:
        analyzer, tok = self.search_field(name)[1], self.tokens(name)
        fold = lambda t: t.lower() if "lower" in analysis.steps(analyzer, self.config) else t
        some = lambda test: self.constant(F.exists(F.filter(tok, lambda t: t.isNotNull()), test), boost)
        if node.kind == "regex":
            return some(lambda t: t.rlike(f"^(?:{node.text})$"))
        if node.kind == "wildcard":
            t = fold(node.text)
            if re.fullmatch(r"[^*?\\]+\*", t):
                return self.constant(F.exists(tok, lambda x: F.coalesce(x.startswith(t[:-1]), F.lit(False))), boost, self.holds(name, t[:-1]))
            parts = re.split(r"(\\.|[*?])", t)
            pattern = "".join(".*" if p == "*" else "." if p == "?" else re.escape(p[-1:] if p.startswith("\\") else p) for p in parts)
            return some(lambda x: x.rlike(f"^(?s:{pattern})$"))
        if node.kind == "fuzzy":
            t = fold(node.text)
            return some(lambda x: F.levenshtein(x, F.lit(t), node.n).between(0, node.n))
        words = [w for w in analysis.query_tokens(node.text, analyzer, self.config) if w is not None]
        if not words:
            return self.constant(F.lit(False))
        if len(words) == 1:
            return self.term(name, words[0], boost, tok)
        if node.kind == "phrase" and node.n:
            match = intervals.sloppy(tok, words, node.n)
        else:
            every = reduce(lambda a, b: a & b, [F.array_contains(tok, w) for w in dict.fromkeys(words)])
            match = F.coalesce(every & self.adjacent(name, tok, words), F.lit(False))
        parts = [self.term(name, w, boost, tok) for w in dict.fromkeys(words)]
        return Compiled(match, lambda s: F.when(match, reduce(lambda a, b: a + b, [p.score(s) for p in parts])).otherwise(0.0), need=all_of([p.need for p in parts]))

    def adjacent(self, name: str, tok: Column, words: list[str]) -> Column:
        """Whether the tokens hold the words in a row, in one pass.

        Tokens of letters and digits alone are joined with a control character, so that a text search finds the row of
        words; other tokens are compared slice by slice.
        """
        rest = analysis.steps(self.search_field(name)[1] or "whitespace", self.config)
        if "tok_standard" in rest and not any(s.startswith("shingle") for s in rest):
            mark, gap = "\x1f", "\x1e"
            return F.contains(F.concat(F.lit(mark), F.array_join(tok, mark, gap), F.lit(mark)), F.lit(mark + mark.join(words) + mark))
        want, n = F.array(*map(F.lit, words)), len(words)
        return F.exists(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(tok) - (n - 1))), lambda i: F.slice(tok, i, n) == want)

    def term(self, name: str, word: str, boost: float, tok: Column) -> Compiled:
        self.terms.add((name, word))
        match = F.coalesce(F.array_contains(tok, word), F.lit(False))
        kind = self.similarity.get(name, "bm25")

        def score(s: dict) -> Column:
            tf = (F.size(tok) - F.size(F.array_remove(tok, word))).cast("double")
            n, df, mean = s["n"], s[("df", name, word)], s[("mean", name)] or 1.0
            size = self.size(name, tok).cast("double")
            value = similarity(kind, tf, size, n, df, mean)
            return F.when(match, value * F.lit(boost)).otherwise(0.0)

        return Compiled(match, score, need=self.holds(name, word))

    def size(self, name: str, tok: Column) -> Column:
        """The number of tokens; gaps of stopped words and between the values of lists don't count."""
        f, analyzer = self.search_field(name)
        gaps = self.is_list(f) or any(x.startswith("stop") for x in analysis.steps(analyzer or "whitespace", self.config))
        return F.size(F.filter(tok, lambda t: t.isNotNull())) if gaps else F.size(tok)

    def length(self, bars: str, name: str, node: lang.Node, boost: float) -> Compiled:
        found = self.search_field(name) or ((self.config.stored(name), "") if self.config.stored(name) else None)
        if not found:
            return self.constant(F.lit(False))
        f = found[0]
        of = self.values(f)
        if bars == "|":
            return self.constant(F.exists(F.transform(of, lambda v: F.char_length(v.cast("string"))), lambda n: self.compare(n, "INT", node)), boost)
        return self.constant(F.when(self.stored(f).isNotNull(), self.compare(F.size(of) if self.is_list(f) else F.lit(1), "INT", node)), boost)

    def compare(self, x: Column, kind: str, node: lang.Node) -> Column:
        """x against a term or range; malformed numbers match nothing."""

        def number(t: str):
            t = t.replace(",", "")
            if not re.fullmatch(r"[+-]?\d+" if kind in _LIMITS else r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", t):
                return None
            v = int(t) if kind in _LIMITS else float(t)
            return v if kind not in _LIMITS or -_LIMITS[kind] - 1 <= v <= _LIMITS[kind] else None

        lit = lambda v: F.lit(v).cast(_CAST[kind])
        if isinstance(node, lang.Text):
            v = number(node.text)
            return F.lit(False) if v is None or node.kind not in ("term", "phrase") else x == lit(v)
        test = F.lit(True)
        for t, closed, low in ((node.low, node.with_low, True), (node.high, node.with_high, False)):
            if t == "*":
                continue
            v = number(t)
            if v is None or (kind in _LIMITS and not closed and v == (_LIMITS[kind] if low else -_LIMITS[kind] - 1)):
                return F.lit(False)
            test &= (x >= lit(v) if closed else x > lit(v)) if low else (x <= lit(v) if closed else x < lit(v))
        return test

    def typed(self, f: FieldConfig, node: lang.Node) -> Column:
        if f.type in NUMBERS:
            if isinstance(node, lang.Range) and node.low == node.high == "*":
                return self.any(f, lambda x: x.isNotNull())
            return self.any(f, lambda x: self.compare(x, f.type, node))
        if f.type == "BOOL":
            t = node.text.strip().lower() if isinstance(node, lang.Text) else ""
            return self.any(f, lambda x: x == F.lit(t in _YES)) if t in _YES | _NO else F.lit(False)
        if isinstance(node, lang.Text):
            node = lang.Range("", node.text, node.text, True, True)
        b = dates.bounds(node.low, node.high, node.with_low, node.with_high)
        if b is None:
            return F.lit(False)
        lo, hi = (None if t is None else F.lit(t) for t in b)
        return self.any(f, lambda x: (F.lit(True) if lo is None else x >= lo) & (F.lit(True) if hi is None else x <= hi) & x.isNotNull())

    def numbers(self, f: FieldConfig, values: tuple[str, ...]) -> Column:
        if f.type not in NUMBERS:
            raise QueryError(f"{f.name}: a numeric set needs a numeric field")
        try:
            got = [int(v) if f.type in _LIMITS else float(v) for v in values]
        except ValueError:
            raise QueryError(f"{f.name}: {values} aren't all {f.type} numbers") from None
        if not got:
            raise QueryError(f"{f.name}: an empty set")
        return self.any(f, lambda x: x.isin(got))

    def raw_terms(self, name: str, values: tuple[str, ...]) -> Column:
        f, analyzer = self.search_field(name)
        if f.type != "STRING":
            raise QueryError(f"{name}: a term set needs a STRING field")
        if analyzer == "keyword" and not self.is_list(f):
            return self.stored(f).isin(list(values))
        return F.arrays_overlap(F.filter(self.tokens(name), lambda t: t.isNotNull()), F.array(*map(F.lit, values)))

    def place(self, node: lang.Geo) -> Column:
        f = self.config.stored(node.fields)
        if not f or f.type != "GEO_POINT":
            raise QueryError(f"{node.fields} isn't a place")
        lat, lon = self.point(f)
        if node.box:
            south, north, west, east = node.values
            return geo.in_box(lat, lon, south, north, west, east)
        return geo.distance_km(lat, lon, *node.values[:2]) <= node.values[2]

    def point(self, f: FieldConfig) -> tuple[Column, Column]:
        """Latitude and longitude of a struct with these keys, of a GeoJSON point, or of top-level columns."""
        if f.name not in self.df.columns:
            return F.col(f.lat_key).cast("double"), F.col(f.lon_key).cast("double")
        t = self.df.select(f.name).schema[0].dataType
        if isinstance(t, T.StructType) and "coordinates" in t.names:
            return F.get(F.col(f"{f.name}.coordinates"), 1).cast("double"), F.get(F.col(f"{f.name}.coordinates"), 0).cast("double")
        return F.col(f"{f.name}.{f.lat_key}").cast("double"), F.col(f"{f.name}.{f.lon_key}").cast("double")

    # statistics

    def statistics(self) -> dict:
        """Rows, mean lengths, and how many rows hold each term that was asked for: one aggregation.

        A few terms are each looked for in a row's tokens. More would cost a pass over the tokens each, so a row's tokens
        meet all of them at once, and rows are counted by term: at most one row for each term reaches the driver.
        """
        if not self.terms:
            return {"n": 0}
        pairs = sorted(self.terms)
        names = sorted({f for f, _ in pairs})
        self.made |= set(names)
        tok = self.prepared(self.df).select(*(self.tokens(f).alias(f"t{i}") for i, f in enumerate(names)))
        at = {f: F.col(f"t{i}") for i, f in enumerate(names)}
        sizes = [F.when(F.size(at[f]) > 0, self.size(f, at[f])) for f in names]
        if len(pairs) <= FEW_TERMS:
            held = [F.count_if(F.array_contains(at[f], w)).alias(f"d{i}") for i, (f, w) in enumerate(pairs)]
            r = tok.agg(F.count("*").alias("n"), *(F.avg(x).alias(f"m{i}") for i, x in enumerate(sizes)), *held).first()
            df = {p: r[f"d{i}"] for i, p in enumerate(pairs)}
        else:
            # (field, term) for each term that the row holds, and (null, null) for the row itself
            found = [F.transform(F.array_distinct(F.filter(at[f], one_of([w for g, w in pairs if g == f]))), of_field(i)) for i, f in enumerate(names)]
            row = F.array(F.struct(F.lit(None).cast("int").alias("field"), F.lit(None).cast("string").alias("term")))
            some = F.concat(row, *(F.coalesce(x, F.slice(row, 1, 0)) for x in found))
            one = tok.select(F.inline(some), *(x.alias(f"s{i}") for i, x in enumerate(sizes)))
            rows = one.groupBy("field", "term").agg(F.count("*").alias("n"), *(F.avg(f"s{i}").alias(f"m{i}") for i in range(len(names)))).collect()
            counts = {(r.field, r.term): r.n for r in rows}
            r = next((r for r in rows if r.field is None), None) or Row(n=0, **{f"m{i}": None for i in range(len(names))})
            df = {(f, w): counts.get((names.index(f), w), 0) for f, w in pairs}
        out: dict = {"n": r.n} | {("mean", f): r[f"m{i}"] for i, f in enumerate(names)}
        return out | {("df", f, w): n for (f, w), n in df.items()}


#: So many terms are looked for one by one in a row's tokens.
FEW_TERMS = 8


def of_field(i: int) -> Callable[[Column], Column]:
    return lambda x: F.struct(F.lit(i).alias("field"), x.alias("term"))


def one_of(words: list[str]) -> Callable[[Column], Column]:
    """A test of a token against words, by a set that is made once."""
    return lambda t: t.isin(words)


K1, B = 1.2, 0.75


def bm25_idf(n: int, df: int) -> float:
    return math.log(1 + (n - df + 0.5) / (df + 0.5))


def bm25(idf: Column, tf: Column, size: Column, mean: float) -> Column:
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / F.lit(float(mean))))


def similarity(kind: str, tf: Column, size: Column, n: int, df: int, mean: float) -> Column:
    """bm25 and tfidf in their textbook forms, tf, or constant."""
    if kind == "bm25":
        return bm25(F.lit(bm25_idf(n, df)), tf, size, mean)
    if kind == "tfidf":
        return F.sqrt(tf) * F.lit((1 + math.log((n + 1) / (df + 1))) ** 2) / F.sqrt(size)
    if kind == "tf":
        return tf
    if kind == "constant":
        return F.lit(1.0)
    raise QueryError(f"unknown similarity {kind}")
