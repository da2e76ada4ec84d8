"""Text analysis: every step works on a column of token arrays and on a Python list, with one definition.

Tokens of query text run through the Python side, stored text through Spark's own functions.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from fathom.config import IndexConfig, QueryError
from fathom.functions.english import english_stem

STOP = ("a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with")
BRITISH = {"colour": "color", "colours": "colors", "favour": "favor", "favourite": "favorite", "honour": "honor", "labour": "labor", "neighbour": "neighbor", "tumour": "tumor", "tumours": "tumors", "behaviour": "behavior", "centre": "center", "centres": "centers", "theatre": "theater", "metre": "meter", "litre": "liter", "fibre": "fiber", "analyse": "analyze", "analysed": "analyzed", "organise": "organize", "organisation": "organization", "realise": "realize", "recognise": "recognize", "catalogue": "catalog", "dialogue": "dialog", "defence": "defense", "licence": "license", "grey": "gray", "programme": "program", "travelled": "traveled", "travelling": "traveling", "anaemia": "anemia", "haemoglobin": "hemoglobin", "oestrogen": "estrogen", "paediatric": "pediatric", "leukaemia": "leukemia"}
WORD_PATTERN = r"[\p{L}\p{N}_]+"
GAP = 100  # positions between the values of a list


def _fold_table() -> tuple[str, str, dict[str, str]]:
    """Single letters that fold to one ASCII letter, and those that fold to more."""
    one, many = {}, {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "TH"}
    for c in map(chr, range(0xC0, 0x250)):
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if len(base) == 1 and base.isascii():
            one[c] = base
    one |= {"ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L", "ı": "i"}
    return "".join(one), "".join(one.values()), many


_FROM, _TO, _MANY = _fold_table()
_FOLD = str.maketrans(dict(zip(_FROM, _TO, strict=True)))


def fold(c: Column) -> Column:
    """ASCII folding of a string column."""
    c = F.translate(c, _FROM, _TO)
    for a, b in _MANY.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def fold_text(s: str) -> str:
    s = s.translate(_FOLD)
    for a, b in _MANY.items():
        s = s.replace(a, b)
    return s


def min_stem(w: str) -> str:
    """Plural endings only."""
    if len(w) > 3 and w.endswith("s"):
        if w.endswith("ies") and w[-4] not in "ae":
            return w[:-3] + "y"
        if w.endswith("es") and w[-3] in "aeo":
            return w
        if w[-2] not in "us":
            return w[:-1]
    return w


def _min_stem(x: Column) -> Column:
    drop = lambda n: F.substr(x, F.lit(1), F.length(x) - n)
    y = F.when(x.rlike("[^ae]ies$"), F.concat(drop(3), F.lit("y"))).when(x.rlike("[aeo]es$"), x).when(x.rlike("[^us]s$"), drop(1)).otherwise(x)
    return F.when((F.length(x) > 3) & x.endswith("s"), y).otherwise(x)


_VOWEL = re.compile(r"[aeiouy]")


def inflect_stem(w: str) -> str:
    """Plurals, past and progressive forms; derivations stay."""
    if len(w) <= 3 or not w.isalpha():
        return w
    w = w[:-2] if w.endswith("sses") or (w.endswith("ies") and len(w) < 5) else w[:-3] + "y" if w.endswith("ies") else w if w.endswith(("ss", "us", "is")) else w[:-1] if w.endswith("s") else w
    for end in ("ing", "ed"):
        stem = w[: -len(end)]
        if w.endswith(end) and _VOWEL.search(stem) and len(stem) > 2:
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if len(stem) > 2 and stem[-1] == stem[-2] and stem[-1] not in "lsz":
                return stem[:-1]
            return stem
    return w


def _each(native: Callable[[Column], Column], python: Callable[[str], str]):
    return (lambda a: F.transform(a, native)), (lambda ts: [python(t) for t in ts])


def _shingle(n: int):
    def native(a: Column) -> Column:
        some = F.transform(F.sequence(F.lit(1), F.size(a) - (n - 1)), lambda i: F.array_join(F.slice(a, i, n), " "))
        return F.when(F.size(a) >= n, some).when(a.isNotNull(), F.array().cast("array<string>"))

    return native, lambda ts: [" ".join(ts[i : i + n]) for i in range(len(ts) - n + 1)]


def _german(s: str) -> str:
    return re.sub("[äöü]|ae|oe|(?<![q])ue|ß", lambda m: {"ä": "a", "ö": "o", "ü": "u", "ae": "a", "oe": "o", "ue": "u", "ß": "ss"}[m[0]], s)


def _german_column(x: Column) -> Column:
    for a, b in (("ä", "a"), ("ö", "o"), ("ü", "u"), ("ae", "a"), ("oe", "o"), ("(?<!q)ue", "u"), ("ß", "ss")):
        x = F.regexp_replace(x, a, b)
    return x


def _british_column(x: Column) -> Column:
    table = F.create_map(*[F.lit(y) for kv in BRITISH.items() for y in kv])
    return F.coalesce(F.try_element_at(table, x), x)


def _stop(words: tuple[str, ...]):
    return (lambda a: F.transform(a, lambda x: F.when(~x.isin(*words), x))), (lambda ts: [None if t in words else t for t in ts])


#: A step `stop_file:<path>` takes the stop words from a file, one a line, in place of the built-in ones.
STOP_FILE = "stop_file:"


def filter_of(step: str) -> tuple[Callable, Callable]:
    if not step.startswith(STOP_FILE):
        return FILTERS[step]
    words = {w.strip() for w in Path(step.removeprefix(STOP_FILE)).read_text("utf-8").splitlines()}
    return _stop(tuple(sorted(words - {""})) or ("",))


_POSSESSIVE = "['’][sS]$"
PYTHON_STEPS = ("kstem", "snowball")


@lru_cache(1 << 16)
def _known(stem: Callable[[str], str], word: str) -> str:
    return stem(word)


#: Steps on tokens: (on a column of arrays, on a list).
FILTERS: dict[str, tuple[Callable, Callable]] = {
    "lower": _each(F.lower, str.lower),
    "upper": _each(F.upper, str.upper),
    "ascii": _each(fold, fold_text),
    "stop": _stop(STOP),
    "possessive": _each(lambda x: F.regexp_replace(x, _POSSESSIVE, ""), lambda t: re.sub(_POSSESSIVE, "", t)),
    "min_stem": _each(_min_stem, min_stem),
    "kstem": (None, lambda ts: [_known(inflect_stem, t) for t in ts]),
    "snowball": (None, lambda ts: [_known(english_stem, t) for t in ts]),
    "british_us": _each(_british_column, lambda t: BRITISH.get(t, t)),
    "concat_all": _each(lambda x: F.regexp_replace(x, r"[^\p{L}\p{N}]", ""), lambda t: re.sub(r"[\W_]", "", t)),
    "german": _each(_german_column, _german),
    **{f"shingle{n}": _shingle(n) for n in (2, 3, 4, 5)},
}


def _protected(step: str):
    native, python = filter_of(step)
    native = native or (lambda a: a)
    return (lambda a: F.transform(F.arrays_zip(a.alias("x"), native(a).alias("y")), lambda z: F.when(z["x"] == "AIDS", z["x"]).otherwise(z["y"]))), (lambda ts: [t if t == "AIDS" else u for t, u in zip(ts, python(ts), strict=True)])


#: Whole-text steps before the tokenizer, and tokenizers.
def strip_html(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]*>", "")


TOKENIZERS: dict[str, tuple[Callable, Callable]] = {
    "tok_standard": (lambda c: F.regexp_extract_all(c, F.lit(WORD_PATTERN + "+"), F.lit(0)), lambda s: re.findall(r"\w+", s)),
    "tok_whitespace": (lambda c: F.filter(F.split(c, r"\s+"), lambda x: x != ""), str.split),
    "tok_keyword": (lambda c: F.when(c.isNotNull(), F.array(c)), lambda s: [s]),
}
NAMED: dict[str, tuple[str, ...]] = {
    "keyword": ("tok_keyword",),
    "lcKeyword": ("tok_keyword", "lower"),
    "lcConcatAll": ("tok_keyword", "ascii", "lower", "concat_all"),
    "standard": ("tok_standard", "lower"),
    "standardHtml": ("html", "tok_standard", "lower"),
    "whitespace": ("tok_whitespace",),
    "minStem": ("tok_standard", "lower", "ascii", "possessive", "min_stem"),
    "kstem": ("tok_standard", "lower", "ascii", "kstem"),
    "lsh": ("tok_standard", "lower", "ascii", "kstem", "stop", "shingle5"),
    "twoTwoShingle": ("tok_standard", "lower", "ascii", "shingle2"),
    "threeThreeShingle": ("tok_standard", "lower", "ascii", "shingle3"),
}


def steps(name: str, config: IndexConfig | None = None) -> tuple[str, ...]:
    """The steps of an analyzer; those of the index come before the built-in ones."""
    found = (config.analyzers.get(name) if config else None) or NAMED.get(name)
    if not found:
        raise QueryError(f"unknown analyzer {name}")
    return tuple(found)


def tokens(c: Column, name: str, config: IndexConfig | None = None) -> Column:
    """An array of tokens for a string column; null for null. Stopped tokens leave null gaps that keep positions."""
    protect, todo = False, steps(name, config)
    for i, s in enumerate(todo):
        if s in PYTHON_STEPS:  # from here on in Python, as Spark's lambdas don't take its results
            return _in_python(c, todo[i:], protect)
        if s == "html":
            c = strip_html(c)
        elif s in TOKENIZERS:
            c = TOKENIZERS[s][0](c)
        elif s == "case_protect":
            protect = True
        else:
            c = (_protected(s) if protect else filter_of(s))[0](c)
    return c


def _apply(out: list, todo: tuple[str, ...], protect: bool = False) -> list:
    for s in todo:
        if s == "case_protect":
            protect = True
            continue
        f = (_protected(s) if protect else filter_of(s))[1]
        if s == "stop" or s.startswith(STOP_FILE):
            out = f(out)
        elif s.startswith("shingle"):
            out = f([t for t in out if t is not None])
        else:
            out = [None if t is None else f([t])[0] for t in out]
    return out


def _in_python(c: Column, todo: tuple[str, ...], protect: bool) -> Column:
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda a: None if a is None else _apply(list(a), todo, protect))

    return F.pandas_udf(run, "array<string>")(c)


def in_python(name: str, config: IndexConfig | None = None) -> bool:
    """Whether an analyzer has steps in Python, so that its tokens must be a column before lambdas use them."""
    return any(s in PYTHON_STEPS for s in steps(name, config))


def query_tokens(text: str, name: str, config: IndexConfig | None = None) -> list[str | None]:
    """The same tokens for a piece of query text."""
    todo, out = list(steps(name, config)), []
    while todo and (todo[0] == "html" or todo[0] in TOKENIZERS):
        s = todo.pop(0)
        if s == "html":
            text = re.sub("<[^>]*>", "", text)
        else:
            out = TOKENIZERS[s][1](text)
    return _apply(out, tuple(todo))


def minhash(shingles: Column, size: int = 32) -> Column:
    """Per seed the least hash of the shingles: a signature whose agreement estimates Jaccard similarity."""
    return F.transform(F.sequence(F.lit(1), F.lit(size)), lambda s: F.array_min(F.transform(shingles, lambda x: F.xxhash64(s, x))))
