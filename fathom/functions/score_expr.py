"""Score functions: arithmetic text, parsed here and compiled to a column. No text reaches the SQL parser."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from fathom.config import QueryError

_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|([A-Za-z_$][\w.$]*)|(<=|>=|==|!=|&&|\|\||[-+*/%()<>?:,!]))")
_ONE = {"ln": F.log, "log10": F.log10, "sqrt": F.sqrt, "abs": F.abs, "exp": F.exp, "floor": F.floor, "ceil": F.ceil, "sin": F.sin, "cos": F.cos, "tan": F.tan}
_MANY = {"min": F.least, "max": F.greatest, "pow": F.pow}
_LEVELS = (("||",), ("&&",), ("==", "!="), ("<", "<=", ">", ">="), ("+", "-"), ("*", "/", "%"))


def compile_score(text: str, variable: Callable[[str], Column], geodist: Callable[[str, float, float], Column]) -> Column:
    """variable: a column for a name; geodist: the distance in km for a field and a point. Division by 0 gives null."""
    items, at = [], 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise QueryError(f"score function: can't read {text[at:]!r}")
        items.append(m.groups())
        at = m.end()
    pos = 0

    def op() -> str | None:
        return items[pos][2] if pos < len(items) else None

    def take(want: str | None = None):
        nonlocal pos
        if pos >= len(items) or (want and items[pos][2] != want):
            raise QueryError(f"score function: expected {want or 'more'} in {text!r}")
        pos += 1
        return items[pos - 1]

    def number(c: Column) -> Column:
        return c.cast("double")

    def ternary() -> Column:
        c = binary(0)
        if op() != "?":
            return c
        take("?")
        a = ternary()
        take(":")
        return F.when(number(c) != 0, a).otherwise(ternary())

    def binary(level: int) -> Column:
        if level == len(_LEVELS):
            return unary()
        left = binary(level + 1)
        while op() in _LEVELS[level]:
            o, right = take()[2], None
            right = binary(level + 1)
            a, b = number(left), number(right)
            left = {"||": lambda: (a != 0) | (b != 0), "&&": lambda: (a != 0) & (b != 0), "==": lambda: a == b, "!=": lambda: a != b, "<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b, "+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: F.try_divide(a, b), "%": lambda: F.try_mod(a, b)}[o]()
        return left

    def unary() -> Column:
        if op() == "-":
            take()
            return -number(unary())
        if op() == "!":
            take()
            return number(unary()) == 0
        if op() == "(":
            take()
            c = ternary()
            take(")")
            return c
        num, name, _ = take()
        if num:
            return F.lit(float(num))
        if not name:
            raise QueryError(f"score function: unexpected operator in {text!r}")
        if op() != "(":
            return number(variable(name))
        take("(")
        if name == "geodist":
            f = take()[1]
            values = []
            while op() == ",":
                take(",")
                sign = -1 if op() == "-" and take() else 1
                values.append(sign * float(take()[0]))
            take(")")
            return geodist(f, *values)
        args = [ternary()]
        while op() == ",":
            take(",")
            args.append(ternary())
        take(")")
        args = [number(a) for a in args]
        if name in _ONE and len(args) == 1:
            return number(_ONE[name](*args))
        if name in _MANY and len(args) >= 2:
            return _MANY[name](*args)
        raise QueryError(f"score function: unknown function {name}/{len(args)}")

    out = ternary()
    if pos != len(items):
        raise QueryError(f"score function: text after the end in {text!r}")
    return number(out)
