"""Dates in queries: partial dates are periods in UTC, and ranges over them have their own end rules."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta

_PART = re.compile(r"^(\d{4})(?:[-/](\d{1,2})(?:[-/](\d{1,2}))?)?$")
_MICRO = timedelta(microseconds=1)


def period(text: str) -> tuple[datetime, datetime] | None:
    """First and last instant that a date text stands for; None if it can't be read."""
    m = _PART.match(text.strip())
    try:
        if m:
            y, mo, d = (int(x) if x else None for x in m.groups())
            low = datetime(y, mo or 1, d or 1, tzinfo=UTC)
            if d:
                high = low + timedelta(days=1)
            elif mo:
                high = datetime(y + (mo == 12), mo % 12 + 1, 1, tzinfo=UTC)
            else:
                high = datetime(y + 1, 1, 1, tzinfo=UTC)
            return low, high - _MICRO
        at = datetime.fromisoformat(text.strip().replace("Z", "+00:00"))
        at = at if at.tzinfo else at.replace(tzinfo=UTC)
        return at, at
    except (ValueError, OverflowError):
        return None


def bounds(low: str, high: str, with_low: bool, with_high: bool) -> tuple[datetime | None, datetime | None] | None:
    """Inclusive instants of a range; None on a side means open, None in all means that nothing can match.

    An inclusive low is the period's start, an exclusive one lies after its end; likewise for high.
    """
    lo = hi = None
    if low != "*":
        p = period(low)
        if not p:
            return None
        lo = p[0] if with_low else p[1] + _MICRO
    if high != "*":
        p = period(high)
        if not p:
            return None
        hi = p[1] if with_high else p[0] - _MICRO
    return lo, hi
