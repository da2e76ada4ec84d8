"""Secrets in texts: three base patterns, and weak parts of credentials that count only together."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm import hashing as H

KINDS = ("assign", "access", "hex", "weak_access", "weak_secret", "endpoint")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
NAMED = re.compile(r"""(?:access_?key(?:_?id)?|client_?id|user(?:name)?|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{4,})""", re.I | re.A)
HOST = re.compile(r"""[a-z][a-z0-9+.-]{1,20}://[^\s"'<>]{4,}|(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?([A-Za-z0-9.-]{4,}(?::[0-9]+)?)""", re.I | re.A)
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/]{20,}={0,2}", re.A)
HINTS = (b"passw", b"secret", b"token", b"apikey", b"api_key", b"akia", b"access", b"client", b"user", b"login", b"://", b"host", b"endpoint", b"server")
#: Characters between parts of one credential, in one scope; a blank line ends a scope.
REACH = 400
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, by start."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 16]
    return sorted(out)


def overlapping(parts: list[tuple[int, int]]):
    """A test of spans: does one of the parts overlap it?"""
    parts = sorted(parts)
    starts, most = [p[0] for p in parts], []
    for _, e in parts:
        most.append(max(e, most[-1] if most else e))

    def test(s: int, e: int) -> bool:
        i = bisect_left(starts, e)
        return i > 0 and most[i - 1] > s

    return test


def linked_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Weak parts that complete a credential: an identifier and a secret within reach of each other in one scope.

    Parts that meet are disjoint, so no string completes itself, and an opaque string inside another part is that part.

    Identifiers: AKIA keys (weak if short) and named ids. Secrets: assigned values (weak if short), long hex, and weak
    opaque strings of 20 or more letters and digits of all three sorts. An endpoint counts if both others are in reach.
    """
    ids = [(s, e) for s, k, e in base if k == 1]
    weak_ids = [m.span() for m in ACCESS.finditer(text) if 8 <= m.end() - m.start() < 18] + [m.span() for m in NAMED.finditer(text)]
    if not ids and not weak_ids:
        return []
    secrets = [(s, e) for s, k, e in base if k in (0, 2)]
    weak = [m.span() for m in ASSIGN.finditer(text) if 4 <= len(m[2]) < 12]
    taken = overlapping([(s, e) for s, _, e in base] + weak_ids + weak)
    weak += [m.span() for m in OPAQUE.finditer(text) if not taken(*m.span()) and re.search("[a-z]", m[0]) and re.search("[A-Z]", m[0]) and re.search("[0-9]", m[0]) and not m[0].startswith("AKIA")]
    if not secrets and not weak:
        return []
    breaks = [m.start() for m in re.finditer(r"\n[\x20\t]*\n", text)]
    scope = lambda s: bisect_left(breaks, s)

    def meets(parts: list[tuple[int, int]]):
        """Whether a span has one of the parts in reach; the nearest one on each side that doesn't overlap it decides."""
        starts, ends = sorted(p[0] for p in parts), sorted((p[1], p[0]) for p in parts)

        def near(s: int, e: int) -> bool:
            i = bisect_left(starts, e)
            if i < len(starts) and starts[i] - e <= REACH and scope(starts[i]) == scope(s):
                return True
            j = bisect_left(ends, (s + 1,)) - 1
            return j >= 0 and s - ends[j][0] <= REACH and scope(ends[j][1]) == scope(s)

        return near

    has_id, has_secret = meets(ids + weak_ids), meets(secrets + weak)
    out = [(s, 3, e) for s, e in set(weak_ids) if has_secret(s, e)]
    out += [(s, 4, e) for s, e in set(weak) if has_id(s, e)]
    out += [(m.start(), 5, m.end()) for m in HOST.finditer(text) if has_id(*m.span()) and has_secret(*m.span())]
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row per document: counts and digest of the base spans, and all spans, as kind:start:end in code points.

    Base patterns match leftmost and without overlaps, each kind for itself; short matches are dropped. The linking
    step joins identifiers, secrets and endpoints by interval within scopes and adds weak ones (`linked_spans`).
    Bytes are screened in bulk first: only texts with a hint word or sixteen hex digits in a row are matched.

    Null texts count as empty. Repeated rows give repeated results; empty tables none. Other columns go.
    """
    hexes = np.zeros(256, bool)
    hexes[[*range(48, 58), *range(97, 103)]] = True
    nothing = hashlib.sha256(b"").hexdigest()

    def run(batches):
        for whole in batches:
            for b in H.slices(whole):
                buf, at = H.text_block(b.column(1))
                n = b.num_rows
                seen = np.concatenate([[0], np.cumsum(~hexes[buf])])
                wanted = np.zeros(n, bool)
                if len(buf) >= 16:
                    long = np.flatnonzero(seen[16:] == seen[:-16])
                    wanted[np.searchsorted(at, long, "right") - 1] = True
                data, low = buf.tobytes(), H.LOWER[buf].tobytes()
                for hint in HINTS:
                    i = low.find(hint)
                    while i >= 0:
                        d = int(np.searchsorted(at, i, "right")) - 1
                        wanted[d] = True
                        i = low.find(hint, max(int(at[d + 1]) - len(hint) + 1, i + 1))
                counts, digest, spans = np.zeros((3, n), np.int64), [nothing] * n, [""] * n
                for d in np.flatnonzero(wanted).tolist():
                    text = data[at[d] : at[d + 1]].decode("utf-8", "replace")
                    base = base_spans(text)
                    more = linked_spans(text, base)
                    for _, k, _ in base:
                        counts[k, d] += 1
                    digest[d] = hashlib.sha256(joined(base).encode()).hexdigest()
                    spans[d] = joined(base + more)
                yield pa.record_batch({"doc_id": b.column(0), **{f"n_{k}": pa.array(c) for k, c in zip(KINDS, counts, strict=False)}, "base_sha256": pa.array(digest, pa.string()), "spans": pa.array(spans, pa.string())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
