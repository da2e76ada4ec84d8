"""Deletes runs of lines that occurred before: winnowing over line hashes."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fathom.llm import exchange as X
from fathom.llm import hashing as H
from fathom.llm.common import pieces

SCHEMA = "doc_id long, n_lines long, n_removed long, n_runs long, text string, kept_sha256 string"


def _lines(t: pa.Table):
    """Hashes of the lines that aren't blank, their text's number, and all lines' spans."""
    ids, t = X.in_order(t)
    buf, at = H.text_block(t.column("text"))
    start, end, doc = H.lines_of(buf, at)
    seen = np.concatenate([np.zeros(1, np.int32), np.cumsum(~H.SPACE[buf], dtype=np.int32)])
    return ids, t, buf, at, start, end, doc, np.flatnonzero(seen[end] > seen[start])


def _fingerprints(h: np.ndarray, doc: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every window of `run` lines of one text: its start, and the line with the least hash (the last, if tied)."""
    n = len(h) - run + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.arange(n)
    for k in range(1, run):
        at = np.where(h[k : k + n] <= h[at], np.arange(k, k + n), at)
    own = np.flatnonzero(doc[:n] == doc[run - 1 :])
    return own, at[own]


def dedup_lines(docs: DataFrame, run: int = 2, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document with the text that remains, where runs of `run` or more lines that occurred before are gone.

    Lines end at newlines; lines of white space only are kept, and lines on both sides of them count as neighbours.
    A window of `run` lines is late if the same lines also start in a document with a smaller doc_id, or earlier in
    its own. Every line that a late window covers goes, so repeated runs of any greater length go whole.
    Each window's least line hash is its fingerprint: equal windows have equal ones. Fingerprints found once in the
    corpus settle their windows at once; the others are extended to the whole windows around them, compared by 128 bits.

    Null texts count as empty and stay null; empty tables give no rows. Rows that repeat a doc_id are ordered by text.
    Rows without doc_id come after all others. Columns in `keep` are handed on under their names; others go.
    """
    size = pieces(docs, "text", X.BLOCK_BYTES)
    buckets = max(1, size // 8)

    def found(t: pa.Table):
        ids, t, buf, at, start, end, doc, real = _lines(t)
        h = H.spans_hash(buf, start[real], end[real])
        own, least = _fingerprints(h, doc[real], run)
        return ids, t, buf, at, start, end, doc, real, h, own, least

    def first(blk: int, t: pa.Table) -> pa.Table:
        *_, h, own, least = found(t)
        keys = h[np.unique(least)]
        one, group = X.distinct(keys)
        many = np.bincount(group, minlength=len(one)) > 1
        return X.messages(X.ask(blk, buckets, keys[one], tail=lambda i, j: X.pack(many[i:j])))

    def windows(t: pa.Table, shared):
        ids, t, buf, at, start, end, doc, real, h, own, least = found(t)
        keys, group = np.unique(h[least], return_inverse=True)
        bits = shared(keys)
        own = own[bits[group]] if len(own) else own
        second = H.spans_hash(buf, start[real], end[real], 1)
        a, b = H.windows_hash(h, run), H.windows_hash(second, run, 1)
        return ids, t, buf, at, start, end, doc, real, own, a[own], b[own], bits

    def second(blk: int, t: pa.Table, said: pa.Table) -> pa.Table:
        ids, _, _, _, _, _, doc, real, own, a, b, bits = windows(t, lambda keys: X.bits_of(X.answers(said)[1], keys, buckets))
        one, _ = X.distinct(a, b)
        return X.messages([X.echo(blk, buckets, X.pack(bits)), *X.ask(blk, buckets, a[one], b[one], ids[doc[real[own[one]]]].view(np.uint64))])

    def last(blk: int, t: pa.Table, said: pa.Table) -> pa.Table:
        echoed, answers = X.answers(said)
        ids, t, buf, at, start, end, doc, real, own, a, b, _ = windows(t, lambda keys: X.unpack(echoed, len(keys)) if echoed else np.zeros(len(keys), bool))
        one, group = X.distinct(a, b)
        late = X.bits_of(answers, a[one], buckets)[group] if len(own) else np.zeros(0, bool)
        is_first = np.zeros(len(own), bool)
        is_first[one] = True
        late |= ~is_first
        cover = np.zeros(len(real) + 1, np.int64)
        np.add.at(cover, own[late], 1)
        np.add.at(cover, own[late] + run, -1)
        gone = np.zeros(len(start), bool)
        gone[real] = np.cumsum(cover[:-1]) > 0
        rows, n = [], t.num_rows
        edge = np.searchsorted(doc, np.arange(n + 1))
        went = gone[real]
        begins = went & ~np.concatenate([[False], went[:-1] & (doc[real][1:] == doc[real][:-1])]) if len(real) else went
        count = lambda of: np.bincount(doc[of], minlength=n) if len(of) else np.zeros(n, np.int64)
        n_lines, n_gone, n_runs = count(real), count(real[went]), count(real[begins])
        data, texts = buf.tobytes(), t.column("text")
        for i in range(n):
            if n_gone[i]:
                text = b"\n".join(data[start[j] : end[j]] for j in range(edge[i], edge[i + 1]) if not gone[j])
            else:
                text = data[at[i] : at[i + 1]]
            rows.append((text.decode("utf-8", "replace") if texts[i].is_valid else None, hashlib.sha256(text).hexdigest()))
        out = {"doc_id": t.column("doc_id"), "n_lines": pa.array(n_lines, pa.int64()), "n_removed": pa.array(n_gone, pa.int64()), "n_runs": pa.array(n_runs, pa.int64()), "text": pa.array([r[0] for r in rows], pa.string()), "kept_sha256": pa.array([r[1] for r in rows], pa.string())}
        return pa.table(out | {f"keep{i}": t.column(f"keep{i}") for i in range(len(keep))})

    kinds = dict(docs.dtypes)
    schema = ", ".join([SCHEMA, *(f"keep{i} {kinds[c]}" for i, c in enumerate(keep))])
    out = X.rounds(X.blocked(docs, size, keep), first, second, last, schema, X.elsewhere(1), X.earlier)
    return out.withColumnsRenamed({f"keep{i}": c for i, c in enumerate(keep)})
