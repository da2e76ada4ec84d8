"""Removes words of long passages that occur more than once: difference-cover anchors."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fathom.llm import exchange as X
from fathom.llm import hashing as H
from fathom.llm.common import pieces

#: A perfect difference set: every residue mod 21 is a difference of two of these five.
PERIOD, COVER = 21, (0, 1, 4, 14, 16)
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def dedup_substrings(docs: DataFrame, window: int = 35, with_text: bool = False) -> DataFrame:
    """One row per document: words, words removed, and a digest of the rest (with_text: the rest itself, too).

    A word goes if a window of `window` consecutive words of its document that covers it also starts anywhere else.
    Only windows of window - 20 words that start at cover positions (word index mod 21 in a difference cover) are
    hashed over all texts, 5 in 21. Of two equal windows of `window` words at any offsets, some such anchor lies in
    both at the same offset; so anchors found once rule out all windows without a shared one. The windows around
    shared anchors extend them both ways and are compared whole, by 128 bits. No pairs are formed.

    Null texts count as empty. Repeated rows repeat their words. Empty tables give no rows; other columns go.
    """
    if window < PERIOD:
        raise ValueError(f"window must have {PERIOD} words or more")
    size, reach = pieces(docs, "text", X.BLOCK_BYTES), window - PERIOD + 1
    buckets = size

    def found(t: pa.Table):
        ids, t = X.in_order(t)
        buf, at = H.text_block(t.column("text"))
        start, end, doc = H.words_of(buf, at)
        begin = np.searchsorted(doc, np.arange(t.num_rows + 1))
        words = H.spans_hash(buf, start, end)
        n = max(0, len(words) - reach + 1)
        inside = np.isin((np.arange(n) - begin[doc[:n]]) % PERIOD, COVER)
        anchors = np.flatnonzero(inside & (doc[:n] == doc[reach - 1 :][:n])) if n else np.zeros(0, np.int64)
        return t, buf, start, end, doc, begin, words, anchors, H.windows_hash(words, reach)[anchors]

    def first(blk: int, t: pa.Table) -> pa.Table:
        *_, keys = found(t)
        one, group = X.distinct(keys)
        many = np.bincount(group, minlength=len(one)) > 1
        return X.messages(X.ask(blk, buckets, keys[one], tail=lambda i, j: X.pack(many[i:j])))

    def windows(t: pa.Table, shared):
        t, buf, start, end, doc, begin, words, anchors, keys = found(t)
        one, group = X.distinct(keys)
        bits = shared(keys[one])
        n = max(0, len(words) - window + 1)
        has = np.zeros(len(words) + 1, np.int64)
        if len(anchors):
            has[anchors[bits[group]] + 1] = 1
        has = np.cumsum(has)
        own = np.flatnonzero((has[PERIOD : PERIOD + n] > has[:n]) & (doc[:n] == doc[window - 1 :][:n])) if n else np.zeros(0, np.int64)
        more = H.spans_hash(buf, start, end, 1)
        return t, buf, start, end, doc, begin, own, H.windows_hash(words, window)[own], H.windows_hash(more, window, 1)[own], bits

    def second(blk: int, t: pa.Table, said: pa.Table) -> pa.Table:
        *_, a, b, bits = windows(t, lambda keys: X.bits_of(X.answers(said)[1], keys, buckets))
        one, group = X.distinct(a, b)
        many = np.bincount(group, minlength=len(one)) > 1
        return X.messages([X.echo(blk, buckets, X.pack(bits)), *X.ask(blk, buckets, a[one], b[one], tail=lambda i, j: X.pack(many[i:j]))])

    def last(blk: int, t: pa.Table, said: pa.Table) -> pa.Table:
        echoed, answers = X.answers(said)
        t, buf, start, end, doc, begin, own, a, b, _ = windows(t, lambda keys: X.unpack(echoed, len(keys)) if echoed else np.zeros(len(keys), bool))
        one, group = X.distinct(a, b)
        again = X.bits_of(answers, a[one], buckets)[group] if len(own) else np.zeros(0, bool)
        cover = np.zeros(len(doc) + 1, np.int64)
        np.add.at(cover, own[again], 1)
        np.add.at(cover, own[again] + window, -1)
        gone = np.cumsum(cover[:-1]) > 0
        n, rest, data = t.num_rows, [], buf.tobytes()
        for i in range(n):
            j = np.arange(begin[i], begin[i + 1])
            j = j[~gone[j]]
            rest.append(b" ".join([data[s:e] for s, e in zip(start[j].tolist(), end[j].tolist(), strict=True)]))
        out = {"doc_id": t.column("doc_id"), "n_words": pa.array(np.diff(begin), pa.int64()), "n_removed": pa.array(np.bincount(doc[gone], minlength=n), pa.int64()), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in rest], pa.string())}
        return pa.table(out | ({"text": pa.array([x.decode("utf-8", "replace") for x in rest], pa.string())} if with_text else {}))

    schema = SCHEMA + ", text string" * with_text
    return X.rounds(X.blocked(docs, size), first, second, last, schema, X.elsewhere(1), X.elsewhere(2))
