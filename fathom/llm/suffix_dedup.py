"""Removes bytes of passages that an earlier document has: run-compressed indexes over routed segments."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fathom.llm import exchange as X
from fathom.llm import hashing as H
from fathom.llm.common import pieces
from fathom.llm.run_index import RunIndex, ranges

#: Bytes of text in a block; a bucket takes the segments of four.
BLOCK_BYTES = 1 << 20
#: Bytes of segments in one index: a bucket makes several, each over whole grams.
INDEX_BYTES = 1 << 18
#: A key in more blocks than this is hot: windows around it are dealt by their own hashes, not by their gram.
HOT_BLOCKS = 1024
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def grams(buf: np.ndarray, gram: int) -> np.ndarray:
    return H.bytes_hash(buf, gram, 0)


def sliding(op, whole: np.ndarray, wide: int, out: np.ndarray) -> None:
    """op (minimum or maximum) over every `wide` neighbours, by doubling, a part that stays in cache at a time."""
    for i in range(0, len(out), H.CHUNK):
        x, size = whole[i : i + H.CHUNK + wide - 1], 1
        n = len(x) - wide + 1
        while 2 * size <= wide:
            x, size = op(x[:-size], x[size:]), 2 * size
        op(x[:n], x[wide - size :][:n], out=out[i : i + n])


def segments(buf: np.ndarray, at: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Maximal runs of windows with the same least gram: first window, number of windows, that gram's hash; and every
    place of a least gram with its hash.
    """
    n, wide = len(buf) - length + 1, length - gram + 1
    if n <= 0:
        z = np.zeros(0, np.int64)
        return z, z, z.astype(np.uint64), z, z.astype(np.uint64)
    h = grams(buf, gram)
    around = np.zeros(n + 2 * (wide - 1), np.uint64)
    m = around[wide - 1 : wide - 1 + n]
    sliding(np.minimum, h, wide, m)
    cross = np.zeros(n + 1, np.int64)
    ends = at[1:-1][at[1:-1] < len(buf)]
    np.add.at(cross, np.maximum(0, np.minimum(ends - length + 1, n)), 1)
    np.add.at(cross, np.minimum(ends, n), -1)
    own = np.cumsum(cross[:-1]) == 0
    new = own.copy()
    new[1:] &= ~own[:-1] | (m[1:] != m[:-1])
    start = np.flatnonzero(new)
    stop = own.copy()
    stop[:-1] &= ~own[1:] | new[1:]
    # a gram is the least of some window if the greatest of the least hashes around it is its own
    m[~own] = 0
    most = np.empty(len(h), np.uint64)
    sliding(np.maximum, around, wide, most)
    place = np.flatnonzero(most == h)
    return start, np.flatnonzero(stop) + 1 - start, m[start], place, h[place]


def least_documents(data: np.ndarray, lens: np.ndarray, docs: np.ndarray, length: int, gram: int, index_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For segments: the number of each among the distinct ones; windows of those; least doc_id with each window.

    A gram with one distinct segment settles its windows by that segment's least doc_id; the rest are indexed.
    """
    end = np.cumsum(lens)
    start = end - lens
    one, group = X.distinct(H.spans_hash(data, start, end), H.spans_hash(data, start, end, 1))
    least = np.full(len(one), X.LAST)
    np.minimum.at(least, group, docs)
    per = lens[one] - length + 1
    out = np.repeat(least, per)
    g = grams(data, gram)
    flat = g[ranges(start[one], lens[one] - gram + 1)]
    counts = lens[one] - gram + 1
    anchor = np.minimum.reduceat(flat, np.cumsum(counts) - counts)
    _, kind, many = np.unique(anchor, return_inverse=True, return_counts=True)
    some = np.flatnonzero(many[kind] > 1)
    some = some[np.argsort(kind[some], kind="stable")]
    at = np.cumsum(per) - per
    upto = np.cumsum(lens[one[some]])
    k = 0
    while k < len(some):  # whole grams, as equal windows have one
        j = max(k + 1, int(np.searchsorted(upto, (upto[k - 1] if k else 0) + index_bytes, "right")))
        j = int(np.searchsorted(kind[some], kind[some[j - 1]], "right"))
        part = some[k:j]
        index = RunIndex(data[ranges(start[one[part]], lens[one[part]])], lens[one[part]], least[part], length)
        out[ranges(at[part], per[part])] = index.stream()
        k = j
    return group, per, out


def shared_and_hot(t: pa.Table, hot_blocks: int) -> pa.Table:
    """A bucket's answers for keys of 32 bits, two arrays of bits: is it in a second document, and in many blocks?"""
    rows = t.to_pylist()
    keys = [np.frombuffer(r["a"], np.uint32) for r in rows]
    _, group = X.distinct(np.concatenate(keys))
    blocks = np.bincount(group)
    shared = blocks > 1
    shared[group[np.concatenate([X.unpack(r["b"], len(k)) for r, k in zip(rows, keys, strict=True)])]] = True
    hot, ends = blocks > hot_blocks, np.cumsum([len(k) for k in keys])
    return X.messages([(r["bucket"], r["blk"], 1, X.pack(shared[group[e - len(k) : e]]) + X.pack(hot[group[e - len(k) : e]]), b"") for r, k, e in zip(rows, keys, ends, strict=True)])


def two(data: bytes, n: int) -> np.ndarray:
    """Two arrays of n bits, packed one behind the other."""
    half = -(-n // 8)
    return np.stack([X.unpack(data[:half], n), X.unpack(data[half:], n)])


def planes(x: np.ndarray) -> bytes:
    """Whole numbers as bytes, those of equal weight together, as most are zeros, which shuffles compress."""
    return x.astype(np.int64).view(np.uint8).reshape(-1, 8).T.tobytes()


def whole(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.int64).ravel()


def heads(docs: np.ndarray, lens: np.ndarray) -> tuple[int, bytes]:
    """What a message says of its segments. Bytes of equal weight stand together, as most are zeros; kind 1: lengths of
    one byte, kind 3: of four.
    """
    short = lens.max(initial=0) < 256
    return (1 if short else 3), planes(docs) + lens.astype(np.uint8 if short else np.int32).tobytes()


def tails(kind: int, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // (9 if kind == 1 else 12)
    return whole(data[: 8 * n]), np.frombuffer(data, np.uint8 if kind == 1 else np.int32, n, 8 * n).astype(np.int64)


class Block:
    """A block of texts: its segments, and the keys that tell which of their windows may be elsewhere.

    Of a window's bytes beyond its (first) least gram, half lies on the left or on the right: with that side the gram
    is the window's key, so equal windows have equal keys.
    """

    def __init__(self, t: pa.Table, length: int, gram: int):
        self.length = length
        self.ids, self.t = X.in_order(t)
        self.buf, self.at = H.text_block(self.t.column("text"))
        self.start, self.count, self.anchor, self.place, self.value = segments(self.buf, self.at, length, gram)
        self.side = side = (length - gram) // 2
        whose = np.searchsorted(self.at, self.place, "right") - 1
        left = np.flatnonzero(self.place - side >= self.at[whose]) if len(whose) else whose
        right = np.flatnonzero(self.place + gram + side <= self.at[whose + 1]) if len(whose) else whose
        self.of = np.concatenate([left, right])
        self.keys = np.concatenate([H.bytes_hash(self.buf, gram + side, 2, x) for x in (self.place[left] - side, self.place[right])])
        self.doc = self.ids[whose[self.of]]
        self.key_at = np.full((2, len(self.place)), -1)
        self.key_at[0, right] = len(left) + np.arange(len(right))
        self.key_at[1, left] = np.arange(len(left))

    def questions(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys, and whether two documents of the block have them."""
        one, group = X.distinct(self.keys)
        most, least = np.full(len(one), -X.LAST), np.full(len(one), X.LAST)
        np.maximum.at(most, group, self.doc)
        np.minimum.at(least, group, self.doc)
        return self.keys[one], most > least

    def route(self, flags: np.ndarray) -> None:
        """flags: shared and hot for each key. Windows with shared keys stay: runs of them, or single ones if hot."""
        some = np.isin(self.anchor, self.value[self.of[flags[0]]])
        start, count, anchor = self.start[some], self.count[some], self.anchor[some]
        win, seg = ranges(start, count), np.repeat(np.arange(len(start)), count)
        k = np.searchsorted(self.place, win)
        off = np.flatnonzero(self.value[k] != anchor[seg]) if len(k) else k
        while len(off):  # places that are least for earlier windows only
            k[off] += 1
            off = off[self.value[k[off]] != anchor[seg[off]]]
        key = self.key_at[(self.place[k] - win >= self.side).astype(int), k] if len(k) else k
        shared, hot = flags[:, key]
        plain = shared & ~hot
        begins, ends = plain.copy(), plain.copy()
        begins[1:] &= ~plain[:-1] | (seg[1:] != seg[:-1])
        ends[:-1] &= ~plain[1:] | (seg[1:] != seg[:-1])
        i, j = np.flatnonzero(begins), np.flatnonzero(ends)
        self.runs, self.lens = win[i], j - i + 1
        self.hot = win[shared & hot]
        self.run_doc, self.hot_doc = (self.ids[np.searchsorted(self.at, x, "right") - 1] for x in (self.runs, self.hot))
        # least hashes are small; mixed ones deal evenly
        to, end = H.mix(anchor[seg[i]]), self.runs + self.lens + self.length - 1
        rep, of = X.distinct(H.spans_hash(self.buf, self.runs, end), H.spans_hash(self.buf, self.runs, end, 1))
        by = np.argsort(to[rep], kind="stable")
        back = np.empty(len(by), np.int64)
        back[by] = np.arange(len(by))
        self.rep, self.rep_of, self.rep_to = rep[by], back[of], to[rep[by]]
        self.rest()

    def rest(self) -> None:
        self.hot_keys = [H.spans_hash(self.buf, self.hot, self.hot + self.length, w) for w in (0, 1)]
        self.hot_one, self.hot_group = X.distinct(*self.hot_keys)

    def packed(self) -> bytes:
        """The route for the last pass: runs, which distinct one each is, and runs of hot windows."""
        new = np.diff(self.hot, prepend=-2) != 1
        hot = self.hot[new]
        many = np.diff(np.flatnonzero(new), append=len(self.hot))
        parts = [np.diff(self.runs, prepend=0), self.lens, self.rep_of, np.diff(hot, prepend=0), many]
        return np.array([len(self.runs), len(hot)], np.int64).tobytes() + b"".join(planes(x) for x in parts)


class Routed(Block):
    """A block in the last pass, of which the second has left what Block.route made."""

    def __init__(self, t: pa.Table, length: int, data: bytes):
        self.length = length
        self.ids, self.t = X.in_order(t)
        self.buf, self.at = H.text_block(self.t.column("text"))
        n, h = np.frombuffer(data, np.int64, 2).tolist() if data else (0, 0)
        cut = np.cumsum([16, 8 * n, 8 * n, 8 * n, 8 * h, 8 * h])
        step, self.lens, self.rep_of, hot, many = (whole(data[i:j]) for i, j in zip(cut[:-1], cut[1:], strict=True))
        self.runs, self.hot = np.cumsum(step), ranges(np.cumsum(hot), many)
        self.run_doc, self.hot_doc = (self.ids[np.searchsorted(self.at, x, "right") - 1] for x in (self.runs, self.hot))
        self.rep = np.full(self.rep_of.max(initial=-1) + 1, n)
        np.minimum.at(self.rep, self.rep_of, np.arange(n))
        self.rest()


def dedup_suffixes(docs: DataFrame, length: int = 50, gram: int = 24, with_text: bool = False, hot_blocks: int = HOT_BLOCKS, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """One row per document: bytes, bytes removed, removed runs, and a digest of the rest (with_text: the rest, too).

    A byte goes if a string of `length` bytes that covers it also starts in a document with a smaller doc_id. A run of
    windows with one least gram is a segment. Keys of grams with what stands on one side (see Block) are looked up
    first: windows whose key no second document has aren't repeated. The segments of the others go, each once per block
    with its block's least doc_id, to the bucket of their gram, so equal windows meet. It indexes them (see RunIndex)
    and streams the least doc_id of every window back as one bit: is it below the block's own? Around a key of more
    than `hot_blocks` blocks windows are dealt by their own hash of 128 bits instead, so no gram fills a bucket.

    Null texts count as empty, bytes may be any, and empty tables give no rows. Rows with one doc_id don't count
    against each other; rows without doc_id come after all others. Other columns go.
    """
    size = pieces(docs, "text", BLOCK_BYTES)
    buckets = indexes = max(1, size // 4)

    def first(blk: int, t: pa.Table) -> pa.Table:
        keys, many = Block(t, length, gram).questions()
        return X.messages(X.ask_short(blk, buckets, keys, lambda i, j: X.pack(many[i:j])))

    def second(blk: int, t: pa.Table, said: pa.Table) -> pa.Table:
        b = Block(t, length, gram)
        one, group = X.distinct(b.keys)
        c, got = X.cuts(b.keys[one], buckets), np.zeros((2, len(one)), bool)
        for k, data in X.answers(said)[1]:
            got[:, c[k] : c[k + 1]] = two(data, c[k + 1] - c[k])
        flags = got[:, group]
        b.route(flags)
        out = [X.echo(blk, indexes, b.packed())]
        c = X.cuts(b.rep_to, indexes)
        for k in np.flatnonzero(np.diff(c)).tolist():
            r = b.rep[c[k] : c[k + 1]]
            lens = b.lens[r] + length - 1
            out.append((k, blk, *heads(b.run_doc[r], lens), b.buf[ranges(b.runs[r], lens)].tobytes()))
        hot = X.ask(blk, indexes, b.hot_keys[0][b.hot_one], b.hot_keys[1][b.hot_one], b.hot_doc[b.hot_one].view(np.uint64))
        return X.messages(out + [(k, blk, 2, a, x) for k, blk, _, a, x in hot])

    def bucket(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        echoes, asked, hot = ([r for r in rows if r["kind"] in k] for k in ((0,), (1, 3), (2,)))
        out = [(r["bucket"], r["blk"], 0, r["a"], b"") for r in echoes]
        out += [(r["bucket"], r["blk"], 2, a, b"") for r, a in zip(hot, X.late(hot), strict=True)]
        if asked:
            ids, lens = ([x[i] for x in (tails(r["kind"], r["a"]) for r in asked)] for i in (0, 1))
            sizes = [len(x) for x in ids]
            ids, lens = np.concatenate(ids), np.concatenate(lens)
            group, per, least = least_documents(np.frombuffer(b"".join(r["b"] for r in asked), np.uint8), lens, ids, length, gram, index_bytes)
            at, count = np.cumsum(per) - per, per[group]
            late = least[ranges(at[group], count)] < np.repeat(ids, count)
            ends = np.cumsum(count)
            stops = np.concatenate([[0], ends[np.cumsum(sizes) - 1]])
            out += [(r["bucket"], r["blk"], 1, X.pack(late[i:j]), np.int64(j - i).tobytes()) for r, i, j in zip(asked, stops[:-1], stops[1:], strict=True)]
        return X.messages(out)

    def last(blk: int, t: pa.Table, said: pa.Table) -> pa.Table:
        rows = said.to_pylist()
        b = Routed(t, length, next((r["a"] for r in rows if not r["kind"]), b""))
        edge = np.concatenate([[0], np.cumsum(b.lens[b.rep])])
        told = sorted((r["bucket"], r["a"], r["b"]) for r in rows if r["kind"] == 1)
        late = np.concatenate([np.zeros(0, bool), *(X.unpack(x, int(np.frombuffer(n, np.int64)[0])) for _, x, n in told)])
        hot = X.bits_of([(r["bucket"], r["a"]) for r in rows if r["kind"] == 2], b.hot_keys[0][b.hot_one], indexes)
        hit = late[ranges(edge[:-1][b.rep_of], b.lens)] | np.repeat(b.run_doc > b.run_doc[b.rep][b.rep_of], b.lens)
        hot = hot[b.hot_group] | (b.hot_doc > b.hot_doc[b.hot_one][b.hot_group])
        where = np.concatenate([ranges(b.runs, b.lens)[hit], b.hot[hot]])
        cover = np.zeros(len(b.buf) + 1, np.int64)
        np.add.at(cover, where, 1)
        np.add.at(cover, where + length, -1)
        gone = np.cumsum(cover[:-1]) > 0
        buf, at, t = b.buf, b.at, b.t
        begins = gone.copy()
        inner = np.ones(len(buf), bool)
        inner[at[:-1][at[:-1] < len(buf)]] = False
        begins[1:] &= ~(gone[:-1] & inner[1:])
        seen, runs = np.concatenate([[0], np.cumsum(gone)]), np.concatenate([[0], np.cumsum(begins)])
        kept = buf[~gone].tobytes()
        rest = at - seen[at]
        parts = [kept[rest[i] : rest[i + 1]] for i in range(t.num_rows)]
        out = {"doc_id": t.column("doc_id"), "n_bytes": pa.array(np.diff(at), pa.int64()), "n_removed": pa.array(np.diff(seen[at]), pa.int64()), "n_spans": pa.array(np.diff(runs[at]), pa.int64()), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in parts], pa.string())}
        return pa.table(out | ({"text": pa.array([x.decode("utf-8", "replace") for x in parts], pa.string())} if with_text else {}))

    schema = SCHEMA + ", text string" * with_text
    return X.rounds(X.blocked(docs, size), first, second, last, schema, lambda t: shared_and_hot(t, hot_blocks), bucket)
