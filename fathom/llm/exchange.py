"""Asks, for billions of window hashes, which occur elsewhere, with Spark moving packed arrays instead of rows.

Texts are dealt into blocks by doc_id. A block sends each bucket of the hash space one packed array of its distinct
hashes, so a key as frequent as you like counts once per block: hot keys are combined before the shuffle. The bucket
answers one bit per hash. Blocks and buckets have a set size in bytes, so memory doesn't grow with the input; their
number does. All state is in shuffles and the shared checkpoint folder, so a lost executor costs recomputation only.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text in a block; bytes of hashes in a bucket are about half of it.
BLOCK_BYTES = 3 << 20
#: Rows from blocks to buckets and back. kind 0: comes back unchanged to its block; 1: a question; its answer.
MESSAGE = "bucket int, blk int, kind int, a binary, b binary"
_MESSAGE = pa.schema([("bucket", pa.int32()), ("blk", pa.int32()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])
LAST = np.iinfo(np.int64).max


def blocked(docs: DataFrame, count: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, the block by a hash of doc_id alone (rows without one by their text), and columns to keep."""
    key = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
    kept = [F.col(f"`{c}`").alias(f"keep{i}") for i, c in enumerate(keep)]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.pmod(key, F.lit(count)).cast("int").alias("blk"), *kept)


def in_order(t: pa.Table) -> tuple[np.ndarray, pa.Table]:
    """The block's rows by doc_id, ties by text, so that each pass sees the same block. Null ids count as largest."""
    ids = t.column("doc_id").fill_null(LAST).to_numpy()
    order = np.argsort(ids, kind="stable")
    same = ids[order][1:] == ids[order][:-1]
    if same.any():
        texts = t.column("text")
        key = [(int(ids[i]), texts[i].is_valid, texts[i].as_py() or "") for i in range(len(ids))]
        order = np.array(sorted(range(len(ids)), key=key.__getitem__), np.int64)
    return ids[order], t.take(pa.array(order))


def messages(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
    return pa.table([pa.array(c, f.type) for c, f in zip(cols, _MESSAGE, strict=True)], schema=_MESSAGE)


def cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where sorted 64-bit keys divide into a power of two of buckets by their high bits."""
    if buckets == 1:
        return np.array([0, len(keys)])
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    return np.searchsorted(keys >> shift, np.arange(buckets + 1, dtype=np.uint64))


def pack(bits: np.ndarray) -> bytes:
    return np.packbits(bits).tobytes()


def unpack(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def distinct(keys: np.ndarray, second: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(first, group): the distinct keys in order by their first rows, and each row's number among them."""
    order = np.argsort(keys)  # rows of equal keys in any order: quicker than a stable sort
    k = keys[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    if second is not None and not new.all():
        s = second[order]
        if (~new[1:] & (s[1:] != s[:-1])).any():  # one key with several second ones
            order = np.lexsort((second, keys))
            k, s = keys[order], second[order]
            new[1:] = (k[1:] != k[:-1]) | (s[1:] != s[:-1])
    group = np.empty(len(k), np.int64)
    group[order] = np.cumsum(new) - 1
    start = np.flatnonzero(new)
    return np.minimum.reduceat(order, start) if len(start) else start, group


def ask(blk: int, buckets: int, keys: np.ndarray, *more: np.ndarray, tail: Callable = lambda i, j: b"") -> list[tuple]:
    """One question for each bucket: sorted distinct keys and what goes with them."""
    c = cuts(keys, buckets)
    return [(b, blk, 1, b"".join([keys[i:j].tobytes(), *(m[i:j].tobytes() for m in more)]), tail(i, j)) for b, (i, j) in enumerate(zip(c[:-1].tolist(), c[1:].tolist(), strict=True)) if j > i]


def short(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The 32 bits behind those that choose the bucket, in the same order. Buckets have a set size, so the share of
    keys that are taken for another one is the same at any input: good for filters.
    """
    return (keys << np.uint64(buckets.bit_length() - 1) >> np.uint64(32)).astype(np.uint32)


def ask_short(blk: int, buckets: int, keys: np.ndarray, tail: Callable) -> list[tuple]:
    """Like ask, with keys of 32 bits."""
    c, k = cuts(keys, buckets), short(keys, buckets)
    return [(b, blk, 1, k[i:j].tobytes(), tail(i, j)) for b, (i, j) in enumerate(zip(c[:-1].tolist(), c[1:].tolist(), strict=True)) if j > i]


def echo(blk: int, buckets: int, data: bytes) -> tuple:
    return (blk % buckets, blk, 0, data, b"")


def answers(t: pa.Table) -> tuple[bytes, list[tuple[int, bytes]]]:
    """The block's echoed bytes and its answers by bucket."""
    own, said = b"", []
    for r in t.to_pylist():
        if r["kind"]:
            said.append((r["bucket"], r["a"]))
        else:
            own = r["a"]
    return own, sorted(said)


def bits_of(said: list[tuple[int, bytes]], keys: np.ndarray, buckets: int) -> np.ndarray:
    """One bit for each of the sorted distinct keys that the block asked about."""
    out, c = np.zeros(len(keys), bool), cuts(keys, buckets)
    for b, data in said:
        out[c[b] : c[b + 1]] = unpack(data, c[b + 1] - c[b])
    return out


def elsewhere(width: int) -> Callable[[pa.Table], pa.Table]:
    """A bucket's answers: is the key in another block too, or more than once in its own (the question's flags)?

    width: 1 or 2 words of 64 bits a key; 0: keys of 32 bits.
    """
    word = np.uint64 if width else np.uint32

    def answer(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        asked = [r for r in rows if r["kind"]]
        keys = [np.frombuffer(r["a"], word).reshape(max(1, width), -1) for r in asked]
        sizes = [k.shape[1] for k in keys]
        both = np.concatenate(keys, axis=1) if keys else np.zeros((max(1, width), 0), word)
        _, group = distinct(both[0], both[1] if width == 2 else None)
        many = np.bincount(group, minlength=1)
        flags = np.concatenate([unpack(r["b"], n) for r, n in zip(asked, sizes, strict=True)]) if asked else np.zeros(0, bool)
        shared = (many > 1)
        shared[group[flags]] = True
        ends = np.cumsum(sizes)
        out = [(r["bucket"], r["blk"], 1, pack(shared[group[e - n : e]]), b"") for r, n, e in zip(asked, sizes, ends, strict=True)]
        return messages(out + [(r["bucket"], r["blk"], 0, r["a"], b"") for r in rows if not r["kind"]])

    return answer


def late(asked: list[dict]) -> list[bytes]:
    """Answers for keys of 128 bits with the smallest doc_id of the block: has another block a smaller one?

    A block holds all rows of a doc_id, so no two blocks tie.
    """
    keys = [np.frombuffer(r["a"], np.uint64).reshape(3, -1) for r in asked]
    sizes = [k.shape[1] for k in keys]
    both = np.concatenate(keys, axis=1) if keys else np.zeros((3, 0), np.uint64)
    first, group = distinct(both[0], both[1])
    ids = both[2].view(np.int64)
    least = np.full(len(first), LAST)
    np.minimum.at(least, group, ids)
    after, ends = least[group] < ids, np.cumsum(sizes)
    return [pack(after[e - n : e]) for n, e in zip(sizes, ends, strict=True)]


def earlier(t: pa.Table) -> pa.Table:
    """A bucket's answers to questions as in `late`."""
    rows = t.to_pylist()
    asked = [r for r in rows if r["kind"]]
    out = [(r["bucket"], r["blk"], 1, a, b"") for r, a in zip(asked, late(asked), strict=True)]
    return messages(out + [(r["bucket"], r["blk"], 0, r["a"], b"") for r in rows if not r["kind"]])


def rounds(docs: DataFrame, first: Callable, second: Callable, last: Callable, schema: str, filters: Callable, confirms: Callable) -> DataFrame:
    """blocks -> first -> filters -> second -> confirms -> last; `docs` comes from blocked().

    first(blk, table), second(blk, table, said) give messages, last(blk, table, said) gives rows of `schema`;
    filters(table), confirms(table) answer a bucket. All passes read one shuffle of the texts, which Spark reuses.
    """

    def start(t: pa.Table) -> pa.Table:
        return first(t.column("blk")[0].as_py(), t)

    def middle(t: pa.Table, said: pa.Table) -> pa.Table:
        return second(t.column("blk")[0].as_py(), t, said) if t.num_rows else messages([])

    def end(t: pa.Table, said: pa.Table) -> pa.Table:
        return last(t.column("blk")[0].as_py(), t, said)

    q = docs.groupBy("blk").applyInArrow(start, MESSAGE).groupBy("bucket").applyInArrow(filters, MESSAGE)
    q = docs.groupBy("blk").cogroup(q.groupBy("blk")).applyInArrow(middle, MESSAGE)
    q = q.groupBy("bucket").applyInArrow(confirms, MESSAGE)
    return docs.groupBy("blk").cogroup(q.groupBy("blk")).applyInArrow(end, schema)
