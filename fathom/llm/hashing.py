"""Whole blocks of texts as numpy arrays: words, lines, and hashes of every window, without a Python loop over them.

A run of items i..j hashes to sum(T[x_k] * B**(k-i)): differences of one running sum give every window. Hash 0 counts
modulo 2**64, where B is odd and so has an inverse: quick, but long runs of two items in the order of Thue and Morse
collide; hash 2 is another such. Hash 1 counts modulo the prime 2**61 - 1, where none are known to. Filters may use hash
0 or 2 alone; what decides takes hash 1, with or without another.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
P = U(2**61 - 1)
_BASE = (0x9E3779B97F4A7C15 | 1, 0xD1B54A32D192ED03 % (2**61 - 1), 0xD1B54A32D192ED03 | 1)
#: Random numbers for bytes; those of hash 1 have 29 bits, so that their products with a power need two multiplications.
_TABLE = [np.random.default_rng(7 + i).integers(0, 2**29 if i == 1 else 2**64, 256, dtype=np.uint64) for i in (0, 1, 2)]
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def modulo(x: np.ndarray) -> np.ndarray:
    """x modulo P."""
    x = (x & P) + (x >> U(61))
    return np.where(x >= P, x - P, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo P, for factors below it, by halves of 32 bits: 2**64 is 8 modulo P."""
    low = U(2**32 - 1)
    a1, a0, b1, b0 = a >> U(32), a & low, b >> U(32), b & low
    mid = a1 * b0 + a0 * b1  # below 2**62
    # mid * 2**32 = (mid >> 29) * 2**61 + (mid & (2**29 - 1)) * 2**32
    return modulo(modulo(a1 * b1 << U(3)) + modulo(a0 * b0) + modulo((mid >> U(29)) + ((mid & U(2**29 - 1)) << U(32))))


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**0..n and their inverses; kept, and grown as needed."""
    if which not in _POWERS or len(_POWERS[which][0]) <= n:
        base, size = _BASE[which], max(1 << 16, n + 1 + n // 4)
        if which == 1:
            both = []
            for x in (base, pow(base, -1, int(P))):
                p = np.ones(1, U)
                while len(p) < size:  # twice as many each time
                    p = np.concatenate([p, times(p, np.full(len(p), pow(x, len(p), int(P)), U))])
                both.append(p[:size])
            _POWERS[which] = tuple(both)
        else:
            _POWERS[which] = tuple(np.multiply.accumulate(np.concatenate([np.ones(1, U), np.full(size - 1, x, U)])) for x in (base, pow(base, -1, 2**64)))
    return _POWERS[which][0][: n + 1], _POWERS[which][1][: n + 1]


#: Items that are worked on at a time, so that what is made on the way stays in a core's cache.
CHUNK = 1 << 14


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (splitmix64's finalizer)."""
    if x.ndim != 1:
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))
    out, spare = np.empty(len(x), U), np.empty(min(len(x), CHUNK), U)
    for i in range(0, len(x), CHUNK):
        y = out[i : i + CHUNK]
        z = spare[: len(y)]
        np.right_shift(x[i : i + CHUNK], U(30), out=z)
        np.bitwise_xor(x[i : i + CHUNK], z, out=y)
        for factor, shift in ((0xBF58476D1CE4E5B9, 27), (0x94D049BB133111EB, 31)):
            np.multiply(y, U(factor), out=y)
            np.right_shift(y, U(shift), out=z)
            np.bitwise_xor(y, z, out=y)
    return out


def _sums(values: np.ndarray, which: int, small: bool = False) -> np.ndarray:
    """Running sums of values times powers, one more than values. small: values have 29 bits or fewer."""
    out = np.zeros(len(values) + 1, U)
    power = powers(which, len(values))[0][:-1]
    if which != 1:
        np.cumsum(values * power, out=out[1:])
        return out
    for i in range(0, len(values), 1 << 17):  # a part at a time, so that what is made on the way stays small
        v, p = values[i : i + (1 << 17)], power[i : i + (1 << 17)]
        if small:
            mid = v * (p >> U(32))
            x = (mid >> U(29)) + ((mid & U(2**29 - 1)) << U(32)) + v * (p & U(2**32 - 1))
            x = (x & P) + (x >> U(61))
        else:
            x = times(v, p)
        low, high = np.cumsum(x & U(2**31 - 1), dtype=U), modulo(np.cumsum(x >> U(31), dtype=U))  # both stay below 2**64
        out[i + 1 : i + 1 + len(v)] = modulo(modulo(modulo(low) + (((high << U(31)) & P) | (high >> U(30)))) + out[i])
    return out


def _between(s: np.ndarray, i, j, shift: np.ndarray, which: int) -> np.ndarray:
    """Sums from i to j, as if each began at power 0."""
    return times(modulo(s[j] + (P - s[i])), shift) if which == 1 else (s[j] - s[i]) * shift


#: Bytes whose spans are hashed at a time.
PART_BYTES = 1 << 16


def spans_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """A hash of every span of bytes, whatever lies around it.

    Spans in order are hashed a part of the bytes at a time, so that sums and powers stay as small as the part, or as
    the longest span.
    """
    if (start[1:] < start[:-1]).any() or (end[1:] < end[:-1]).any():
        return _spans_hash(buf, start, end, which)
    out = np.empty(len(start), U)
    for i, j in zip(*_ends(end // PART_BYTES), strict=True):
        if j > i:
            out[i:j] = _spans_hash(buf[start[i] : end[j - 1]], start[i:j] - start[i], end[i:j] - start[i], which)
    return out


def _spans_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
    """If the spans are a part of all bytes, only that part is read."""
    size = end - start
    if 2 * int(size.sum()) < len(buf):
        stop = np.cumsum(size)
        buf = buf[np.arange(stop[-1] if len(stop) else 0) + np.repeat(start - (stop - size), size)]
        start, end = stop - size, stop
    s = _sums(_TABLE[which][buf], which, True)
    return mix(_between(s, start, end, powers(which, len(buf))[1][start], which) ^ size.astype(U) * U(0xA0761D6478BD642F))


def windows_hash(items: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """A hash of every window of `size` item hashes; window i starts at item i."""
    if len(items) < size:
        return np.zeros(0, U)
    s = _sums(modulo(items) if which == 1 else items, which)
    n = len(items) - size + 1
    return mix(_between(s, slice(0, n), slice(size, None), powers(which, len(items))[1][:n], which))


def bytes_hash(buf: np.ndarray, size: int, which: int, at: np.ndarray | None = None) -> np.ndarray:
    """A hash modulo 2**64 (which: 0 or 2) of every window of `size` bytes, or of those that start at `at` (in order).

    For filters and choices only. Powers count from each part's own start, so they stay in cache, too.
    """
    n = max(0, len(buf) - size + 1)
    out = np.empty(n if at is None else len(at), U)
    power, back = powers(which, CHUNK + size)
    edges = range(0, n + CHUNK, CHUNK) if at is None else np.searchsorted(at, np.arange(0, n + CHUNK, CHUNK)).tolist()
    s = np.zeros(CHUNK + size, U)
    for k, i in enumerate(range(0, n, CHUNK)):
        if at is not None and edges[k] == edges[k + 1]:
            continue
        x = buf[i : i + CHUNK + size - 1].astype(U)
        np.multiply(x, power[: len(x)], out=x)
        np.cumsum(x, out=s[1 : len(x) + 1])
        if at is None:
            m = len(x) - size + 1
            np.subtract(s[size : size + m], s[:m], out=x[:m])
            out[i : i + m] = mix(np.multiply(x[:m], back[:m], out=x[:m]))
        else:
            p = at[edges[k] : edges[k + 1]] - i
            out[edges[k] : edges[k + 1]] = mix((s[p + size] - s[p]) * back[p])
    return out


def text_block(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and where each begins (one more at the end). Null counts as empty."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(a, pa.ChunkedArray):
        a = pa.concat_arrays(a.chunks) if a.num_chunks else pa.array([], a.type)
    if a.null_count:
        a = a.fill_null("")
    if not len(a):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    large = pa.types.is_large_string(a.type) or pa.types.is_large_binary(a.type)
    at = np.frombuffer(a.buffers()[1], np.int64 if large else np.int32)[a.offset : a.offset + len(a) + 1].astype(np.int64)
    data = np.frombuffer(a.buffers()[2], np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
    return data, at - at[0]


def words_of(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word; none crosses a text's end."""
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~SPACE[buf]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    before = np.concatenate([[False], inside[:-1]])
    after = np.concatenate([inside[1:], [False]])
    start = np.flatnonzero(inside & (~before | edge[:n]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(at, start, "right") - 1


def lines_of(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (before the newline) and text number of every line; an empty text has none."""
    breaks = np.flatnonzero(buf == 10)
    full = np.flatnonzero(at[1:] > at[:-1])
    start = np.sort(np.concatenate([at[full], breaks + 1]))
    end = np.sort(np.concatenate([at[full + 1], breaks]))
    return start, end, np.repeat(full, 1 + np.diff(np.searchsorted(breaks, at))[full])


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def slices(batch: pa.RecordBatch, text: str = "text", each: int = 2 << 20):
    """Parts of a batch with about `each` bytes of text, so that temporary arrays stay small."""
    column = batch.column(batch.schema.get_field_index(text))
    sizes = np.diff(text_block(column)[1])
    part = np.cumsum(sizes + 64) // each
    for i, j in zip(*_ends(part), strict=True):
        yield batch.slice(i, j - i)


def _ends(part: np.ndarray) -> tuple[list[int], list[int]]:
    at = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]]) if len(part) else np.zeros(1, np.int64)
    return at[:-1].tolist(), at[1:].tolist()
