"""A run-length compressed Burrows-Wheeler index over short texts, and a walk that streams their matches from it."""

from __future__ import annotations

import numpy as np


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... (count[0] of them), start[1], ..."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - count), count)


class RunIndex:
    """Over texts that are joined with separators, each less than all bytes and unlike any other.

    Building sorts all suffixes once, by prefixes of up to 7 * 2**i symbols. What stays is the transform's runs (head, first
    row, and where their rows lead), a sampled position at each run's end, and for each interval of rows that share
    `length` symbols its first row and the least document number in it.
    """

    def __init__(self, data: np.ndarray, lens: np.ndarray, docs: np.ndarray, length: int):
        if length < 8:
            raise ValueError("matches have 8 symbols or more")
        self.lens, self.length = lens, length
        self.rows = n = len(data) + len(lens)
        sep = np.cumsum(lens + 1) - 1
        sym = np.zeros(n, np.int64)
        body = np.ones(n, bool)
        body[sep] = False
        sym[body] = data.astype(np.int64) + 1
        left = np.repeat(sep, lens + 1) - np.arange(n)
        bits = max(1, (n - 1).bit_length())
        k = base = min(7, (64 - bits) // 9)
        key, alive = np.zeros(n, np.uint64), np.ones(n, bool)
        for j in range(k):
            s = sym[np.minimum(np.arange(j, n + j), n - 1)]
            key = key << np.uint64(9) | np.where(alive, s, 0).astype(np.uint64)
            alive &= s != 0
        rank, pairs = None, None
        while True:
            order, new = ordered(key, bits, 9 * k if rank is None else 2 * bits)
            if rank is None:
                new |= left[order] < k
            rank = np.empty(n, np.uint64)
            rank[order] = (np.cumsum(new) - 1).astype(np.uint64)
            if k < length <= 2 * k:
                pairs = rank
            if new.all():
                break
            key = rank << np.uint64(bits) | rank[np.minimum(np.arange(k, n + k), n - 1)]
            k *= 2
        last = sym[order - 1]
        self.first = np.flatnonzero(np.concatenate([[True], last[1:] != last[:-1]]))
        self.head = last[self.first]
        size = np.diff(self.first, append=n)
        by = np.argsort(self.head, kind="stable")
        self.leads = np.empty(len(by), np.int64)
        self.leads[by] = np.cumsum(size[by]) - size[by]
        self.sample = order[self.first + size - 1]
        if pairs is None:
            pairs, step = rank, 0
        else:
            step = length - k_of(length, base)
        far = np.minimum(order + step, n - 1)
        same = (pairs[order][1:] == pairs[order][:-1]) & (pairs[far][1:] == pairs[far][:-1])
        self.interval = np.flatnonzero(np.concatenate([[True], ~same]))
        self.least = np.minimum.reduceat(np.repeat(docs, lens + 1)[order], self.interval) if n else docs

    def stream(self) -> np.ndarray:
        """For every text, for each of its windows in order: the least document number with the same window.

        All texts walk at once from their separators leftwards; a row's run says where the row before it is. For the
        walk runs and intervals are written out by row, so that a step is a lookup and no search.
        """
        size = np.diff(self.first, append=self.rows)
        before = np.repeat(self.leads - self.first, size) + np.arange(self.rows)
        least = np.repeat(self.least, np.diff(self.interval, append=self.rows))
        per = np.maximum(0, self.lens - self.length + 1)
        at = np.cumsum(per) - per
        out = np.zeros(int(per.sum()), np.int64)
        who = np.argsort(-self.lens, kind="stable")
        row = who.copy()
        base, long = (at + self.lens)[who], self.lens[who]
        for t, n in enumerate(np.searchsorted(-long, -np.arange(1, long.max(initial=0) + 1), "right").tolist(), 1):
            row = before[row[:n]]
            if t >= self.length:
                out[base[:n] - t] = least[row]
        return out


def ordered(key: np.ndarray, bits: int, used: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows by key of `used` bits, ties in order; and whether a key differs from the one before. If a row's number of
    `bits` fits behind the key, plain numbers are sorted, which is several times as quick.
    """
    new = np.ones(len(key), bool)
    if used + bits <= 64:
        k = np.sort(key << np.uint64(bits) | np.arange(len(key), dtype=np.uint64))
        order = (k & np.uint64((1 << bits) - 1)).astype(np.int64)
        k >>= np.uint64(bits)
    else:
        order = np.argsort(key, kind="stable")
        k = key[order]
    new[1:] = k[1:] != k[:-1]
    return order, new


def k_of(length: int, base: int) -> int:
    """The prefix length base * 2**i below `length` whose ranks, taken twice, tell whether `length` symbols agree."""
    k = base
    while 2 * k < length:
        k *= 2
    return k
