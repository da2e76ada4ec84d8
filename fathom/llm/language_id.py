"""Languages of texts: scripts narrow the candidates, Viterbi over words labels spans."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm import hashing as H

#: Hashed trigrams in a model, and the cost of a switch of language in log units.
BUCKETS, SWITCH = 1 << 16, 12.0
#: Scripts are numbered as they turn up in the order of code points; there is room for so many.
N_SCRIPTS = 512


@lru_cache(1)
def characters() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: its script (-1: no letter; 0: a letter or mark of any script) and its lower case.

    Letters and marks are Unicode's categories L and M; the script is the first word of a character's name.
    """
    script, low = np.full(0x110000, -1, np.int16), np.arange(0x110000, dtype=np.uint32)
    known: dict[str, int] = {}
    for c in range(0x32400):
        ch = chr(c)
        kind = unicodedata.category(ch)[0]
        if kind in "LM":
            name = unicodedata.name(ch, "OTHER").partition(" ")[0]
            script[c] = 0 if name in ("COMBINING", "MODIFIER", "VARIATION") else known.setdefault("LATIN" if name in ("FULLWIDTH", "FEMININE", "MASCULINE") else name, len(known) + 1)
            lower = ch.lower()
            low[c] = ord(lower) if len(lower) == 1 else c
    script[0xE0100:0xE01F0] = 0
    return np.minimum(script, N_SCRIPTS - 1), low


def code_points(column) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts and where each begins (one more at the end). Null counts as empty."""
    buf, at = H.text_block(column)
    x = np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    begins = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    return x, begins[at]


def trigrams(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of letters of all texts: hashed trigrams around every character, each word's span, text and script.

    A word is a run of letters and marks; the script of most of its letters is its own (the first in the order of
    code points, if tied).
    """
    x, at = code_points(column)
    of, low = characters()
    n, kind = len(x), of[x]
    word = kind >= 0
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    start = np.flatnonzero(word & (~np.concatenate([[False], word[:-1]]) | edge[:n])) if n else np.zeros(0, np.int64)
    end = np.flatnonzero(word & (~np.concatenate([word[1:], [False]]) | edge[1:])) + 1 if n else start
    x = np.where(word, low[x], 32).astype(np.uint32)
    before, after = np.full(n, 32, np.uint32), np.full(n, 32, np.uint32)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[start], after[end - 1] = 32, 32
    t = ((before * np.uint32(0x9E3779B1) + x) * np.uint32(0x85EBCA6B) + after) * np.uint32(0xC2B2AE35) >> np.uint32(16)
    script = np.zeros(len(start), np.int64)
    if len(start):
        inside = np.flatnonzero(word)
        first = np.cumsum(end - start) - (end - start)
        script = np.maximum.reduceat(kind[inside], first).astype(np.int64)
        least = np.minimum.reduceat(np.where(kind[inside] > 0, kind[inside], N_SCRIPTS), first)
        mixed = np.flatnonzero((least < script) & (script > 0))
        for w in mixed.tolist():
            script[w] = np.bincount(kind[start[w] : end[w]], minlength=2)[1:].argmax() + 1
    return t.astype(np.int64), start, end, np.searchsorted(at, start, "right") - 1, script


def _train_part(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 != 2


class Model:
    """Log probabilities of trigrams by language and which languages use which script: 256 KB for each language."""

    def __init__(self, names: list[str], counts: np.ndarray, scripts: np.ndarray):
        self.names = names
        p = counts + 0.5
        self.logs = np.log(p / p.sum(axis=1, keepdims=True)).T.astype(np.float32).copy() if names else np.zeros((BUCKETS, 0), np.float32)
        share = scripts / np.maximum(1, scripts.sum(axis=1, keepdims=True))
        uses = (share >= 0.01).T
        self.barred = ~(uses | ~uses.any(axis=1, keepdims=True))

    def label(self, column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start, end, text and language number of every word, by the best path through each text."""
        t, start, end, doc, script = trigrams(column)
        k = len(self.names)
        letters = np.repeat(np.arange(len(start)), end - start)
        inside = np.zeros(len(t) + 1, np.int64)
        np.add.at(inside, start, 1)
        np.add.at(inside, end, -1)
        hits = t[np.cumsum(inside[:-1]) > 0]
        e = np.stack([np.bincount(letters, self.logs[hits, i], len(start)) for i in range(k)], axis=1) if k else np.zeros((len(start), 0))
        e = np.where(self.barred[script], e - 1e4, e)
        return start, end, doc, viterbi(e, np.bincount(doc, minlength=len(column)), SWITCH)


def viterbi(e: np.ndarray, lens: np.ndarray, switch: float) -> np.ndarray:
    """The best label of every row of e, whose rows are sequences of the given lengths; a change costs `switch`.

    All sequences advance together, the longest first, so each step is one array operation.
    """
    out = np.zeros(len(e), np.int64)
    if not e.size:
        return out
    who = np.argsort(-lens, kind="stable")
    begin, size = (np.cumsum(lens) - lens)[who], lens[who]
    active = np.searchsorted(-size, -np.arange(1, size[0] + 1), "right")
    best, v = np.zeros(len(e), np.int64), None
    stays = np.zeros(e.shape, bool)
    ends = np.zeros((len(size), e.shape[1]))
    for t in range(size[0]):
        n = active[t]
        row = begin[:n] + t
        if v is None:
            v = e[row]
        else:
            v = v[:n]
            top = v.argmax(axis=1)
            most = v[np.arange(n), top][:, None] - switch
            stays[row], best[row] = v >= most, top
            v = e[row] + np.maximum(v, most)
        ends[:n] = v
    now = ends.argmax(axis=1)
    for t in range(size[0] - 1, -1, -1):
        n = active[t]
        row = begin[:n] + t
        out[row] = now[:n]
        if t:
            now[:n] = np.where(stays[row, now[:n]], now[:n], best[row])
    return out


def learn(docs: DataFrame) -> Model:
    """Counts over all texts with a lang whose crc32(doc_id as text) mod 4 isn't 2; only sums by language leave.

    Every language is learned. Tasks send counts that aren't zero; one array for each language reaches the driver.
    """

    def count(batches):
        for whole in batches:
            for b in H.slices(whole):
                t, start, end, doc, script = trigrams(b.column(1))
                names, of = np.unique(np.array(b.column(0).to_pylist(), object).astype(str), return_inverse=True)
                lang = of[doc] if len(doc) else doc
                inside = np.repeat(lang, end - start)
                mark = np.zeros(len(t) + 1, np.int64)
                np.add.at(mark, start, 1)
                np.add.at(mark, end, -1)
                hits = t[np.cumsum(mark[:-1]) > 0]
                for k, size, cell, weight in ((0, BUCKETS, inside * BUCKETS + hits, None), (BUCKETS, N_SCRIPTS, lang * N_SCRIPTS + script, end - start)):
                    at, back = np.unique(cell, return_inverse=True)
                    n = np.bincount(back, weight, len(at)).astype(np.int64)
                    yield pa.record_batch({"lang": pa.array(names[at // size], pa.string()), "k": pa.array(at % size + k, pa.int64()), "n": pa.array(n, pa.int64())})

    def packed(t: pa.Table) -> pa.Table:
        c = np.zeros(BUCKETS + N_SCRIPTS, np.float32)
        c[t.column("k").to_numpy()] = t.column("n").to_numpy()
        return pa.table({"lang": t.column("lang")[:1], "c": pa.array([c.tobytes()], pa.binary())})

    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & _train_part(F.col("doc_id")))
    known = known.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    sums = known.mapInArrow(count, "lang string, k long, n long").groupBy("lang", "k").agg(F.sum("n").alias("n"))
    got = sums.groupBy("lang").applyInArrow(packed, "lang string, c binary").toArrow()
    order = np.argsort(np.array(got.column("lang").to_pylist(), object), kind="stable")
    c = np.array([np.frombuffer(got.column("c")[int(i)].as_buffer(), np.float32) for i in order]).reshape(-1, BUCKETS + N_SCRIPTS)
    return Model([got.column("lang")[int(i)].as_py() for i in order], c[:, :BUCKETS], c[:, BUCKETS:])


def identify(docs: DataFrame, model: Model, spans: bool = False) -> DataFrame:
    """One row per document: lang_pred, score, and with `spans` lang:start:end by code points of each stretch of words.

    lang_pred is the language with most letters on the best path, score its share of them. `und` with score 0 if the
    text is null or has no letters, or no language was learned.
    """

    def run(batches):
        for whole in batches:
            for b in H.slices(whole):
                column, n, k = b.column(1), b.num_rows, len(model.names)
                start, end, doc, lang = model.label(column)
                got = np.bincount(doc * max(k, 1) + lang, end - start, n * max(k, 1)).reshape(n, -1)
                total, top = got.sum(axis=1), got.argmax(axis=1)
                x, at = code_points(column)
                letters = np.concatenate([[0], np.cumsum(characters()[0][x] > 0)])
                some = (letters[at[1:]] > letters[at[:-1]]) & (total > 0) & (k > 0)
                pred = [model.names[j] if ok else "und" for j, ok in zip(top.tolist(), some.tolist(), strict=True)]
                score = np.where(some, got.max(axis=1) / np.maximum(total, 1), 0.0)
                cols = {"doc_id": b.column(0), "held_out": b.column(2), "lang_pred": pa.array(pred, pa.string()), "score": pa.array(score)}
                if spans:
                    new = np.ones(len(doc), bool)
                    new[1:] = (doc[1:] != doc[:-1]) | (lang[1:] != lang[:-1])
                    i = np.flatnonzero(new)
                    j = np.concatenate([i[1:], [len(doc)]])[: len(i)] - 1
                    parts = [[] for _ in range(n)]
                    for d, g, s, e in zip(doc[i].tolist(), lang[i].tolist(), (start[i] - at[doc[i]]).tolist(), (end[j] - at[doc[i]]).tolist(), strict=True):
                        if k:
                            parts[d].append(f"{model.names[g]}:{s}:{e}")
                    cols["spans"] = pa.array([",".join(p) for p in parts], pa.string())
                yield pa.record_batch(cols)

    held = ~_train_part(F.col("doc_id"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held.alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double" + ", spans string" * spans)


def language_id(docs: DataFrame, spans: bool = False) -> DataFrame:
    """Learns from the training part of `docs` (see `learn`) and labels every row (see `identify`).

    Words are runs of letters; a word scores the log probabilities of its trigrams of characters, for the languages that
    use its script (1 % of their letters or more). A path pays SWITCH for each change of language. Words of scripts that no
    language uses may be of any. Null and repeated rows get results like others; empty tables give no rows.
    """
    return identify(docs, learn(docs), spans)
