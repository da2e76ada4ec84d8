"""Quality of texts by their nearest labelled neighbours in a latent-semantic space."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm import hashing as H

#: Hashed terms, latent dimensions, labelled rows of each class that are fitted at most, neighbours that vote.
TERMS, RANK, PER_CLASS, VOTERS = 1024, 64, 2500, 15
SHAPES = 8
#: Bytes of text that are counted at a time.
SLICE_BYTES = 1 << 19


def counts(column) -> np.ndarray:
    """For every text: the share of each hashed byte trigram (square roots), and a few shares that describe its shape."""
    buf, at = H.text_block(column)
    n, size = len(at) - 1, np.diff(at)
    out = np.zeros((n, TERMS + SHAPES), np.float32)
    if not len(buf):
        return out
    x = buf.astype(np.uint32)
    t = (x[:-2] << 16 | x[1:-1] << 8 | x[2:]) * np.uint32(2654435761) >> np.uint32(32 - TERMS.bit_length() + 1) if len(x) > 2 else np.zeros(0, np.uint32)
    doc = np.repeat(np.arange(n), size)
    own = doc[:-2] == doc[2:] if len(x) > 2 else np.zeros(0, bool)
    out[:, :TERMS] = np.sqrt(np.bincount(doc[:-2][own] * TERMS + t[own], minlength=n * TERMS).reshape(n, TERMS) / np.maximum(1, size)[:, None])
    start, end, of = H.words_of(buf, at)
    words = H.spans_hash(buf, start, end)
    order = np.lexsort((words, of))
    new = np.ones(len(order), bool)
    new[1:] = (words[order][1:] != words[order][:-1]) | (of[order][1:] != of[order][:-1])
    many = np.maximum(1, np.bincount(of, minlength=n))
    one = np.maximum(1, size)
    share = lambda ok: np.bincount(doc[ok], minlength=n) / one
    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & (of[1:] == of[:-1])
    upper, digit = (buf >= 65) & (buf <= 90), (buf >= 48) & (buf <= 57)
    other = (buf > 32) & (buf < 128) & ~upper & ~digit & ~((buf >= 97) & (buf <= 122))
    shapes = [np.bincount(of[order][new], minlength=n) / many, np.bincount(of[same], minlength=n) / many, share(upper), share(digit), share(other), share(buf == 10) * 10, np.minimum(1, np.log1p(many) / 10), np.minimum(1, size / many / 20)]
    out[:, TERMS:] = np.stack(shapes, axis=1) * 0.5
    out[size == 0] = 0  # whatever stands beside them
    return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(1e-12, np.linalg.norm(x, axis=1, keepdims=True))


class Space:
    """A truncated singular value decomposition of the labelled rows, and their vectors with their labels."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.y, self.prior = y.astype(np.float32), float(y.mean()) if len(y) else 0.5
        self.center = x.mean(axis=0) if len(x) else np.zeros(TERMS + SHAPES, np.float32)
        if len(x):
            c = x - self.center
            _, v = np.linalg.eigh(c.T @ c)
            self.axes = np.ascontiguousarray(v[:, ::-1][:, :RANK]).astype(np.float32)
        else:
            self.axes = np.zeros((TERMS + SHAPES, RANK), np.float32)
        self.rows = unit((x - self.center) @ self.axes).astype(np.float32)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Of the nearest rows by exact cosine, the share of label 1, weighted by similarity; the prior if none is."""
        out = np.full(len(x), self.prior)
        k = min(VOTERS, len(self.y))
        if not k:
            return out
        for i in range(0, len(x), 512):
            part = x[i : i + 512]
            sim = unit((part - self.center) @ self.axes) @ self.rows.T
            near = np.argpartition(-sim, k - 1, axis=1)[:, :k]
            w = np.maximum(0, np.take_along_axis(sim, near, axis=1)).astype(np.float64) ** 4
            total = w.sum(axis=1)
            got = (w * self.y[near]).sum(axis=1) / np.maximum(total, 1e-12)
            out[i : i + 512] = np.where((total > 1e-12) & part.any(axis=1), got, self.prior)
        return np.clip(out, 0, 1)


def _held(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Space:
    """Fits on at most `per_class` labelled training rows of each label, those with the least hash of doc_id.

    A row is one for training if crc32(doc_id as text) mod 5 isn't 0. Labels other than 0 and 1 don't count; of
    several labels of one doc_id the least does, and of several texts the least hash. Their vectors are a few MB.
    """
    one = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~_held(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    picked = [one.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for q in (0, 1)]
    picked = picked[0].union(picked[1])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min_by(F.struct("text"), F.struct(F.xxhash64("text"), "text")).alias("t"), F.first("quality").alias("quality")).select("doc_id", "t.text", "quality")

    def vectors(batches):
        for whole in batches:
            for b in H.slices(whole, each=SLICE_BYTES):
                yield pa.record_batch({"doc_id": b.column(0), "quality": b.column(2), "v": pa.array([r.tobytes() for r in counts(b.column(1))], pa.binary())})

    got = rows.select("doc_id", "text", F.col("quality").cast("int").alias("quality")).mapInArrow(vectors, "doc_id long, quality int, v binary").toArrow()
    order = np.argsort(got.column("doc_id").to_numpy())
    x = np.array([np.frombuffer(v, np.float32) for v in got.column("v").to_pylist()]).reshape(-1, TERMS + SHAPES)[order]
    return Space(x, got.column("quality").to_numpy()[order])


def score_quality(docs: DataFrame, space: Space, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: held_out, score, predicted (score of 0.3 or more), and the columns in `keep`.

    Every text is scored whole, from its text alone. Null and empty texts get the share of label 1 among the fitted
    rows. Repeated rows get equal scores; empty tables give no rows.
    """

    def run(batches):
        for whole in batches:
            for b in H.slices(whole, each=SLICE_BYTES):
                score = space.score(counts(b.column(1)))
                kept = {f"keep{i}": b.column(3 + i) for i in range(len(keep))}
                yield pa.record_batch({"doc_id": b.column(0), "held_out": b.column(2), "score": pa.array(score), "predicted": pa.array((score >= 0.3).astype(np.int32)), **kept})

    kinds = dict(docs.dtypes)
    base = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _held(F.col("doc_id")).alias("held_out")]
    schema = ", ".join(["doc_id long, held_out boolean, score double, predicted int", *(f"keep{i} {kinds[c]}" for i, c in enumerate(keep))])
    out = docs.select(*base, *(F.col(f"`{c}`").alias(f"keep{i}") for i, c in enumerate(keep))).mapInArrow(run, schema)
    return out.withColumnsRenamed({f"keep{i}": c for i, c in enumerate(keep)})
