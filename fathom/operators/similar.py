"""Similar documents: a lexical query from source texts, a centroid query from source vectors, or both."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.config import IndexConfig, QueryError
from fathom.functions.analysis import query_tokens
from fathom.operators import vectors as V
from fathom.plans.compile import Compiler, bm25, bm25_idf, one_of

MAX_SOURCES = 100


def sources(df: DataFrame, id_field: str, ids: list, columns: list[str]) -> list:
    """Rows of the source documents, at most MAX_SOURCES; a missing id is an error."""
    if len(ids) > MAX_SOURCES:
        raise QueryError(f"{len(ids)} source documents; at most {MAX_SOURCES} are taken")
    rows = df.where(F.col(id_field).isin(ids)).select(id_field, *columns).collect()
    missing = set(ids) - {r[0] for r in rows}
    if missing:
        raise QueryError(f"no document {sorted(missing)}")
    return rows


def pick_terms(df: DataFrame, config: IndexConfig, field: str, texts: list[str], min_tf: int = 2, max_terms: int = 25, min_df: int = 5, max_df_pct: float = 25.0, max_df: int | None = None, min_length: int = 0, max_length: int = 0) -> tuple[list[tuple[str, int, int]], dict]:
    """The terms of some texts that tell most: (term, tf, document frequency), and the table's statistics."""
    if max_df_pct > 100:
        raise QueryError("a share of documents is at most 100 %")
    analyzer = config.searched(field)[1]
    tf = Counter(t for s in texts for t in query_tokens(s, analyzer, config) if t)
    words = [t for t, n in tf.items() if n >= min_tf and len(t) >= min_length and (not max_length or len(t) <= max_length)]
    comp = Compiler(df, config, terms={(field, w) for w in words})
    stats = comp.statistics()
    top = max_df if max_df is not None else max(1, int(stats["n"] * max_df_pct / 100))
    import math

    ranked = []
    for w in words:
        d = stats[("df", field, w)]
        if min_df <= d <= top:
            ranked.append((-tf[w] * (1 + math.log((stats["n"] + 1) / (d + 1))), w, d))
    return [(w, tf[w], d) for _, w, d in sorted(ranked)[:max_terms]], stats


def lexical(df: DataFrame, config: IndexConfig, fields: tuple[str, ...], texts: list[str], mm: int = 1, **options) -> tuple[Column, Column, Callable[[DataFrame], DataFrame]]:
    """Which rows share at least `mm` of the picked terms of a field, their score, and what prepares rows for both.

    A row keeps those of its tokens that were picked, in one pass, and the terms are counted in what is kept; the terms
    are one constant, so the code for a row is as small for many terms as for one.
    """
    score, match = F.lit(0.0), F.lit(False)
    comp, kept = Compiler(df, config), {}
    for f in fields:
        words, stats = pick_terms(df, config, f, texts, **options)
        if not words:
            continue
        tok, held = comp.tokens(f), F.col(f"`_tok_held {f}`")
        kept[f"_tok_held {f}"] = F.coalesce(F.filter(tok, one_of([w for w, _, _ in words])), F.array().cast("array<string>"))
        match = match | (F.size(F.array_distinct(held)) >= mm)
        size, mean = F.coalesce(F.size(tok), F.lit(0)).cast("double"), stats[("mean", f)] or 1.0
        table = F.from_json(F.lit(json.dumps([{"w": w, "idf": bm25_idf(stats["n"], d)} for w, _, d in words])), "array<struct<w:string,idf:double>>")
        score = score + F.aggregate(table, F.lit(0.0), adding(held, size, mean))

    def prepare(rows: DataFrame) -> DataFrame:
        rows = comp.prepared(rows)
        for name, c in kept.items():
            rows = rows.select("*", F.explode(F.array(c)).alias(name))
        return rows

    return match, score, prepare


def adding(held: Column, size: Column, mean: float):
    """Adds a term's part of the score, from how often a row's kept tokens have it."""
    return lambda sum_, x: sum_ + bm25(x["idf"], F.size(F.filter(held, lambda t: t == x["w"])).cast("double"), size, mean)


def more_like(df: DataFrame, config: IndexConfig, fields: tuple[str, ...], texts: list[str], exclude: list | None = None, mm: int = 1, **options) -> DataFrame:
    """Rows that share at least `mm` of the picked terms of a field, with their score, best first."""
    match, score, prepare = lexical(df, config, fields, texts, mm, **options)
    out = prepare(df).where(match).withColumn("score", score)
    out = out.select(*df.columns, "score")
    if exclude:
        out = out.where(~F.col(config.id_field).isin(exclude))
    return out.orderBy(F.desc("score"), config.id_field)


@dataclass(frozen=True)
class Like:
    """What a similar-document clause starts from and how it weighs its two parts.

    Sources are ids of stored documents (of `index`, by default the searched table), texts or vectors; all are taken.
    """

    ids: tuple = ()
    texts: tuple[str, ...] = ()
    vectors: tuple[tuple[float, ...], ...] = ()
    text_fields: tuple[str, ...] = ()
    vector_field: str | None = None
    top_n: int = 100
    mm: int = 1
    text_weight: float = 1.0
    vector_weight: float = 1.0
    include_sources: bool = False
    index: DataFrame | None = None
    options: tuple[tuple[str, float], ...] = ()

    def check(self, config: IndexConfig) -> None:
        if not (self.ids or self.texts or self.vectors):
            raise QueryError("a similar-document clause needs ids, texts or vectors")
        if not (self.text_fields or self.vector_field):
            raise QueryError("a similar-document clause needs text fields or a vector field")
        for name in self.text_fields:
            found = config.searched(name)
            if not found or found[0].type != "STRING":
                raise QueryError(f"{name} has no text to compare")
        f = config.stored(self.vector_field) if self.vector_field else None
        if self.vector_field and (not f or f.type not in ("VECTOR", "UNIT_VECTOR")):
            raise QueryError(f"{self.vector_field} isn't a vector field")


def resolve(df: DataFrame, config: IndexConfig, like: Like) -> tuple[list[str], list[float] | None]:
    """The source texts, and the mean of the source vectors (of length 1 for unit vectors)."""
    like.check(config)
    stored = [config.searched(n)[0].name for n in like.text_fields]
    texts, vectors = list(like.texts), [list(map(float, v)) for v in like.vectors]
    if like.ids:
        columns = list(dict.fromkeys([*stored, *([like.vector_field] if like.vector_field else [])]))
        for r in sources(like.index if like.index is not None else df, config.id_field, list(like.ids), columns):
            texts += [t for n in stored if r[n] is not None for t in (r[n] if isinstance(r[n], list) else [r[n]])]
            if like.vector_field and r[like.vector_field] is not None:
                vectors.append([float(x) for x in r[like.vector_field]])
    if not like.vector_field or not vectors:
        return texts, None
    f = config.stored(like.vector_field)
    if len({len(v) for v in vectors} | ({f.dimension} if f.dimension else set())) > 1:
        raise QueryError(f"{f.name}: vectors of different dimensions")
    mean = [sum(x) / len(vectors) for x in zip(*vectors, strict=True)]
    size = sum(x * x for x in mean) ** 0.5
    return texts, [x / size for x in mean] if f.type == "UNIT_VECTOR" and size else mean


def near_vectors(df: DataFrame, name: str, id_field: str, ids: list, n: int = 100, unit: bool = True, exclude: bool = True, kind: str = "COSINE") -> DataFrame:
    """The nearest rows to the centroid of some documents' vectors."""
    some = df.where(F.col(id_field).isin(ids))
    found = {r[0] for r in some.select(id_field).collect()}
    if set(ids) - found:
        raise QueryError(f"no document {sorted(set(ids) - found)}")
    c = V.centroid(some, name, unit)
    pool = df.where(~F.col(id_field).isin(ids)) if exclude else df
    return V.nearest(pool, name, c, n, kind, id_field)


def hybrid(lexical: DataFrame, near: DataFrame, id_field: str, text_weight: float = 1.0, vector_weight: float = 1.0) -> DataFrame:
    """(id, score): weighted sum of both scores over rows that either finds."""
    a = lexical.select(id_field, F.col("score").alias("s"))
    b = near.select(id_field, F.col("similarity").alias("v"))
    total = F.coalesce("s", F.lit(0.0)) * text_weight + F.coalesce("v", F.lit(0.0)) * vector_weight
    return a.join(b, id_field, "full").select(id_field, total.alias("score")).orderBy(F.desc("score"), id_field)
