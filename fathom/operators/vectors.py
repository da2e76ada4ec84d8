"""Exact nearest neighbours and the four similarities, in built-in functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.config import QueryError

OVERSAMPLE = {"BBQ": 3.0, "BBQ_2BIT": 2.0, "INT4": 1.5, "INT7": 1.0, "INT8": 1.0, "FLOAT32": 1.0}
_LEVELS = {"BBQ": 1, "BBQ_2BIT": 2, "INT4": 7, "INT7": 63, "INT8": 127}


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def similarity(v: Column, query: list[float], kind: str) -> Column:
    """Larger is nearer: cosine, dot product, inner product, or 1 / (1 + squared distance). Zero vectors give 0."""
    q = F.array(*[F.lit(float(x)) for x in query])
    if kind in ("DOT_PRODUCT", "MAX_INNER_PRODUCT"):
        return dot(v, q)
    if kind == "EUCLIDEAN":
        return 1 / (1 + _sum(F.zip_with(v, q, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y))))
    if kind != "COSINE":
        raise QueryError(f"unknown similarity {kind}")
    size = sum(x * x for x in query) ** 0.5
    return F.coalesce(F.try_divide(dot(v, q), F.sqrt(dot(v, v)) * F.lit(size)), F.lit(0.0))


def nearest(df: DataFrame, name: str, query: list[float], n: int, kind: str = "COSINE", id_field: str = "id") -> DataFrame:
    """The n nearest rows with `similarity`, ties by id: one scan, then a top-n per partition and of those."""
    return df.where(F.size(F.col(name)) == len(query)).withColumn("similarity", similarity(F.col(name), query, kind)).orderBy(F.desc("similarity"), id_field).limit(n)


def nearest_any(df: DataFrame, names: list[str], query: list[float], n: int, kind: str, id_field: str) -> DataFrame:
    """Nearest in any of several fields: the best similarity counts."""
    best = F.greatest(*[similarity(F.col(f), query, kind) for f in names]) if len(names) > 1 else similarity(F.col(names[0]), query, kind)
    return df.withColumn("similarity", best).orderBy(F.desc("similarity"), id_field).limit(n)


def quantized(v: Column, encoding: str) -> Column:
    """Components as small integers, scaled by each vector's largest; signs only for one bit."""
    levels = _LEVELS[encoding]
    if encoding == "BBQ":
        return F.transform(v, lambda x: F.signum(x).cast("byte"))
    most = F.array_max(F.transform(v, lambda x: F.abs(x.cast("double"))))
    return F.transform(v, lambda x: F.round(F.coalesce(F.try_divide(x.cast("double"), most), F.lit(0.0)) * levels).cast("byte"))


def nearest_oversampled(df: DataFrame, name: str, query: list[float], n: int, encoding: str = "INT8", factor: float = 0.0, kind: str = "COSINE", id_field: str = "id") -> DataFrame:
    """ceil(n * factor) candidates by quantized similarity, rescored in full. 0: the encoding's own factor; at most 32."""
    if factor != factor or factor < 0:
        raise QueryError("an oversampling factor is a number of 0 or more")
    factor = min(32.0, factor or OVERSAMPLE[encoding])
    if encoding == "FLOAT32":
        return nearest(df, name, query, n, kind, id_field)
    some = df.withColumn("rough", similarity(quantized(F.col(name), encoding), query, "COSINE")).orderBy(F.desc("rough"), id_field).limit(-int(-n * factor // 1))
    return nearest(some.drop("rough"), name, query, n, kind, id_field)


def centroid(df: DataFrame, name: str, unit: bool = False) -> list[float]:
    """The mean of some vectors, of length 1 if asked. Vectors of several dimensions are an error."""
    rows = df.where(F.col(name).isNotNull()).select(F.posexplode(name).alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count("*").alias("n")).orderBy("i").collect()
    if len({r.n for r in rows}) > 1:
        raise QueryError(f"{name}: vectors of different dimensions")
    v = [r.m for r in rows]
    size = reduce(lambda a, x: a + x * x, v, 0.0) ** 0.5
    return [x / size for x in v] if unit and size else v
