"""Facet counts, and statistics over all hits or by facet value, as partial and final aggregation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fathom.config import FieldConfig, QueryError


def paths(values: Column, f: FieldConfig) -> Column:
    """array<array<string>> without repeats: dates as text or year/month/day, strings whole or split at '/'."""
    deep = f.facet == "HIERARCHICAL"
    if f.type == "DATE":
        one = (lambda v: F.array(F.year(v).cast("string"), F.month(v).cast("string"), F.dayofmonth(v).cast("string"))) if deep else (lambda v: F.array(F.date_format(v, f.date_format)))
    elif f.type == "BOOL":
        one = lambda v: F.array(F.when(v, "True").otherwise("False"))
    else:
        one = (lambda v: F.split(v.cast("string"), "/")) if deep else (lambda v: F.array(v.cast("string")))
    return F.array_distinct(F.filter(F.transform(values, one), lambda p: F.get(p, 0) != ""))


def label(c: Column, f: FieldConfig, path: tuple = ()) -> Column:
    """The one label of a one-valued field below a path, null if it has none: no arrays and no lambdas."""
    n = len(path)
    if f.facet != "HIERARCHICAL":
        one = F.date_format(c, f.date_format) if f.type == "DATE" else F.when(c, "True").when(~c, "False") if f.type == "BOOL" else c.cast("string")
        return F.when(one != "", one) if not n else F.lit(None).cast("string")
    if f.type == "DATE":
        parts = [p(c).cast("string") for p in (F.year, F.month, F.dayofmonth)]
        if n >= len(parts):
            return F.lit(None).cast("string")
    else:
        whole = F.split(c.cast("string"), "/")
        parts = [F.get(whole, i) for i in range(n + 1)]
    test = parts[0] != ""
    for part, want in zip(parts, path, strict=False):
        test &= part == want
    return F.when(test, parts[n])


def under(path: list | tuple):
    """A test of paths: is it this one, or below it?"""
    want = F.array(*map(F.lit, path))
    return lambda p: F.slice(p, 1, len(path)) == want


def children(all_paths: Column, path: tuple) -> Column:
    """The labels one level below a path, each once."""
    n = len(path)
    under = F.filter(all_paths, lambda p: (F.size(p) > n) & (F.slice(p, 1, n) == F.array(*map(F.lit, path)) if n else F.lit(True)))
    return F.array_distinct(F.transform(under, lambda p: F.get(p, n)))


def count(hits: DataFrame, all_paths: Column, path: tuple = (), top: int = 10) -> DataFrame:
    out = hits.select(F.explode(children(all_paths, path)).alias("label")).groupBy("label").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "label")
    return out if top < 0 else out.limit(top)


def count_labels(hits: DataFrame, one: Column, top: int = 10) -> DataFrame:
    """`count` for a field with one label a row."""
    out = hits.select(one.alias("label")).where("label is not null").groupBy("label").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "label")
    return out if top < 0 else out.limit(top)


def count_many_labels(hits: DataFrame, dims: dict[str, Column]) -> DataFrame:
    """`count_many` for fields with one label a row: a row for each dimension, counted together."""
    pairs = hits.select(F.stack(F.lit(len(dims)), *[x for d, c in dims.items() for x in (F.lit(d), c)])).toDF("dimension", "label")
    return pairs.where("label is not null").groupBy("dimension", "label").agg(F.count("*").alias("count"))


def count_many(hits: DataFrame, dims: dict[str, Column]) -> DataFrame:
    """Several facets in one pass: (dimension, label) pairs are exploded once and counted together."""

    def labelled(dimension: str):
        return lambda x: F.struct(F.lit(dimension).alias("dimension"), x.alias("label"))

    none = F.array().cast("array<struct<dimension:string,label:string>>")
    pairs = F.flatten(F.array(*[F.coalesce(F.transform(children(p, ()), labelled(d)), none) for d, p in dims.items()]))
    return hits.select(F.inline(pairs)).groupBy("dimension", "label").agg(F.count("*").alias("count"))


def gamma(accuracy: float) -> float:
    return (1 + accuracy) / (1 - accuracy)


def statistics(hits: DataFrame, values: Column, by: Column | None, path: tuple, top: int, points: tuple[float, ...] = (), accuracy: float = 0.001) -> DataFrame:
    if any(not 0 <= p <= 1 for p in points):
        raise QueryError("quantile points lie between 0 and 1")
    base = hits.select(values.alias("v"), *([F.explode(children(by, path)).alias("label")] if by is not None else []))
    n = F.coalesce(F.size("v"), F.lit(0))
    aggs = [
        F.min(F.array_min("v")).alias("min"),
        F.max(F.array_max("v")).alias("max"),
        F.sum(F.when(n > 0, F.aggregate("v", F.lit(0).cast("double"), lambda a, x: a + x))).alias("sum"),
        F.sum(F.when(n > 0, 1).otherwise(0)).alias("doc_count"),
        F.count("*").alias("all_doc_count"),
        F.sum(F.greatest(n, F.lit(0))).cast("long").alias("value_count"),
    ]
    return _finished(base, aggs, by is not None, top, points, accuracy, F.explode("v"))


def statistics_of(hits: DataFrame, value: Column, by: Column | None, top: int, points: tuple[float, ...] = (), accuracy: float = 0.001) -> DataFrame:
    """`statistics` of a field with one value a row, by one label a row if asked: plain aggregates."""
    if any(not 0 <= p <= 1 for p in points):
        raise QueryError("quantile points lie between 0 and 1")
    base = hits.select(value.alias("v"), *([by.alias("label")] if by is not None else []))
    base = base.where("label is not null") if by is not None else base
    count = F.count("v")
    aggs = [F.min("v").alias("min"), F.max("v").alias("max"), F.sum(F.col("v").cast("double")).alias("sum"), count.alias("doc_count"), F.count("*").alias("all_doc_count"), count.alias("value_count")]
    return _finished(base, aggs, by is not None, top, points, accuracy, F.col("v"))


def _finished(base: DataFrame, aggs: list[Column], labelled: bool, top: int, points: tuple[float, ...], accuracy: float, each: Column) -> DataFrame:
    """The aggregates, by label if there is one, largest sum first, with quantiles; `each` makes rows of single values."""
    keys = ["label"] if labelled else []
    out = base.groupBy(*keys).agg(*aggs)
    if keys:
        out = out.orderBy(F.desc_nulls_last("sum"), "label")
        out = out if top < 0 else out.limit(top)
    if points:
        q = quantiles(base.select(*keys, each.alias("x")), "x", points, accuracy, keys)
        out = out.join(q, keys, "left") if keys else out.crossJoin(q)
    return out


def _bin(x: Column, g: float) -> Column:
    """The logarithmic bin of a number, by sign; bins rise with their numbers."""
    return F.when(x == 0, F.lit(0)).otherwise(F.signum(x) * (F.ceil(F.log(F.abs(x)) / math.log(g)) + F.lit(1 << 20))).cast("long")


def _ranked(df: DataFrame, name: str, accuracy: float, keys: list[str]) -> DataFrame:
    """(keys, b, n, upto, total): counted bins of a column with running sums. There are as many rows as bins, not values."""
    x = F.col(name).cast("double")
    bins = df.where(x.isNotNull() & ~F.isnan(x)).groupBy(*keys, _bin(x, gamma(accuracy)).alias("b")).agg(F.count("*").alias("n"))
    bins = bins.withColumn("upto", F.sum("n").over(Window.partitionBy(*keys).orderBy("b")))
    return bins.withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))


def _rank(q: float) -> Column:
    return F.floor(F.lit(q) * (F.col("total") - 1))


def _holds(rank: Column) -> Column:
    return (F.col("upto") > rank) & (F.col("upto") - F.col("n") <= rank)


def quantiles(df: DataFrame, name: str, points: tuple[float, ...], accuracy: float, keys: list[str]) -> DataFrame:
    """Quantiles with a relative error of `accuracy`, as q0, q1, ... in the order of the points.

    Values fall into logarithmic bins by sign; bins are counted first, so what is sorted afterwards has as many rows as
    there are bins. The answer is the value in the middle of the bin that holds rank floor(q * (n - 1)).
    """
    g = gamma(accuracy)
    k = F.abs(F.col("b")) - (1 << 20)
    middle = F.when(F.col("b") == 0, 0.0).otherwise(F.signum("b") * 2 * F.pow(F.lit(g), k) / (g + 1))
    return _ranked(df, name, accuracy, keys).groupBy(*keys).agg(*[F.max(F.when(_holds(_rank(q)), middle)).alias(f"q{i}") for i, q in enumerate(points)])


def exact_quantiles(df: DataFrame, name: str, points: tuple[float, ...], keys: list[str]) -> DataFrame:
    """Order statistics at floor(q * (n - 1)), exactly.

    A first pass counts logarithmic bins, as for `quantiles`, which tells the bin of each point and the rank inside it.
    A second pass counts the different values of those bins only, so no window holds more values than one bin has.
    """
    accuracy = 0.001
    x = F.col(name).cast("double")
    want = F.filter(F.array(*[F.when(_holds(_rank(q)), F.struct(F.lit(i).alias("i"), (_rank(q) - (F.col("upto") - F.col("n"))).alias("rank"))) for i, q in enumerate(points)]), lambda w: w.isNotNull())
    wanted = _ranked(df, name, accuracy, keys).select(*[F.col(k).alias(f"k_{k}") for k in keys], F.col("b").alias("k_b"), want.alias("want")).where(F.size("want") > 0)
    rows = df.where(x.isNotNull() & ~F.isnan(x)).select(*keys, F.col(name).alias("x"), _bin(x, gamma(accuracy)).alias("b"))
    same = F.col("b") == F.col("k_b")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"k_{k}"))
    counts = rows.groupBy(*keys, "b", "x").agg(F.count("*").alias("n")).join(wanted, same)
    counts = counts.withColumn("upto", F.sum("n").over(Window.partitionBy(*keys, "b").orderBy("x")))

    def held(i: int) -> Column:
        return F.exists("want", lambda w: (w["i"] == i) & _holds(w["rank"]))

    return counts.groupBy(*keys).agg(*[F.max(F.when(held(i), F.col("x"))).alias(f"q{i}") for i in range(len(points))])
