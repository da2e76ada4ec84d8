"""Feature statistics, scalers, classifier metrics and a dense classifier over vectors of features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.operators.facets import exact_quantiles, quantiles

POINTS = (0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95)
NAMES = ("p05", "p10", "p25", "p50", "p75", "p90", "p95")


def feature_stats(df: DataFrame, name: str, exact: bool = False, accuracy: float = 0.0001) -> DataFrame:
    """(feature, min, max, avg, p05 ... p95): exact order statistics, or with a relative error."""
    long = df.select(F.posexplode(name).alias("feature", "x")).withColumn("x", F.col("x").cast("double"))
    base = long.groupBy("feature").agg(F.min("x").alias("min"), F.max("x").alias("max"), F.avg("x").alias("avg"))
    q = exact_quantiles(long, "x", POINTS, ["feature"]) if exact else quantiles(long, "x", POINTS, accuracy, ["feature"])
    return base.join(q.withColumnsRenamed({f"q{i}": n for i, n in enumerate(NAMES)}), "feature")


def _rows(stats: DataFrame) -> list:
    return stats.orderBy("feature").collect()


def min_max(c: Column, stats: DataFrame) -> Column:
    """(x - min) / (max - min) for each feature, 0 where that isn't a number."""
    rows = _rows(stats)
    low, high = (F.array(*[F.lit(r[k]) for r in rows]) for k in ("min", "max"))
    return F.transform(c, lambda x, i: F.coalesce(F.try_divide(x.cast("double") - F.get(low, i), F.get(high, i) - F.get(low, i)), F.lit(0.0)))


def percentile_clip(c: Column, stats: DataFrame, low: str = "p25", high: str = "p75", clip: float = 3.0) -> Column:
    """(x - avg) / (high - low), with max - min where that is 0, clipped to both sides."""
    rows = _rows(stats)
    avg = F.array(*[F.lit(r["avg"]) for r in rows])
    size = F.array(*[F.lit((r[high] - r[low]) or (r["max"] - r["min"])) for r in rows])
    return F.transform(c, lambda x, i: F.greatest(F.lit(-clip), F.least(F.lit(clip), F.coalesce(F.try_divide(x.cast("double") - F.get(avg, i), F.get(size, i)), F.lit(0.0)))))


def binary_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: the confusion counts, precision, recall, f1 and accuracy."""
    t, p = F.col(truth) == 1, F.col(predicted) == 1
    c = df.agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    c = c.withColumn("precision", F.try_divide("tp", F.col("tp") + F.col("fp"))).withColumn("recall", F.try_divide("tp", F.col("tp") + F.col("fn")))
    c = c.withColumn("f1", F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))
    return c.withColumn("accuracy", F.try_divide(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")))


def class_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(class, tp, fp, fn, precision, recall, f1) for every class, from the confusion counts."""
    cells = df.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    both = F.array(F.struct(F.col("t").alias("class"), F.lit(True).alias("real")), F.struct(F.col("p").alias("class"), F.lit(False).alias("real")))
    c = cells.select("t", "p", "n", F.inline(both)).groupBy("class").agg(F.sum(F.when(F.col("real") & (F.col("t") == F.col("p")), F.col("n")).otherwise(0)).alias("tp"), F.sum(F.when(~F.col("real") & (F.col("t") != F.col("p")), F.col("n")).otherwise(0)).alias("fp"), F.sum(F.when(F.col("real") & (F.col("t") != F.col("p")), F.col("n")).otherwise(0)).alias("fn"))
    c = c.withColumn("precision", F.try_divide("tp", F.col("tp") + F.col("fp"))).withColumn("recall", F.try_divide("tp", F.col("tp") + F.col("fn")))
    return c.withColumn("f1", F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def dense_classifier(df: DataFrame, features: str, label: str, hidden: tuple[int, ...] = (16,), steps: int = 60, seed: int = 7):
    """A fitted dense network over an array column; `transform` adds `prediction`. Labels are 0, 1, ..."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.functions import array_to_vector

    d = df.select(array_to_vector(F.transform(features, lambda x: x.cast("double"))).alias("features"), F.col(label).cast("double").alias("label"))
    r = d.agg(F.max("label").alias("m")).first()
    size = df.select(F.size(features).alias("n")).first().n
    return MultilayerPerceptronClassifier(layers=[size, *hidden, int(r.m) + 1], maxIter=steps, seed=seed).fit(d), d
