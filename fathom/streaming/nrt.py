"""Near-real-time storing: a stream of changes replaces documents by id, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.operators.store import latest


def store_stream(changes: DataFrame, table_path: str, checkpoint: str, trigger: dict | None = None):
    """Appends each batch as one version; readers see whole batches. A retried batch replaces its own version only.

    Versions are directories `batch=N`, so storing needs no read of what is stored; `current` merges them.
    """

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table_path}/batch={n}")

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def current(spark: SparkSession, table_path: str, id_field: str, ts: str, deleted: str | None = None) -> DataFrame:
    """The latest version of every document; with `deleted`, a flag column that takes documents out."""
    df = spark.read.option("basePath", table_path).parquet(f"{table_path}/batch=*")
    now = latest(df, id_field, ts).drop("batch")
    return now.where(~F.coalesce(F.col(deleted), F.lit(False))).drop(deleted) if deleted else now


def compact(spark: SparkSession, table_path: str, to: str, id_field: str, ts: str) -> None:
    """Rewrites all versions as one, elsewhere, for a later switch of paths."""
    current(spark, table_path, id_field, ts).write.mode("overwrite").parquet(f"{to}/batch=0")


def windowed_facets(events: DataFrame, ts: str, key: str, value: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by event-time window and key, for batches or, with a watermark, streams. An extension."""
    df = events.withWatermark(ts, late) if events.isStreaming else events
    return df.groupBy(F.window(ts, width).alias("w"), F.col(key)).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), key, "n", "total")
