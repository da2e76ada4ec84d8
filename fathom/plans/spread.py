"""Work on texts for all cores, where a small table comes in fewer pieces than there are."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes of table for each core below which its rows are dealt anew: one split of Spark's default size.
SPLIT_BYTES = 128 << 20


def spread(df: DataFrame, key: str | None = None) -> DataFrame:
    """df over all cores if Spark's estimate of its size is below a split for each of them, else df itself.

    A file of one row group is one task, whatever the cores. Dealing its rows before they are split into tokens costs a
    shuffle of at most SPLIT_BYTES a core; larger tables have enough splits of their own and are never shuffled here.
    Rows and columns stay as they are. Rows go by `key`, or in turn without one.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= cores * SPLIT_BYTES:
        return df
    return df.repartition(cores, key) if key in df.columns else df.repartition(cores)
