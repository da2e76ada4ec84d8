"""What the operators of this subpackage share: reading tables, sizes, checkpoints, components."""

from __future__ import annotations

import gc
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: maximal runs of anything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
#: Edges that a task joins at a time, some MB; if no more are left, one task joins them all.
AT_ONCE = 1 << 17


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def need_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the folder that the cluster names; sets one only for a local session that names none."""
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="fathom-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Materialises df in the shared checkpoint folder, so that lost executors cost no recomputation."""
    need_checkpoint_dir(df.sparkSession)
    out = df.checkpoint()
    drop_unused(df.sparkSession)
    return out


def drop_unused(spark: SparkSession) -> None:
    """Spark removes shuffle files when the driver's garbage is collected; iterations must not wait for that."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def pieces(df: DataFrame, text: str, each: int) -> int:
    """How many pieces of about `each` bytes the texts make: a power of two, from one scan that sums lengths."""
    total = df.agg(F.sum(F.octet_length(F.col(text)).cast("long") + 64)).first()[0] or 0
    return 1 << max(0, (-(-int(total) // each) - 1).bit_length())


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every id in the edges u - v, and the smallest id that it reaches."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    x, y, root = at[: len(u)], at[len(u) :], np.arange(len(ids))
    while True:
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        x, y = low[low < high], high[low < high]
        if not len(x):
            return ids, ids[root]
        np.minimum.at(root, y, x)
        while (root[root] != root).any():
            root = root[root]


def joined(edges: DataFrame, whole: bool) -> DataFrame:
    """(u, v): edges with the same components, AT_ONCE of each task replaced by one from every id to the smallest it reaches there.

    Those from an id to itself are left out unless `whole` asks for them or the id has no other.
    """

    def run(batches):
        held, many = [], 0
        for b in batches:
            held, many = [*held, b], many + b.num_rows
            if many >= AT_ONCE:
                yield flat(held)
                held, many = [], 0
        if many:
            yield flat(held)

    def flat(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        ids, low = forest(*(np.concatenate([b.column(c).to_numpy() for b in held]) for c in (0, 1)))
        _, at, size = np.unique(low, return_inverse=True, return_counts=True)
        keep = whole | (ids != low) | (size[at] == 1)
        return pa.record_batch({"u": pa.array(ids[keep]), "v": pa.array(low[keep])})

    return edges.mapInArrow(run, "u long, v long")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): for every id in an edge the smallest id that it reaches.

    Edges are first joined where they lie. What is left is joined by one task if that is no more than AT_ONCE edges, as
    each round over a few costs the driver as much as one over many; else by rounds.
    """
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u is not null and v is not null")
    e = cut(joined(e, whole=False))
    if e.count() <= AT_ONCE:
        return cut(joined(e.repartition(1), whole=True).toDF("id", "component"))
    return rounds(e)


def rounds(e: DataFrame) -> DataFrame:
    """(id, component) of edges u - v without nulls.

    Minimum labels with pointer jumping, so chains take a logarithmic number of rounds. The driver sees one number a
    round. Every round is cut in the shared folder. Self loops and repeated or reversed edges change nothing.
    """
    e = cut(e.union(e.select("v", "u")).distinct())
    label = e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("m")).select("id", F.least("id", "m").alias("l"))
    label, before = cut(label), None
    while True:
        now = label.agg(F.sum(F.col("l").cast("decimal(38,0)"))).first()[0]
        if now == before:
            return label.select("id", F.col("l").alias("component"))
        before = now
        # hook: the smallest label among the neighbours also lowers the label of one's own root
        seen = e.join(label.select(F.col("id").alias("v"), F.col("l").alias("lv")), "v").groupBy("u").agg(F.min("lv").alias("lv"))
        step = label.join(seen.withColumnRenamed("u", "id"), "id").select("id", "l", F.least("l", "lv").alias("n"))
        roots = step.groupBy(F.col("l").alias("r")).agg(F.min("n").alias("rn"))
        low = step.join(roots, step.l == roots.r).select("id", F.least("n", "rn").alias("n"))
        up = low.select(F.col("id").alias("p"), F.col("n").alias("pn"))
        label = cut(low.join(up, low.n == up.p, "left").select("id", F.least("n", F.coalesce("pn", "n")).alias("l")))
