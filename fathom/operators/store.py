"""Documents as rows of a table: replace by id, delete, fetch, dump and restore, and what a table holds."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.config import IndexConfig


def upsert(stored: DataFrame, changes: DataFrame, id_field: str, ts: str) -> DataFrame:
    """The latest version of every document: one aggregate over both, which combines before its shuffle."""
    both = stored.unionByName(changes, allowMissingColumns=True)
    return latest(both, id_field, ts)


def latest(df: DataFrame, id_field: str, ts: str) -> DataFrame:
    """Per id the row with the greatest timestamp; among equal ones the greatest row, so that reruns agree."""
    whole = F.struct(F.col(ts).alias("_at"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))
    return df.groupBy(id_field).agg(F.max(whole).alias("w")).select("w._row.*")


def delete(stored: DataFrame, ids: DataFrame, id_field: str) -> DataFrame:
    """Without the listed ids. Null ids list nothing."""
    return stored.join(ids.select(id_field).distinct(), id_field, "left_anti")


def fetch(stored: DataFrame, id_field: str, one, fields: tuple[str, ...] = (), masked: tuple[str, ...] = ()) -> DataFrame:
    from fathom.operators.search import project

    return project(stored.where(F.col(id_field) == F.lit(one)), id_field, fields, masked)


def batch_fetch(stored: DataFrame, ids: DataFrame, id_field: str) -> DataFrame:
    """A row for every asked id; those that aren't stored come with nulls and found = false."""
    return ids.select(id_field).distinct().join(stored.withColumn("found", F.lit(True)), id_field, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def shard_of(id_column: Column, shards: int) -> Column:
    """A shard number: the size of the id's 64-bit djb2 hash, wrapping as machine words do, modulo the shards.

    The characters of ids lie in the basic plane. The one hash without a positive counterpart, -2**63, is taken as 2**63.
    """
    # 33 * h + c is kept below 2**63 by splitting h; ANSI arithmetic never overflows
    mask = (1 << 32) - 1

    def step(acc: Column, ch: Column) -> Column:
        low = acc["lo"] * 33 + F.ascii(ch).cast("long")
        high = acc["hi"] * 33 + F.shiftrightunsigned(low, 32)
        return F.struct(high.bitwiseAND(F.lit(mask)).alias("hi"), low.bitwiseAND(F.lit(mask)).alias("lo"))

    start = F.struct(F.lit(0).cast("long").alias("hi"), F.lit(5381).cast("long").alias("lo"))
    h = F.aggregate(F.filter(F.split(id_column, ""), lambda c: c != ""), start, step, lambda a: F.shiftleft(a["hi"], 32).bitwiseOR(a["lo"]))
    rest = h % shards  # has the sign of h; |h| % n = |h % n|
    return F.abs(rest).cast("int")


def dump(df: DataFrame, config: IndexConfig, path: str) -> None:
    """Gzipped JSON lines and the settings, by Spark's writers, so any shared store will do."""
    df.write.mode("overwrite").option("compression", "gzip").json(os.path.join(path, "documents"))
    df.sparkSession.createDataFrame([(config.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(os.path.join(path, "settings"))


def restore(spark: SparkSession, path: str, schema: T.StructType | None = None) -> tuple[DataFrame, IndexConfig]:
    reader = spark.read.schema(schema) if schema else spark.read
    settings = "".join(r.value for r in spark.read.text(os.path.join(path, "settings")).collect())
    return reader.json(os.path.join(path, "documents")), IndexConfig.from_json(settings)


def files_table(spark: SparkSession, path: str) -> DataFrame:
    """Associated files: path, modification time, length and content, read only where asked for."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).withColumn("filename", F.element_at(F.split("path", "/"), -1))


def schema_tally(df: DataFrame) -> DataFrame:
    """(path, kind, docs): for every dotted path how many documents have a value there. One pass over the table."""
    found: list[tuple[str, str, Column]] = []

    def walk(prefix: str, c: Column, t: T.DataType) -> None:
        kind = "list" if isinstance(t, T.ArrayType) else "document" if isinstance(t, T.StructType) else t.simpleString()
        found.append((prefix, kind, c.isNotNull()))
        if isinstance(t, T.StructType):
            for f in t.fields:
                walk(f"{prefix}.{f.name}", c[f.name], f.dataType)

    for f in df.schema.fields:
        walk(f.name, F.col(f"`{f.name}`"), f.dataType)
    counts = df.agg(*[F.count_if(c).alias(f"c{i}") for i, (_, _, c) in enumerate(found)])
    rows = F.array(*[F.struct(F.lit(p).alias("path"), F.lit(k).alias("kind"), F.col(f"c{i}").alias("docs")) for i, (p, k, _) in enumerate(found)])
    return counts.select(F.inline(rows))


def json_tally(df: DataFrame, name: str) -> DataFrame:
    """(key, type, docs) over a column of JSON objects: what keys occur and what they hold."""
    v = F.try_parse_json(F.col(name))
    keys = df.select(F.explode(F.json_object_keys(name)).alias("key"), v.alias("v"))
    kind = F.schema_of_variant(F.try_variant_get("v", F.concat(F.lit("$."), F.col("key")), "variant"))
    return keys.select("key", kind.alias("type")).groupBy("key", "type").agg(F.count("*").alias("docs"))


def config_json(config: IndexConfig) -> dict:
    return json.loads(config.to_json())
