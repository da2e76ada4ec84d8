"""From raw documents to a training mix: STAGES in order, each over all that its predecessor kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm.common import need_checkpoint_dir, table
from fathom.llm.decontamination import leaks
from fathom.llm.line_dedup import dedup_lines
from fathom.llm.minhash_dedup import near_duplicates
from fathom.llm.mixing import mix_sources
from fathom.llm.quality import fit, score_quality

DOCUMENTS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go: those with a predicted quality of 0."""
    space = fit(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, space, keep=DOCUMENTS[1:]).where("predicted = 1").select(*DOCUMENTS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of two or more lines that occurred before go; so does a document of which nothing else is left."""
    out = dedup_lines(docs, run=2, keep=DOCUMENTS[2:]).where("n_removed = 0 or n_removed < n_lines")
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*DOCUMENTS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, on shingles of five words, the document with the least doc_id stays."""
    gone = near_duplicates(docs, shingle=5).where("not kept").select("doc_id").distinct()
    return docs.select(*DOCUMENTS).join(gone, "doc_id", "left_anti").select(*DOCUMENTS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    gone = leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.select(*DOCUMENTS).join(gone, "doc_id", "left_anti").select(*DOCUMENTS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: for each document its text, its source's target and the words of it that the mix takes, repeats counted."""
    return mix_sources(docs, keep=DOCUMENTS[1:])


STAGES = [("quality_classifier", quality), ("line_dedup", lines), ("minhash_near_dedup", near), ("decontamination", decontaminated), ("source_mixing", mixed)]
#: The first stage learns from data, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage over the others' rows, each written as Parquet below the shared checkpoint folder and read again."""
    need_checkpoint_dir(spark)
    folder = f"{spark.conf.get('spark.checkpoint.dir', None) or spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4()}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
