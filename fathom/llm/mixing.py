"""A training mix of sources by weighted fair queueing, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fathom.llm.common import WORD

#: Weights of the sources in code point order, repeating; the mix's size and a source's most, as shares of sizes.
WEIGHTS, BUDGET, MOST = (5, 2, 1), 1.5, 2.0


def targets(sizes: DataFrame) -> DataFrame:
    """(key, source_size, target): the budget by weight, capped at MOST times each source's size.

    Sources are filled together, in proportion to weight, until each meets its cap. In the order of cap / weight, the
    level of filling with all sources before one capped rises as long as the last one capped lay below it, and falls
    afterwards: the greatest is the level. One row per source: the windows hold as many rows as there are sources.
    """
    k = len(WEIGHTS)
    rank = F.row_number().over(Window.orderBy(F.col("key").asc_nulls_last())) - 1
    w = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.pmod(rank, F.lit(k)).cast("int") + 1)
    s = sizes.withColumn("rank", rank).withColumn("w", w).withColumn("ratio", MOST * F.col("source_size") / F.col("w"))
    order = Window.orderBy("ratio", "rank")
    before = F.coalesce(F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (BUDGET * F.sum("source_size").over(every) - MOST * before) / left
    s = s.withColumn("level", level)
    return s.withColumn("level", F.max("level").over(every)).select("key", "source_size", F.least(MOST * F.col("source_size"), F.col("level") * F.col("w")).alias("target"))


def mix_sources(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: size, source_size, target, taken and finish, in the order of the mix.

    size counts words. Documents of a source queue in the order of md5(doc_id) (ties by doc_id, then by md5 of the
    text), once more after the last. finish is the virtual time when the first copy is sent: words of the source up to
    its end, divided by the source's target. All targets are met at virtual time 1, when the words sent make up the
    budget, so the queue ends there; the document that a source is sending then is taken as far as it got. Nothing is
    taken more than twice, as targets are no more than twice a source's size.

    Running sums are made in two levels, within 4096 ranges of md5 for each source and over the ranges, so that a
    source with a third of all rows isn't one task. Null texts have size 0; a null source is a source of its own, the
    last; documents of size 0 take 0. finish is null where the target is 0. Empty tables give no rows.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    md = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    kept = [F.col(f"`{c}`").alias(f"keep{i}") for i, c in enumerate(keep)]
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("key"), size.alias("size"), md.alias("md"), F.md5(F.coalesce("text", F.lit(""))).alias("tie"), F.substring(md, 1, 3).alias("part"), *kept)
    parts = d.groupBy("key", "part").agg(F.sum("size").alias("n"))
    sums = parts.groupBy("key").agg(F.sum("n").alias("source_size"))
    parts = parts.withColumn("ahead", F.sum("n").over(Window.partitionBy("key").orderBy("part")) - F.col("n"))
    goal, p = targets(sums).alias("g"), parts.alias("p")
    p = p.join(goal, F.col("p.key").eqNullSafe(F.col("g.key"))).select("p.key", "p.part", "p.ahead", "g.source_size", "g.target")
    p, q = p.alias("p"), d.alias("q")
    both = q.join(p, F.col("q.key").eqNullSafe(F.col("p.key")) & (F.col("q.part") == F.col("p.part"))).select("q.*", "p.ahead", "p.source_size", "p.target")
    own = Window.partitionBy("key", "part").orderBy("md", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("before", F.col("ahead") + F.sum("size").over(own) - F.col("size"))
    whole = F.floor("target").cast("long")
    once = F.greatest(F.lit(0), F.least(F.col("size"), whole - F.col("before")))
    twice = F.greatest(F.lit(0), F.least(F.col("size"), whole - F.col("source_size") - F.col("before")))
    finish = F.when(F.col("target") > 0, (F.col("before") + F.col("size")) / F.col("target"))
    out = both.select("doc_id", "size", "source_size", "target", (once + twice).alias("taken"), finish.alias("finish"), *(F.col(f"keep{i}").alias(c) for i, c in enumerate(keep)))
    return out.orderBy("finish", "doc_id")


ORACLE = r"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
  md5(coalesce(doc_id::varchar, '')) as md, md5(coalesce(text, '')) as tie from documents),
s as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as rank from d group by source),
w as (select *, case rank % 3 when 0 then 5 when 1 then 2 else 1 end as w from s),
r as (select *, 2.0::double * source_size / w as ratio from w),
l as (select *, (1.5::double * sum(source_size) over () - 2.0::double * coalesce(sum(source_size) over (order by ratio, rank rows between unbounded preceding and 1 preceding), 0)::bigint)
  / sum(w) over (order by ratio, rank rows between current row and unbounded following)::bigint as level from r),
t as (select source, source_size, least(2.0::double * source_size, w * (select max(level) from l)) as target from l),
q as (select d.*, t.source_size, t.target, sum(size) over (partition by d.source order by md, doc_id, tie rows unbounded preceding)::bigint - size as before from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
  (greatest(0, least(size, floor(target)::bigint - before)) + greatest(0, least(size, floor(target)::bigint - source_size - before)))::bigint as taken,
  case when target > 0 then (before + size) / target end as finish from q
"""
