"""Mixing sources to target weights, with DataFrame operations only.

Every document gets a hash-random key.  Within each source the documents lie in
key order; the running total of their words is a distributed prefix sum (per key
range first, then inside each range), and the order is cut at the exact budget
of the source.  A budget beyond the source's size repeats whole epochs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.llm.shared import WORD, durable, table

#: Documents of a source per key range, on average at most.
RANGE_ROWS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """Target of each row (source, source_size, ...): shares by weight, filled up to ``cap`` sizes.

    Weights repeat over the sources in code point order, null last.  Sources fill
    like vessels: taken by rising cap per weight, the highest of the levels that
    result when all earlier ones are full is the common level.  The windows run
    over one row for each source, never over documents.
    """
    everything = Window.partitionBy(F.lit(0))
    by_name = everything.orderBy(F.col("source").asc_nulls_last())
    by_ratio = everything.orderBy("_ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    return (
        sizes.withColumn("_at", (F.row_number().over(by_name) - 1) % len(weights) + 1)
        .withColumn("_weight", F.element_at(F.array(*[F.lit(w) for w in weights]), F.col("_at")).cast("long"))
        .withColumn("_cap", F.col("source_size") * cap)
        .withColumn("_ratio", F.col("_cap").cast("double") / F.col("_weight").cast("double"))
        .withColumn("_left", F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(by_ratio), F.lit(0)))
        .withColumn("_share", F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(by_ratio), F.lit(0)))
        .withColumn("_level", F.max(F.col("_left").cast("double") / F.col("_share").cast("double")).over(everything))
        .withColumn("target", F.least(F.col("_cap").cast("double"), F.col("_level") * F.col("_weight").cast("double")))
        .drop("_at", "_weight", "_cap", "_ratio", "_left", "_share", "_level")
    )


def mix_sources(docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """How many words of each document the mix takes.

    Reads doc_id, source and text; other columns are ignored.  Returns doc_id,
    source, size, source_size, target (of the source) and taken (repeats counted);
    one row for each input row.  The document on which a budget ends is taken in
    part.  Null text counts 0 words, null source is a source of its own, a null
    doc_id is keyed as the empty string; ties of the key fall to doc_id, then size,
    so that reruns agree, and repeated rows count each.  Texts of any length are
    counted whole.  An empty table gives no rows.
    """
    sized = durable(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_docs"))
    depth = F.greatest(F.lit(0), F.ceil(F.log(16.0, F.col("_docs") / RANGE_ROWS))).cast("int")
    targets = durable(source_targets(sizes, weights, cap).withColumn("_depth", depth), "mix-targets")
    budget = F.floor("target").cast("long")
    keyed = (
        sized.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
        .drop("_source", "_docs")
        .withColumn("_key", F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}"))))
        .withColumn("_range", F.substring(F.col("_key"), F.lit(1), F.col("_depth")))
    )
    ranges = keyed.groupBy(F.col("source").alias("_source"), F.col("_range").alias("_of")).agg(F.sum("size").alias("_sum"))
    before = Window.partitionBy("_source").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("_source", "_of", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("source", "_range").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    epochs = F.when(F.col("source_size") > 0, F.expr("_budget div source_size")).otherwise(F.lit(0))
    return (
        keyed.join(ranges, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_range") == F.col("_of")))
        .withColumn("_before", F.col("_base") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .withColumn("_budget", budget)
        .withColumn("_epochs", epochs)
        .withColumn("_rest", F.col("_budget") - F.col("_epochs") * F.col("source_size") - F.col("_before"))
        .withColumn("taken", F.col("_epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest"))))
        .select("doc_id", "source", "size", "source_size", "target", "taken")
    )


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':mix') AS k
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS weight, source_size * 3 AS cap FROM s),
r AS (SELECT *, CAST(cap AS DOUBLE) / CAST(weight AS DOUBLE) AS ratio FROM w),
l AS (SELECT *,
        CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
        / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS lev
      FROM r),
t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), max(lev) OVER () * CAST(weight AS DOUBLE)) AS target FROM l),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
        CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM p)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - before)) AS BIGINT) AS taken
FROM e
"""
