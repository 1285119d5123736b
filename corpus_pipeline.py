"""From raw documents to a training mix: five stages, each written and read again.

Every stage takes (spark, docs, sf_dir) and gets all that its predecessor kept; all
but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.ship import ship
from tidewell.llm.decontaminate import find_leaks
from tidewell.llm.language import UNKNOWN, fit_languages, identify
from tidewell.llm.lines import drop_repeated_lines
from tidewell.llm.mixing import mix_sources
from tidewell.llm.neardup import near_duplicates
from tidewell.llm.shared import free_names, shared_dir, table

#: A document stays if its main language has at least this share of it.
MAIN_LANGUAGE = 0.5


def _of_ids(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Semi- or anti-join on doc_id, in which null equals null; the input's other columns may have any names."""
    (own,) = free_names(docs.columns, "id")
    ids = ids.select(F.col("doc_id").alias(own)).distinct()
    return docs.join(ids, F.col("doc_id").eqNullSafe(F.col(own)), how)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a main language; those without letters or without one go."""
    names = free_names(docs.columns, "lang_pred", "score")
    known = identify(docs, fit_languages(docs), docs.columns, tuple(names))
    return known.filter((F.col(names[0]) != UNKNOWN) & (F.col(names[1]) >= MAIN_LANGUAGE)).drop(*names)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs and of long lines are deleted; a document left without text goes."""
    names = free_names(docs.columns, "n_lines", "n_removed", "n_runs")
    cut = drop_repeated_lines(docs, names=tuple(names)).filter((F.col(names[1]) == 0) | (F.length(F.trim("text")) > 0))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col(names[1]) == 0, F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return cut.drop(*names)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, 0.8) stays.

    Of several rows with one doc_id and text the first by their other columns stays, in
    the order of their JSON, so reruns agree.
    """
    kept = _of_ids(docs, near_duplicates(docs).filter("kept"), "left_semi")
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    if not rest:
        return kept.distinct()
    inner = kept.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest"))
    one = inner.groupBy("doc_id", "text").agg(F.min_by("rest", F.to_json("rest")).alias("rest"))
    return one.select(*[F.col(c) if c in ("doc_id", "text") else F.col(f"rest.`{c}`") for c in docs.columns])


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return _of_ids(docs, find_leaks(docs, table(spark, sf_dir, "benchmark")), "left_anti")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    return mix_sources(docs)


STAGES = [
    ("language", language_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", benchmark_stage),
    ("mixing", mixing_stage),
]

#: SQL cannot express language inference and edit matching.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read as the next one's input."""
    ship(spark)
    docs, root = table(spark, sf_dir, "documents"), f"{shared_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.option("compression", "zstd").parquet(f"{root}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{root}/{name}")
    return docs
