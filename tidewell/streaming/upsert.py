"""A table of latest rows by key to which a stream adds only what changes.

The folder holds a base, the changes of later batches, and numbered manifests that name
which of them count.  A batch writes its changed rows and then its manifest, which
readers see at once or not at all.  A batch that is run again overwrites its own files
and builds on the manifest before it, so a restart gives the same rows.  After a
number of batches the changes are merged into a new base.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.folders import get_text, names_in, put_text, remove

#: Batches whose changes are read beside the base before they are merged into it.
MERGE_AFTER = 16


def _manifest(spark: SparkSession, path: str, before: int | None = None) -> dict | None:
    """The last manifest, or the last one of a batch before the given one."""
    known = [n for n in names_in(spark, f"{path}/manifests") if before is None or int(n.split(".")[0]) < before]
    return json.loads(get_text(spark, f"{path}/manifests/{known[-1]}")) if known else None


def _rows(spark: SparkSession, path: str, manifest: dict, keys: list[str]) -> DataFrame:
    """The latest row of each key of what a manifest names."""
    out = None
    for at, folder in enumerate(manifest["folders"]):
        own = spark.read.schema(manifest["schema"]).parquet(f"{path}/{folder}").withColumn("_at", F.lit(at))
        out = own if out is None else out.unionByName(own)
    rest = [c for c in out.columns if c not in (*keys, "_at")]
    latest = out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_at").alias("_row"))
    return latest.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def upsert(batch: DataFrame, number: int, path: str, keys: list[str], merge_after: int = MERGE_AFTER) -> None:
    """Add the changed rows of a batch, one for each key; bytes written follow the rows of the batch."""
    spark, own = batch.sparkSession, f"changes/{number}"
    before = _manifest(spark, path, number) or {"folders": []}
    batch.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{own}")
    manifest = {"folders": [*before["folders"], own], "schema": batch._jdf.schema().toDDL()}
    if len(manifest["folders"]) > merge_after:
        base = f"bases/{number}"
        _rows(spark, path, manifest, keys).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{base}")
        manifest["folders"] = [base]
    put_text(spark, f"{path}/manifests/{number:020d}.json", json.dumps(manifest))
    if len(manifest["folders"]) == 1 and number:
        _forget(spark, path, number, {*before["folders"], *manifest["folders"]})


def _forget(spark: SparkSession, path: str, number: int, named: set[str]) -> None:
    """Remove what neither the new manifest nor the one before it names, which a reader may still have open."""
    manifests = [n for n in names_in(spark, f"{path}/manifests") if int(n.split(".")[0]) < number]
    for name in manifests[:-1]:
        remove(spark, f"{path}/manifests/{name}")
    for kind in ("changes", "bases"):
        for name in names_in(spark, f"{path}/{kind}"):
            if f"{kind}/{name}" not in named and int(name) < number:
                remove(spark, f"{path}/{kind}/{name}")


def read_current(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The latest row of each key as of the last whole batch."""
    manifest = _manifest(spark, path)
    if manifest is None:
        raise ValueError(f"no batch has been written to {path}")
    return _rows(spark, path, manifest, keys)
