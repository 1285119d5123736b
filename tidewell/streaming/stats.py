"""Statistics and classes kept up to date as files or events arrive."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewell.operators.clean import counted_ingest
from tidewell.operators.demand import classify_demand
from tidewell.schema import K
from tidewell.streaming.upsert import upsert

#: Name of the counters of a stream.
INGEST = "ingest"


def _days(day: Column) -> Column:
    return F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position(day)))


def stream_series_stats(sales: DataFrame, first: str = "2018-01-01") -> DataFrame:
    """Running count, sum, squares and distinct days of each couple (complete or update mode).

    Days are bits of one bitmap: 32768 days (89 years) from ``first`` on; a day outside ends
    the query with an error, so none is left out in silence.
    """
    since = (F.datediff("date", F.lit(first).cast("date")) + 1).cast("long")
    outside = F.raise_error(F.concat(F.lit("day outside the bitmap: "), F.col("date").cast("string"))).cast("long")
    since = F.when(since.isNull() | since.between(1, 32768), since).otherwise(outside)
    q = F.col("QUANTITE")
    return sales.groupBy(*K).agg(F.count("*").alias("n"), F.sum(q).alias("somme"), F.sum(F.when(q > 0, q * q)).alias("carres"), F.sum(F.when(q > 0, q)).alias("somme_nz"), F.count_if(q > 0).alias("n_nz"), _days(since).alias("nb_jours_obs"), _days(F.when(q > 0, since)).alias("nb_jours_demand"))


def running_class(stats: DataFrame) -> DataFrame:
    mean = F.try_divide("somme_nz", "n_nz")
    var = F.greatest(F.try_divide("carres", "n_nz") - mean * mean, F.lit(0.0))
    return stats.withColumn("profil_demande", classify_demand(F.try_divide("nb_jours_obs", "nb_jours_demand"), F.try_divide(var, mean * mean)))


def stream_class_updates(sales: DataFrame, path: str, checkpoint: str, first: str = "2018-01-01") -> StreamingQuery:
    """Statistics and class of each couple kept up to date; no day is before ``first``.

    A batch brings the couples that it changed, and only those are written (``upsert``);
    ``read_current`` gives each couple's latest row.
    """

    def change(batch: DataFrame, number: int) -> None:
        upsert(running_class(batch), number, path, K)

    return stream_series_stats(sales, first).writeStream.outputMode("update").foreachBatch(change).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_ingest(raw: DataFrame, path: str, checkpoint: str, **window) -> StreamingQuery:
    """Valid dated sales of raw rows, appended as they arrive; what is left out is counted in the same pass (``ingest_counts``)."""
    kept = counted_ingest(raw, INGEST, **window)
    return kept.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _progress(query: StreamingQuery) -> list[dict]:
    """Progress of every batch of this run; fails where Spark has kept only the last ones."""
    found = [json.loads(p.json) for p in query.recentProgress]
    kept = int(SparkSession.active().conf.get("spark.sql.streaming.numRecentProgressUpdates", "100"))
    if len(found) >= kept:
        raise ValueError(f"{kept} batches or more: raise spark.sql.streaming.numRecentProgressUpdates")
    return found


def ingest_counts(query: StreamingQuery) -> dict[str, int]:
    """Sums of the counters of ``stream_ingest`` over the batches of a run."""
    total: dict[str, int] = {}
    for p in _progress(query):
        for name, n in p.get("observedMetrics", {}).get(INGEST, {}).items():
            total[name] = total.get(name, 0) + n
    return total


def late_rows(query: StreamingQuery) -> int:
    """Rows that the watermark of a run dropped as too late."""
    return sum(op.get("numRowsDroppedByWatermark", 0) for p in _progress(query) for op in p.get("stateOperators", []))


def stream_daily_demand(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Daily totals of each event type and user; rows later than the watermark are dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", "1 day"), "event_type", "user_id").agg(F.sum("value").alias("total"), F.count("*").alias("n"))


def stream_score(rows: DataFrame, model: PipelineModel, path: str, checkpoint: str) -> StreamingQuery:
    """New rows scored with a saved model, appended."""
    scored = model.transform(rows).withColumn("prediction", F.greatest("prediction", F.lit(0.0)))
    keep = [c for c in scored.columns if scored.schema[c].dataType.typeName() not in ("vectorudt", "udt")]
    return scored.select(*keep).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
