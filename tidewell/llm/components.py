"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.shared import durable


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hook neighbours to the least node around: larger neighbours, or smaller ones and oneself."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    around = down.unionByName(down.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else down
    least = around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = around.join(least, "u")
    hooked = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    if not large:
        hooked = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return hooked.filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of the links (a, b), except roots; root is the least node reachable.

    Self-links and repeated links do no harm; no links give no rows.  Each round is written to
    the shared folder; rounds end when the links no longer change.
    """
    edges = durable(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    mark = None
    while True:
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == mark or not now[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = now
        edges = durable(_star(_star(edges, True), False), "components")
