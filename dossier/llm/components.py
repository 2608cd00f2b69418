"""Connected components of a large, sparse graph by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.shared import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's larger (``large``) or smaller neighbours and itself to the smallest node among them."""
    if large:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        near = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    linked = near.join(least, "u")
    if large:
        out = linked.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def roots(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long), root being the smallest node that can be reached.

    Large and small stars alternate until nothing changes, in a number of rounds that grows with the logarithm of the
    longest path. Each round is written to the shared folder; only two numbers per round reach the driver.
    """
    before, edges = None, written(edges.distinct(), "links")  # read several times below
    while True:
        edges = written(_star(_star(edges, True), False), "stars")
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if now == before or now[0] == 0:
            break
        before = now
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
