"""Connected components of an edge table by alternating large and small stars, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import cut_lineage


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    hung = down.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.unionByName(low.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, label) for every node of `edges` (columns a, b): label is the smallest node of its component.

    Self-loops and repeated edges do no harm; an edge with a null end is left out; no edges, no rows.
    Every round writes its edges to the shared checkpoint folder; only counts and sums of hashes reach the driver.
    """
    now = cut_lineage(edges.where("a <> b").select("a", "b").distinct())
    mark = None
    for _ in range(max_rounds):
        now = cut_lineage(_small_star(_large_star(now)))
        new = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    out = now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return out.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
