"""Coverage of documents whose pages arrive over time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import geometry as G


def running_coverage(pages: DataFrame, document: str = "document", text: str = "text", reject_below: float = 0.3) -> DataFrame:
    """Mean coverage and status of each document so far; for a stream, write it in update or complete mode."""
    ratio = G.coverage(F.coalesce(F.col(text), F.lit("")), F.lit(612.0), F.lit(792.0))
    out = pages.groupBy(document).agg(F.avg(ratio).alias("coverage"), F.count(F.lit(1)).alias("pages"))
    return out.withColumn("status", F.when(F.col("coverage") < reject_below, "rejected").otherwise("completed"))
