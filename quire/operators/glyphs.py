"""Lines, runs and paragraphs from glyph positions (columns document, page, x, y, width, font, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PAGE = ("document", "page")


def lines(glyphs: DataFrame) -> DataFrame:
    """`line`: bands of two units, half up."""
    return glyphs.withColumn("line", F.floor(F.col("y") / 2 + 0.5))


def runs(glyphs: DataFrame) -> DataFrame:
    """`run` within each line: a new one at a wide gap or where the font changes by a quarter or more."""
    keys = [*PAGE, "line"]
    w = Window.partitionBy(*keys).orderBy("x")
    gap = F.col("x") - (F.lag("x").over(w) + F.lag("width").over(w))
    rows = lines(glyphs).withColumn("_gap", gap).withColumn("_before", F.lag("font").over(w))
    med = F.coalesce(F.median(F.when(F.col("_gap") < 20, F.col("_gap"))).over(Window.partitionBy(*keys)), F.lit(2.0))
    rows = rows.withColumn("_med", med)
    wide = F.col("_gap") > F.greatest(F.col("_med") * 4, F.col("_med") + 6, F.lit(12.0))
    ratio = F.greatest("font", "_before") / F.least("font", "_before")
    return rows.withColumn("run", F.sum(F.coalesce((wide | (ratio >= 1.25)).cast("int"), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_gap", "_before", "_med")


def segments(glyphs: DataFrame) -> DataFrame:
    """One row a run: its text in order and the box around it."""
    g = runs(glyphs).groupBy(*PAGE, "line", "run").agg(F.array_sort(F.collect_list(F.struct("x", "text"))).alias("t"), F.min("x").alias("x0"), F.max(F.col("x") + F.col("width")).alias("x1"), F.min(F.col("y") - F.col("font")).alias("y0"), F.max(F.col("y") + F.col("font") * 0.25).alias("y1"), F.max("font").alias("font"))
    return g.withColumn("text", F.array_join(F.transform("t", lambda s: s["text"]), "")).drop("t")


def paragraphs(segs: DataFrame, width: float = 612.0) -> DataFrame:
    """Segments of a column as paragraphs: broken at list starts, font changes, indents and wide gaps, not after hyphens or mid-sentence."""
    rows = segs.withColumn("side", F.when((F.col("x0") + F.col("x1")) / 2 < width * 0.48, 0).otherwise(1))
    keys = [*PAGE, "side"]
    w = Window.partitionBy(*keys).orderBy("line", "x0")
    before = lambda c: F.lag(c).over(w)
    gap = F.col("y0") - before("y1")
    rows = rows.withColumn("_gap", gap)
    med = F.coalesce(F.median("_gap").over(Window.partitionBy(*keys)), F.lit(0.0))
    rows = rows.withColumn("_med", med).withColumn("_prev", before("text")).withColumn("_font", before("font")).withColumn("_x0", before("x0")).withColumn("_h", F.col("y1") - F.col("y0"))
    font = (F.greatest("font", "_font") / F.least("font", "_font") >= 1.25) & (F.length("_prev") > 1)
    far = F.col("_gap") > F.greatest(F.col("_med") * 1.8, F.col("_med") + 4, F.col("_h") * 0.4, F.lit(8.0))
    new = F.when(F.col("_prev").isNull(), False).when(F.col("text").rlike(r"^[^\p{L}\p{N}]+ \p{L}"), True).when(font, True).when(F.col("_prev").rlike("-$"), False).when(F.col("_prev").rlike(r"[\p{L},]$") & F.col("text").rlike(r"^\p{Ll}"), False).when(F.abs(F.col("x0") - F.col("_x0")) > 8, True).otherwise(far)
    rows = rows.withColumn("paragraph", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = rows.groupBy(*keys, "paragraph").agg(F.array_sort(F.collect_list(F.struct("line", "x0", "text"))).alias("t"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    return g.withColumn("text", F.array_join(F.transform("t", lambda s: s["text"]), " ")).drop("t")
