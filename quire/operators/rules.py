"""Classification predicates over blocks, as column expressions (c: text, b: box, font sizes, style)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import text as T
from quire.operators.blocks import EMAIL, PAGE_KEY

#: Headings of boxes and markers of editorial credits; fixed values.
META_HEADINGS = ("CRÉDITS", "EN QUELQUES MOTS", "FICHE TECHNIQUE")
REWARD_STARTS = ("RÉCOMPENSE", "RECOMPENSE")
BANNERS = ("INTRODUCTION", "IMPLICATION", "CONCLUSION")
CREDITS_MARKERS = ("black book", "tous droits réservés", "tous droits reserves")


def words(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))


def capitals(c: Column) -> Column:
    """At least one letter and no small one."""
    return c.rlike(r"\p{Lu}") & ~c.rlike(r"\p{Ll}")


def spread_title(c: Column, b: Column, font: Column, median: Column, height: Column) -> Column:
    return capitals(c) & ((font >= 28) | (font >= median * 2)) & (b["y0"] <= height * 0.33) & (words(c) <= 4) & (F.length(F.regexp_replace(c, "[^\n]", "")) <= 1)


def spread_pair(upper: Column, lower: Column, upper_box: Column, lower_box: Column) -> Column:
    return capitals(upper) & capitals(lower) & (lower_box["y0"] >= upper_box["y1"] - 5)


def page_banner(c: Column, b: Column, height: Column) -> Column:
    first = F.element_at(F.split(c, "\n"), 1)
    letters = F.length(F.regexp_replace(first, r"\P{L}", ""))
    starts = F.exists(F.array(*map(F.lit, BANNERS)), lambda m: F.startswith(F.upper(first), m))
    return starts & (b["y0"] < height / 3) & (F.length(F.regexp_replace(first, r"\P{Lu}", "")) >= letters * 0.8)


def conditional_hook(c: Column, font: Column, median: Column, bold: Column) -> Column:
    return c.rlike(r"^Si\s+") & (words(c) <= 10) & bold & (font >= median * 1.05) & (font < median * 1.5)


def meta_box(c: Column) -> Column:
    return T.strip(c).isin(*META_HEADINGS)


def reward_box(c: Column) -> Column:
    return F.exists(F.array(*map(F.lit, REWARD_STARTS)), lambda m: F.startswith(F.upper(T.strip(c)), m))


def narrow_box(c: Column) -> Column:
    return meta_box(c) | reward_box(c)


def credits_heading(c: Column) -> Column:
    return T.strip(c) == META_HEADINGS[0]


def editorial_credits(c: Column) -> Column:
    return T.contains_any(c, CREDITS_MARKERS)


def chapter(c: Column) -> Column:
    return c.rlike(r"(?i)^(?:chapitre|acte|partie|chapter)\s+(?:\d+|[IVXLC]+)\b")


def list_item(c: Column, bold: Column) -> Column:
    return c.rlike(r"^\s*[•◦▪‣*–-]\s+") | (c.rlike(r"^[^:\n]{1,78} :") & (F.length(c) <= 80) & ~(bold & (words(c) <= 6)))


def boxed_title(c: Column, bold: Column) -> Column:
    first = F.element_at(F.split(c, "\n"), 1)
    return bold & capitals(first) & (F.length(first) >= 4) & (words(c) <= 12)


def visual_tier(c: Column, b: Column, height: Column, font: Column, median: Column, bold: Column) -> Column:
    """meta, banner, chapter, subordinate or other, the first that applies."""
    subordinate = conditional_hook(c, font, median, bold) | (bold & ~capitals(c) & (font < median * 1.5))
    return F.when(meta_box(c), "meta").when(page_banner(c, b, height), "banner").when(chapter(c), "chapter").when(subordinate, "subordinate").otherwise("other")


def page_kinds(blocks: DataFrame, width: float = 612.0) -> DataFrame:
    """(document, page, decorative, sparse): by what is left without page labels and running headers."""
    c, b = F.col("text"), F.col("bbox")
    running = (b["x1"] - b["x0"] <= 20) & (b["x0"] >= width * 0.85) & (F.length(c) <= 80) & (words(c) <= 12)
    body = ~c.rlike(r"^PAGE\s+\d+$") & ~running
    out = blocks.groupBy(*PAGE_KEY).agg(F.count_if(body).alias("n"), F.coalesce(F.sum(F.when(body, F.length(T.strip_format(c)))), F.lit(0)).alias("chars"))
    return out.select(*PAGE_KEY, ((F.col("n") == 0) | (F.col("chars") < 30)).alias("decorative"), (F.col("n") <= 2).alias("sparse"))


def parasite(c: Column, b: Column, height: Column) -> Column:
    """The five rules of the glyph extractor: address, order number, page label, top strip, thin line in a margin."""
    return c.rlike(EMAIL) | c.rlike(r"\d{6}/\d+/\d+") | c.rlike(r"PAGE\s+\d+") | ((b["y1"] < height * 0.04) & (F.length(c) < 80)) | ((b["y1"] - b["y0"] < 5) & G.in_margin_band(b, height))


def glyph_parasite(c: Column, font: Column) -> Column:
    return (font <= 7) & c.rlike("^W+$") & (F.length(c) <= 6)


def one_lane(blocks: DataFrame, lane: str = "compare_lane", keep: str = "pymupdf") -> DataFrame:
    """Where any block of a page names a lane, only those without one or of `keep`."""
    some = F.max(F.col(lane)).over(Window.partitionBy(*PAGE_KEY))
    return blocks.withColumn("_some", some).where(F.col("_some").isNull() | F.col(lane).isNull() | (F.col(lane) == keep)).drop("_some")


def in_order(blocks: DataFrame) -> DataFrame:
    """(document, ordered): whether each block's spatial key is above the one before it."""
    key = F.struct("page", G.y_bucket(F.col("bbox.y0")), "bbox.x0")
    w = Window.partitionBy("document").orderBy("page", "block_index")
    return blocks.withColumn("_k", key).withColumn("_ok", F.coalesce(F.col("_k") > F.lag("_k").over(w), F.lit(True))).groupBy("document").agg(F.bool_and("_ok").alias("ordered"))
