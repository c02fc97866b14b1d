"""Chunks: blocks assigned to sections, grouped under a budget, with their source spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import ids
from quire.operators.sequences import greedy_pack, islands, split_at_flags

BUDGET = 4800


def assign_by_page(blocks: DataFrame, sections: DataFrame) -> DataFrame:
    """Each block's last section (in order) whose pages hold the block's page; blocks outside all keep null."""
    inside = blocks.join(sections.select("document", "section", "page_start", "page_end"), "document").where(F.col("page").between(F.col("page_start"), F.col("page_end")))
    best = inside.groupBy("document", "page", "block_index").agg(F.max("section").alias("section"))
    return blocks.join(best, ["document", "page", "block_index"], "left")


def assign_by_heading(blocks: DataFrame, headings: DataFrame) -> DataFrame:
    """Each block's nearest heading before it in reading order: in its column first, then in any."""
    side = G.side(F.col("bbox"), F.lit(612.0))
    marked = blocks.join(headings.select("document", "page", "block_index", "section"), ["document", "page", "block_index"], "left").withColumn("_side", side)
    order = ["page", G.y_bucket(F.col("bbox.y0")), "bbox.x0", "block_index"]
    before = lambda *keys: F.last("section", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    own = before("document", "page", "_side")
    return marked.withColumn("_own", own).withColumn("_any", before("document")).withColumn("section", F.coalesce("_own", "_any")).drop("_own", "_any", "_side")


def group_blocks(blocks: DataFrame, budget: int = BUDGET) -> DataFrame:
    """`chunk` of each block within its (document, section): runs of one stat id stay together, other runs are cut
    at headings, at page gaps and under the budget. Needs ord, page, stat_id, is_heading and text."""
    keys = ["document", "section"]
    rows = islands(blocks, keys, ["ord"], "stat_id", "_stat")
    w = Window.partitionBy(*keys).orderBy("ord")
    cut = F.col("stat_id").isNull() & (F.col("is_heading") | (F.col("page") > F.lag("page").over(w) + 1))
    rows = split_at_flags(rows, keys, ["ord"], cut, "_cut")
    plain = rows.withColumn("_n", F.when(F.col("stat_id").isNull(), F.length("text")).otherwise(0))
    packed = greedy_pack(plain, [*keys, "_stat", "_cut"], "ord", "_n", budget, "_pack")
    rows = rows.join(packed.withColumnRenamed("section", "_section").withColumnRenamed("document", "_document").withColumnRenamed("ord", "_ord").withColumnRenamed("_stat", "_s2").withColumnRenamed("_cut", "_c2"), F.col("document").eqNullSafe(F.col("_document")) & F.col("section").eqNullSafe(F.col("_section")) & (F.col("ord") == F.col("_ord")) & (F.col("_stat") == F.col("_s2")) & (F.col("_cut") == F.col("_c2")))
    number = F.dense_rank().over(Window.partitionBy(*keys).orderBy("_stat", "_cut", "_pack")) - 1
    return rows.withColumn("chunk", number).select(*blocks.columns, "chunk")


def build_chunks(grouped: DataFrame) -> DataFrame:
    """One row a chunk: text, page range, source spans (per page the ordered block ids and the box around them)."""
    spans = grouped.groupBy("document", "section", "chunk", "page").agg(F.array_sort(F.collect_list(F.struct("ord", "block_index"))).alias("b"), G.union_agg("bbox").alias("bbox"), F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("t"))
    block_ids = F.transform("b", lambda x: ids.block_id(F.col("document"), F.col("page"), x["block_index"]))
    spans = spans.withColumn("span", F.struct("page", block_ids.alias("page_block_ids"), "bbox"))
    out = spans.groupBy("document", "section", "chunk").agg(F.array_sort(F.collect_list("span")).alias("source_spans"), F.min("page").alias("page_start"), F.max("page").alias("page_end"), F.array_sort(F.flatten(F.collect_list("t"))).alias("t"))
    return out.withColumn("text", F.array_join(F.transform("t", lambda x: x["text"]), "\n\n")).drop("t")


def keep_one_stat_chunk(chunks: DataFrame) -> DataFrame:
    """Of the chunks of one stat id the one with most blocks (the first among equals); the others stay as they are."""
    size = F.aggregate("source_spans", F.lit(0), lambda a, s: a + F.size(s["page_block_ids"]))
    w = Window.partitionBy("document", "stat_id").orderBy(size.desc(), "chunk")
    ranked = chunks.withColumn("_r", F.when(F.col("stat_id").isNull(), 1).otherwise(F.row_number().over(w)))
    return ranked.where("_r = 1").drop("_r")


def split_at_substantive_gaps(items: DataFrame, pages: DataFrame, keys: list[str], page: str, decorative: str) -> DataFrame:
    """`items` (keys, page) with `part`, which grows where pages are left out of which one has text (absent pages do not count).

    A page with text is numbered among those of its key, so that no range join is needed: something lies between two
    pages if the number of text pages before the second, less those up to the first, is not 0.
    """
    w = Window.partitionBy(*keys).orderBy(page)
    text = pages.where(~F.col(decorative)).select(*keys, page, F.lit(1).alias("_t")).distinct()
    both = items.select(*keys, page, F.lit(1).alias("_i")).distinct().join(text, [*keys, page], "full")
    counted = both.withColumn("_upto", F.count("_t").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    mine = counted.where("_i IS NOT NULL").withColumn("_below", F.col("_upto") - F.coalesce("_t", F.lit(0)))
    cut = F.coalesce(F.col("_below") > F.lag("_upto").over(w), F.lit(False)).cast("int")
    mine = mine.withColumn("_cut", cut)
    return mine.select(*keys, page, F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("part"))


def split_at_headings_between(items: DataFrame, headings: DataFrame, keys: list[str], order: str) -> DataFrame:
    """`items` with `part`, which grows where a heading of the item's column lies between the item before and it, by y0."""
    w = Window.partitionBy(*keys).orderBy(order)
    rows = items.withColumn("_before", F.lag("bbox.y0").over(w))
    h = headings.select(*keys, F.col("bbox").alias("_h"))
    hit = rows.join(h, keys).where((F.col("_h.y0") > F.col("_before")) & (F.col("_h.y0") < F.col("bbox.y0")) & G.in_column(F.col("bbox"), F.col("_h"))).select(*keys, order, F.lit(1).alias("_cut")).distinct()
    return rows.join(hit, [*keys, order], "left").withColumn("part", F.sum(F.coalesce("_cut", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_before", "_cut")
