"""Audit rules over sections, chunks and blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.sequences import gaps


def orphan_blocks(content: DataFrame, referenced: DataFrame, document: str, block: str, sample: int = 15) -> DataFrame:
    """(document, orphans, severity, sample): content blocks that no chunk has; major if more than three."""
    left = content.join(referenced.select(document, block).distinct(), [document, block], "left_anti")
    return left.groupBy(document).agg(F.count(F.lit(1)).alias("orphans"), F.slice(F.array_sort(F.collect_set(block)), 1, sample).alias("sample")).withColumn("severity", F.when(F.col("orphans") > 3, "major").otherwise("minor"))


def chunk_uniqueness(chunks: DataFrame, members: str) -> DataFrame:
    """One row: chunks, distinct member sets, duplicates, ratio (1 for none)."""
    signed = chunks.select(F.array_join(F.array_sort(F.array_distinct(members)), "|").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    out = signed.agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("chunks"), F.count(F.lit(1)).alias("unique_chunks"))
    return out.withColumns({"duplicates": F.col("chunks") - F.col("unique_chunks"), "ratio": F.coalesce(F.try_divide("unique_chunks", "chunks"), F.lit(1.0))})


def page_gaps(pages: DataFrame, keys: list[str], page: str) -> DataFrame:
    return gaps(pages, keys, page)


def truncated_titles(titles: DataFrame, title: str, known: tuple[str, ...] = ()) -> DataFrame:
    """Short titles in capitals that no other title extends. Titles are distinct and few beside the blocks."""
    t = titles.select(F.col(title).alias("t")).distinct()
    short = t.where((F.upper("t") == F.col("t")) & (F.size(F.split("t", " ")) <= 4) & (F.length("t") < 25) & ~F.col("t").isin(*known) if known else (F.upper("t") == F.col("t")) & (F.size(F.split("t", " ")) <= 4) & (F.length("t") < 25))
    longer = t.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("t") - 1, F.lit(1))), lambda n: F.substring(F.col("t"), F.lit(1), n))).alias("t"), F.length("t").alias("n")).where(F.length("t") < F.col("n")).select("t").distinct()
    return short.join(longer, "t", "left_anti")


def empty_sections(sections: DataFrame, chunks: DataFrame, section: str, parent: str, chunk_section: str) -> DataFrame:
    """Sections without chunks and without a direct child that has some."""
    full = chunks.select(F.col(chunk_section).alias("_s")).distinct()
    parents = sections.join(full, sections[section] == full["_s"]).select(F.col(parent).alias("_s")).distinct()
    return sections.join(full.unionByName(parents).distinct(), F.col(section) == F.col("_s"), "left_anti")


def credits_mixed(chunks: DataFrame, text: str, section_title: str) -> DataFrame:
    t = F.lower(text)
    credit = t.contains("black book") | t.contains("tous droits réservés") | t.contains("tous droits reserves")
    return chunks.where(credit & t.contains("introduction") & (F.upper(F.coalesce(section_title, F.lit(""))) != "CRÉDITS"))
