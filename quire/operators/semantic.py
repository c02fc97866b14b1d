"""The semantic layer: validations over entities, relations and their sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T

#: Labels of chunks, entities and relations; fixed values.
CHUNK_TYPES = ("location", "npc", "faction", "scene", "encounter", "clue", "secret", "item", "handout", "map", "stat_block", "lore", "rule", "table", "other")
ENTITY_TYPES = ("location", "npc", "faction", "scene", "encounter", "secret", "clue", "item", "monster", "organization", "timeline_event", "handout", "rule_reference")
RELATION_TYPES = ("located_in", "contains", "knows_secret", "reveals", "points_to", "requires", "unlocks", "opposes", "serves", "member_of", "appears_in", "connected_to", "caused_by", "threatens")
LOW_CONFIDENCE = 0.5


def finding(df: DataFrame, code: str, target_type: str, target: Column | str, message: Column, severity: str = "error") -> DataFrame:
    target = F.col(target) if isinstance(target, str) else target
    return df.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.lit(target_type).alias("target_type"), target.cast("string").alias("target_id"), message.cast("string").alias("message"))


def without_refs(entities: DataFrame, refs: DataFrame, id_column: str, ref: str) -> DataFrame:
    missing = entities.join(refs.select(F.col(ref).alias(id_column)).distinct(), id_column, "left_anti")
    return finding(missing, "missing_source_ref", "entity", id_column, F.lit("no source reference"))


def unknown_refs(refs: DataFrame, chunks: DataFrame, owner: str, ref: str, chunk: str, target_type: str = "entity") -> DataFrame:
    """Every reference row to a chunk that does not exist."""
    bad = refs.where(F.col(ref).isNotNull()).join(chunks.select(F.col(chunk).alias(ref)).distinct(), ref, "left_anti")
    return finding(bad, "unknown_chunk_id", target_type, owner, F.concat(F.lit("unknown "), F.col(ref).cast("string")))


def bad_labels(df: DataFrame, id_column: str, label: str, allowed: tuple[str, ...] = CHUNK_TYPES) -> DataFrame:
    return finding(df.where(F.col(label).isNotNull() & ~F.col(label).isin(*allowed)), "invalid_chunk_type", "chunk", id_column, F.col(label))


def bad_confidence(df: DataFrame, id_column: str, value: str, target_type: str) -> DataFrame:
    return finding(df.where(~F.col(value).between(0, 1)), "invalid_confidence", target_type, id_column, F.lit("outside 0 to 1"))


def unknown_blocks(refs: DataFrame, owner: str, document: str, members: str, blocks: DataFrame, block_document: str, block: str) -> DataFrame:
    """Owners whose references name blocks that their document does not have, with these blocks in order."""
    rows = refs.select(F.col(owner), F.col(document), F.posexplode(members).alias("_at", "_m"))
    known = blocks.select(F.col(block_document).alias(document), F.col(block).alias("_m")).distinct()
    left = rows.join(known, [document, "_m"], "left_anti").groupBy(owner).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_m"))), lambda x: x["_m"].cast("string")).alias("_missing"))
    return finding(left, "unknown_page_block_id", "entity", owner, F.array_join("_missing", ","))


def spoiler_hit(text: Column, words: tuple[str, ...] = T.GM_ONLY_KEYWORDS) -> Column:
    """What gives a text away: the first of the words it holds, else the phrase `the truth is`; null for nothing."""
    return F.coalesce(T.first_keyword(text, words), F.when(F.lower(text).rlike(r"\bthe truth is\b"), "the truth is"))


def review_queue(chunks: DataFrame, label: str, confidence: str, least: float = LOW_CONFIDENCE) -> DataFrame:
    """Classified chunks below the confidence, and those without any."""
    return chunks.where(F.col(label).isNull() | (F.col(confidence) < least))


def player_safe(entities: DataFrame, flag: str, hidden: tuple[str, ...]) -> DataFrame:
    """Entities that players may see, without the columns that are not for them."""
    return entities.where(F.coalesce(F.col(flag), F.lit(False))).drop(*hidden)


def unknown_entities(edges: DataFrame, id_column: str) -> DataFrame:
    return finding(edges, "unknown_entity_in_relation", "relation", id_column, F.lit("unknown end"))


def spoilers(df: DataFrame, id_column: str, text: Column, words: tuple[str, ...] = T.GM_ONLY_KEYWORDS) -> DataFrame:
    return finding(df.withColumn("_hit", spoiler_hit(text, words)).where("_hit IS NOT NULL"), "player_safe_spoiler", "entity", id_column, F.col("_hit"))


def relations_without_refs(df: DataFrame, id_column: str, refs: str) -> DataFrame:
    return finding(df.where(F.coalesce(F.size(refs), F.lit(0)) <= 0), "relation_missing_source_ref", "relation", id_column, F.lit("no source reference"), "warning")


def validate(findings: list[DataFrame]) -> DataFrame:
    """All findings in one table."""
    return reduce(DataFrame.unionByName, findings)


def verdict(findings: DataFrame) -> DataFrame:
    """One row: valid (no errors), errors, warnings."""
    return findings.agg((F.count_if(F.col("severity") == "error") == 0).alias("valid"), F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))


def classify(chunks: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks with the submitted label and confidence where one is given."""
    new = labels.select(*keys, F.col("chunk_type").alias("_type"), F.col("confidence").alias("_confidence"))
    joined = chunks.join(new, keys, "left")
    return joined.withColumns({"chunk_type": F.coalesce("_type", "chunk_type"), "confidence": F.coalesce("_confidence", "confidence")}).drop("_type", "_confidence")


def summary(chunks: DataFrame, label: str, confidence: str) -> DataFrame:
    """One row of counts: chunks, classified ones, those to review."""
    return chunks.agg(F.count(F.lit(1)).alias("chunks"), F.count(label).alias("classified"), F.count_if(F.col(confidence) < LOW_CONFIDENCE).alias("needs_review"))
