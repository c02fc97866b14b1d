"""Identifiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def page_id(doc: Column, page: Column) -> Column:
    return F.format_string("page_%s_%04d", doc, page)


def block_id(doc: Column, page: Column, index: Column) -> Column:
    return F.format_string("block_%s_%03d_%03d", doc, page, index)


def chunk_id(doc: Column, page: Column, index: Column) -> Column:
    return F.format_string("chunk_%s_%03d_%03d", doc, page, index)


def lane_block_id(lane: str, doc: Column, page: Column, index: Column) -> Column:
    return F.format_string(f"{lane}_%s_%04d_%04d", doc, page, index)


def new_id(prefix: str, *natural: Column) -> Column:
    """A short id of a natural key (repeatable, unlike a random one)."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(F.concat_ws("|", *natural), 256), 1, 12))


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def document_id(content: Column) -> Column:
    return F.concat(F.lit("doc_"), F.substring(content_hash(content), 1, 12))
