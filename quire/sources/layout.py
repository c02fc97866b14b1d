"""Raw page layouts (JSON of blocks, lines, spans) as blocks and as nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOX = "array<double>"
LAYOUT = f"struct<blocks:array<struct<type:int,bbox:{BOX},lines:array<struct<bbox:{BOX},spans:array<struct<text:string,size:double,flags:int,font:string,color:bigint,bbox:{BOX}>>>>,width:int,height:int,ext:string>>>"


def parsed(layout: Column) -> Column:
    """A layout column from JSON; null where it does not parse."""
    return F.from_json(layout, LAYOUT)


def _text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.coalesce(s["text"], F.lit(""))), "")


def layout_blocks(pages: DataFrame, layout: str = "raw_layout") -> DataFrame:
    """One row per text block: number from 0 among the non-blank ones, text, box, line count, font sizes, style."""
    blocks = F.filter(parsed(F.col(layout))["blocks"], lambda b: (b["type"] == 0) & F.exists(b["lines"], lambda x: F.trim(_text(x["spans"])) != ""))
    rows = pages.select(*[c for c in pages.columns if c != layout], F.posexplode(blocks).alias("block_index", "b"))
    lines = F.filter(F.col("b.lines"), lambda x: F.trim(_text(x["spans"])) != "")
    longest = lambda x: F.array_max(F.transform(x["spans"], lambda s: F.struct(F.length(s["text"]).alias("n"), s["size"].alias("size"), s["flags"].alias("flags"))))
    fonts = F.transform(lines, lambda x: longest(x)["size"])
    flags = F.flatten(F.transform(lines, lambda x: F.transform(x["spans"], lambda s: s["flags"])))
    return rows.select(
        *[c for c in rows.columns if c != "b"], F.array_join(F.transform(lines, lambda x: F.trim(_text(x["spans"]))), "\n").alias("text"),
        F.struct(*(F.get("b.bbox", F.lit(i)).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1")))).alias("bbox"), F.size(lines).alias("line_count"), F.array_max(fonts).alias("max_font_size"),
        F.aggregate(fonts, F.lit(0.0), lambda a, x: a + x, lambda a: a / F.size(fonts)).alias("avg_font_size"), F.exists(flags, lambda f: f.bitwiseAND(F.lit(16)) > 0).alias("is_bold"), F.exists(flags, lambda f: f.bitwiseAND(F.lit(2)) > 0).alias("is_italic"),
    )


def layout_nodes(pages: DataFrame, keys: list[str], layout: str = "raw_layout", level: str | None = None) -> DataFrame:
    """Block, image, line and span nodes with ids such as b0_l1_s2 and their parents; blank lines keep no spans."""
    b = pages.select(*keys, F.posexplode(parsed(F.col(layout))["blocks"]).alias("i", "b"))
    block_id = F.concat(F.lit("b"), "i")
    empty = F.lit(None).cast("string")
    blocks = b.select(*keys, block_id.alias("id"), F.lit(0).alias("depth"), F.when(F.col("b.type") == 1, "image").otherwise("block").alias("node_type"), empty.alias("parent_id"), empty.alias("text"))
    x = b.select(*keys, block_id.alias("parent_id"), F.posexplode("b.lines").alias("j", "line"))
    line_id = F.concat("parent_id", F.lit("_l"), "j")
    lines = x.select(*keys, line_id.alias("id"), F.lit(1).alias("depth"), F.lit("line").alias("node_type"), "parent_id", _text(F.col("line.spans")).alias("text"))
    s = x.where(F.trim(_text(F.col("line.spans"))) != "").select(*keys, line_id.alias("parent_id"), F.posexplode("line.spans").alias("k", "span"))
    spans = s.select(*keys, F.concat("parent_id", F.lit("_s"), "k").alias("id"), F.lit(2).alias("depth"), F.lit("span").alias("node_type"), "parent_id", F.col("span.text").alias("text"))
    out = blocks.unionByName(lines).unionByName(spans)
    return out.where(F.col("node_type") == level) if level else out
