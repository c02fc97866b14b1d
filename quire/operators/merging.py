"""Merging of text fragments: which two blocks belong together, and the fold over a page.

Fragments are structs with text, bbox, font (mean size), max_font, bold, italic, lines, role.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import text as T
from quire.operators.blocks import title_case
from quire.operators.rules import boxed_title

#: Characters and words that decide a merge; fixed values.
HYPHENS = "-‐‑–—"
HYPHEN_END = rf"[{HYPHENS}]\s*$"
STRONG_END = r"[.!?»]['\")\]]*\s*$"
ARTICLE_END = r"(?i)\b(?:Les|La|Le|Des|Un|Une|Du|De|l'|d'|n'|s'|m'|t'|c'|j')\s*$"
NEW_UNIT = r"^(?:[\s«•\-–—*]+|[A-Z][A-Z\s]{3,})"
SMALL_START = r"^\s*\p{Ll}"


def same_column(a: Column, b: Column) -> Column:
    return G.overlap_ratio(a, b) >= 0.25


def heading_like(x: Column) -> Column:
    """A stat block's head, a short bold text of some size, or a short text in capitals."""
    text = T.strip(x["text"])
    size = F.coalesce(F.nullif(x["font"], F.lit(0.0)), x["max_font"], F.lit(0.0))
    capitals = text.rlike(r"\p{Lu}") & (F.upper(text) == text)
    return F.coalesce(x["role"].isin("header", "stats", "icon"), F.lit(False)) | ((text != "") & ((x["bold"] & (F.length(text) < 80) & (size >= 12)) | ((F.length(text) < 50) & capitals)))


def compatible_style(a: Column, b: Column) -> Column:
    size = lambda x: F.coalesce(F.nullif(x["font"], F.lit(0.0)), F.nullif(x["max_font"], F.lit(0.0)))
    return a["italic"].eqNullSafe(b["italic"]) | (~heading_like(b) & F.coalesce(F.abs(size(a) - size(b)) <= 1.5, F.lit(False)))


def wraps_around(a: Column, b: Column, width: float = 612.0) -> Column:
    """From the left column to the right: a sentence goes on beside an illustration, or from the bottom to the top."""
    x, y = a["bbox"], b["bbox"]
    goes_on = b["text"].rlike(SMALL_START) | F.rtrim(a["text"]).rlike(ARTICLE_END)
    beside = (F.abs(x["y0"] - y["y0"]) <= 20) & (x["y1"] > y["y1"] + 10) & G.shares_line(x, y)
    return (x["x0"] < width / 2) & (y["x0"] >= width / 2) & compatible_style(a, b) & ~a["text"].rlike(STRONG_END) & goes_on & ~heading_like(b) & (beside | (y["y0"] < x["y0"] - 20))


def merge_kind(a: Column, b: Column, width: float = 612.0) -> Column:
    """How the second of two fragments of a page continues the first: line_break, hyphenation or (null) not at all."""
    x, y = a["bbox"], b["bbox"]
    near = same_column(x, y) & G.adjacent(x, y)
    boxes = boxed_title(a["text"], a["bold"]) & boxed_title(b["text"], b["bold"]) & near
    count = lambda c: F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    split_title = a["bold"] & (a["font"] >= 10 * 1.05) & title_case(T.strip(a["text"])) & ~T.strip(b["text"]).rlike(r"^\p{Lu}") & (T.strip(b["text"]) != "") & (count(a["text"]) <= 5) & (count(b["text"]) <= 4) & near
    return (
        F.when(boxes | split_title | wraps_around(a, b, width), "line_break").when(heading_like(b) | ~b["text"].rlike(SMALL_START), None)
        .when(F.rtrim(a["text"]).rlike(HYPHEN_END), F.when(G.shares_line(x, y) | G.adjacent(x, y), "hyphenation"))
        .when(near & ~a["text"].rlike(STRONG_END) & ~F.ltrim(b["text"]).rlike(NEW_UNIT), "line_break")
    )


def joined(parts: list[tuple[str | None, str]]) -> str:
    """Parts, each with the kind of its merge, as one text: hyphens go with a hyphenation, else one space stands between."""
    out = [parts[0][1]]
    for kind, part in parts[1:]:
        left = out[-1].rstrip()
        out[-1] = left.rstrip(HYPHENS + " ") if kind == "hyphenation" else f"{left} "
        out.append(part.lstrip())
    return "".join(out)


def merge_runs(fragments: DataFrame, keys: list[str], order: str, joins: str, text: str = "text") -> DataFrame:
    """(keys, block_index, text, bbox, font, max_font, bold, italic, lines): fragments with a kind of merge in `joins` (see `merge_kind`)
    are merged into what is before them.

    The box is around all, lines add up, the largest size and either style stay; mean sizes are averaged pair by
    pair, in order. Rows of a page come together and in order, and are read once; only the open block is kept.
    """
    parts = int(fragments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = fragments.select(*keys, order, joins, F.col(text).alias("text"), "bbox.x0", "bbox.y0", "bbox.x1", "bbox.y1", "font", "max_font", "bold", "italic", "lines")
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "block_index long, text string, x0 double, y0 double, x1 double, y1 double, font double, max_font double, bold boolean, italic boolean, lines long"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        page, index, open_ = None, 0, None
        names = [*keys, "block_index", "text", "x0", "y0", "x1", "y1", "font", "max_font", "bold", "italic", "lines"]
        for frame in frames:
            done = []
            for r in frame.to_dict("records"):
                key = tuple(r[k] for k in keys)
                if open_ is not None and key == page and isinstance(r[joins], str):
                    open_["parts"].append((r[joins], r["text"]))
                    for c, f in (("x0", min), ("y0", min), ("x1", max), ("y1", max), ("max_font", max)):
                        open_[c] = f(open_[c], r[c])
                    open_["font"] = (open_["font"] + r["font"]) / 2
                    open_["bold"], open_["italic"], open_["lines"] = open_["bold"] or r["bold"], open_["italic"] or r["italic"], open_["lines"] + r["lines"]
                    continue
                if open_ is not None:
                    done.append(open_)
                index = index + 1 if key == page else 0
                page, open_ = key, {**r, "block_index": index, "parts": [(None, r["text"])]}
            yield _frame(done, names)
        yield _frame([open_] if open_ is not None else [], names)

    out = rows.repartition(parts, *keys).sortWithinPartitions(*keys, order).mapInPandas(run, schema)
    return out.select(*keys, "block_index", "text", G.box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("bbox"), "font", "max_font", "bold", "italic", "lines")


def _frame(blocks: list[dict], names: list[str]) -> pd.DataFrame:
    for b in blocks:
        b["text"] = joined(b["parts"])
    return pd.DataFrame(blocks, columns=[*names, "parts"])[names]
