"""Section trees from headings: levels, parents, page ranges."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SECTIONS = "document string, section int, parent int, title string, level int, page_start int, page_end int, anchor_block int"
CAPS_GAP, PAGE_REACH = 80.0, 3


def _tree(rows: list[dict], last_page: int) -> list[tuple]:
    """Sections of one document's headings in reading order (tier, level, page, y0, y1, title, block)."""
    out: list[list] = []
    open_: list[int] = []  # indices of the sections that later ones may hang below
    chapter: int | None = None
    for i, h in enumerate(rows):
        parent: int | None = None
        above = [j for j in range(i) if rows[j]["page"] == h["page"] and rows[j]["caps"] and 0 <= h["y0"] - rows[j]["y1"] <= CAPS_GAP]
        caps_parent = max(above, key=lambda j: rows[j]["y1"], default=None)
        level = h["level"]
        if h["tier"] == "meta":
            level = 1
        elif h["tier"] in ("chapter", "banner"):
            open_, chapter, level = [i], i, 1
        elif h["tier"] == "subordinate":
            if caps_parent is not None:
                parent = caps_parent
            elif chapter is not None and h["page"] - rows[chapter]["page"] <= PAGE_REACH:
                parent = chapter
            else:
                level = max(1, level - 1)
            open_.append(i)
        else:
            while open_ and out[open_[-1]][4] >= level:
                open_.pop()
            parent = caps_parent if caps_parent is not None and not h["caps"] else (open_[-1] if open_ else None)
            open_.append(i)
        end = rows[i + 1]["page"] if i + 1 < len(rows) else last_page
        out.append([h["document"], i, parent, h["title"], level, h["page"], max(end, h["page"]), h["block"]])
        if h["tier"] == "chapter":  # earlier subordinates of the page belong to the chapter that heads it
            for j in range(i):
                if rows[j]["page"] == h["page"] and rows[j]["tier"] == "subordinate" and out[j][2] is None:
                    out[j][2] = i
    return [tuple(x) for x in out]


def detect_sections(headings: DataFrame, last_pages: DataFrame) -> DataFrame:
    """Sections of every document; a document's headings are one group (a document is one file, so bounded).

    `headings`: document, page, block, y0, y1, title, tier, level, caps. `last_pages`: document, last_page.
    A document without headings has one section `Document` over all its pages.
    """
    def run(keys: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        f = frame.sort_values(["page", "y0", "block"])
        rows = f[f["title"].notna()].to_dict("records")
        last = int(f["last_page"].max())
        found = _tree(rows, last) if rows else [(keys[0], 0, None, "Document", 1, 1, last, None)]
        return pd.DataFrame(found, columns=[x.split()[0] for x in SECTIONS.split(", ")]).astype({"parent": "Int32", "anchor_block": "Int32"})

    joined = last_pages.join(headings, "document", "left")
    return joined.groupBy("document").applyInPandas(run, SECTIONS)


def refine_page_ends(sections: DataFrame, chunks: DataFrame, keys: list[str]) -> DataFrame:
    """page_end from the section's chunks where it has some."""
    ends = chunks.groupBy(*keys).agg(F.max("page_end").alias("_end"))
    return sections.join(ends, keys, "left").withColumn("page_end", F.coalesce("_end", "page_end")).drop("_end")
