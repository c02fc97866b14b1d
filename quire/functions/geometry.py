"""Geometry of boxes (structs with x0, y0, x1, y1) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def union_agg(b: str) -> Column:
    """The aggregate box around all boxes of a group; null for none."""
    return F.when(F.count(b) > 0, box(F.min(f"{b}.x0"), F.min(f"{b}.y0"), F.max(f"{b}.x1"), F.max(f"{b}.y1")))


def overlap_ratio(a: Column, b: Column) -> Column:
    """Shared width over the narrower width; 0 without overlap or width."""
    shared = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    narrow = F.least(a["x1"] - a["x0"], b["x1"] - b["x0"])
    return F.when((shared > 0) & (narrow > 0), shared / narrow).otherwise(F.lit(0.0))


def in_column(a: Column, b: Column, least: float = 0.35) -> Column:
    return overlap_ratio(a, b) >= least


def y_bucket(y0: Column, half_up: bool = False) -> Column:
    return F.floor(y0 / 5 + 0.5) * 5 if half_up else F.bround(y0 / 5) * 5


def side(b: Column, width: Column) -> Column:
    return F.when((b["x0"] + b["x1"]) / 2 < width / 2, "left").otherwise("right")


def in_zone(heading: Column, b: Column, narrow: Column) -> Column:
    """Whether a block is in a heading's content zone; narrow boxes reach 35 sideways and 130 down."""
    gap = b["y0"] - heading["y1"]
    wide = (b["y1"] > heading["y0"]) & in_column(heading, b)
    boxed = (b["x0"] >= heading["x0"] - 35) & (b["x1"] <= heading["x1"] + 35) & gap.between(0, 130)
    return F.when(narrow, boxed).otherwise(wide)


def adjacent(a: Column, b: Column) -> Column:
    return (b["y0"] - a["y1"]).between(-5, 15)


def shares_line(a: Column, b: Column) -> Column:
    return F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]) > 0


def coverage(text: Column, width: Column, height: Column) -> Column:
    """Share of a page that its text covers (50 square units a character), at most 1."""
    n = F.length(F.regexp_replace(text, r"^\s+|\s+$", ""))
    return F.when((n > 0) & (width > 0) & (height > 0), F.least(F.lit(1.0), n * 50.0 / (width * height))).otherwise(F.lit(0.0))


def area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["x1"] - b["x0"]) * F.greatest(F.lit(0.0), b["y1"] - b["y0"])


def iou(a: Column, b: Column) -> Column:
    w = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    h = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(F.lit(0.0))


def centre_distance(a: Column, b: Column) -> Column:
    return F.hypot((a["x0"] + a["x1"] - b["x0"] - b["x1"]) / 2, (a["y0"] + a["y1"] - b["y0"] - b["y1"]) / 2)


def scaled(b: Column, sx: Column, sy: Column) -> Column:
    return box(b["x0"] * sx, b["y0"] * sy, b["x1"] * sx, b["y1"] * sy)


def in_margin_band(b: Column, height: Column, share: float = 0.08) -> Column:
    return (b["y1"] < height * share) | (b["y0"] > height * (1 - share))
