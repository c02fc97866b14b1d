"""Blocks of pages: the view over text tables, filters, reading order, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import text as T

PAGE_WIDTH, PAGE_HEIGHT = 612.0, 792.0
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
DRM = rf"(?:{EMAIL}.*[0-9]{{6}}/[0-9]+/[0-9]+)|(?:[0-9]{{6}}/[0-9]+/[0-9]+.*{EMAIL})|^[^@\n]{{1,80}} - {EMAIL}"
#: What a line of stats has, and what is left of a diagram; fixed values.
STATS_HINT = r"(?i)\b(AGI|FOR|CON|INT|PER|CHA|VOL)\s*[+-]|\|\s*NC\s*\d"
DIAGRAM = r"[\x0C\x0F\x9A]|Princesse d."
PAGE_KEY = ("document", "page")


def lines_as_blocks(docs: DataFrame, document: str = "source", page: str = "doc_id", text: str = "text") -> DataFrame:
    """One block for each non-blank line: two columns of boxes by the line's place. Null texts have no blocks."""
    lines = F.filter(F.split(F.col(text), "\n"), lambda x: x.rlike(r"\S"))
    rows = docs.select(F.col(document).alias("document"), F.col(page).alias("page"), F.posexplode(lines).alias("block_index", "text"))
    i = F.col("block_index")
    x0, y0 = 50.0 + 260.0 * (i % 2), 40.0 + 14.0 * F.floor(i / 2)
    heading = F.length("text") < 40
    return rows.withColumns({"bbox": G.box(x0, y0, x0 + 200.0, y0 + 12.0), "font": F.when(heading, 14.0).otherwise(10.0), "is_bold": heading})


def matches_drm(c: Column, extra: tuple[str, ...] = ()) -> Column:
    out = c.rlike(DRM)
    for p in extra:
        out = out | c.rlike(p)
    return out


def garbled(c: Column) -> Column:
    """Which rule drops a text: a diagram's marks, no text, short with few letters, or long with a small share of letters. Lines of stats stay."""
    cleaned = F.trim(F.regexp_replace(F.regexp_replace(c, r"[\x{E000}-\x{F8FF}]|[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]", ""), r"\s+", " "))
    letters = F.length(F.regexp_replace(cleaned, r"\P{L}", ""))
    n = F.length(cleaned)
    return F.when(c.rlike(STATS_HINT), None).when(c.rlike(DIAGRAM), "diagram").when(n == 0, "empty").when((n < 12) & (letters < 4), "short").when((n >= 12) & (letters < n * 0.35), "sparse")


def noise(b: str = "bbox", c: str = "text", edge: float = 0.85) -> Column:
    """Page labels and vertical running headers."""
    words = F.size(F.filter(F.split(F.col(c), r"\s+"), lambda w: w != ""))
    vertical = (F.col(f"{b}.x1") - F.col(f"{b}.x0") <= 20) & (F.col(f"{b}.x0") >= PAGE_WIDTH * edge) & (F.length(c) <= 80) & (words <= 12)
    return F.col(c).rlike(r"^PAGE\s+\d+$") | vertical


def repeated_texts(blocks: DataFrame, least_pages: int = 3, ratio: float = 0.5, longest: int = 200) -> DataFrame:
    """(document, norm, pages): texts on so many pages of a document. Pages are counted after a pre-aggregation."""
    pages = blocks.groupBy("document").agg(F.count_distinct("page").alias("all_pages"))
    norm = blocks.where(F.length("text") <= longest).select("document", "page", T.squeeze(F.col("text")).alias("norm"))
    counted = norm.distinct().groupBy("document", "norm").agg(F.count(F.lit(1)).alias("pages"))
    return counted.join(pages, "document").where(F.col("pages") >= F.greatest(F.lit(least_pages), F.floor(F.col("all_pages") * ratio))).select("document", "norm", "pages")


def filter_blocks(blocks: DataFrame, extra: tuple[str, ...] = (), least_pages: int = 3, ratio: float = 0.5) -> DataFrame:
    """Blocks without garbled, noise and watermark ones, numbered anew on each page."""
    often = repeated_texts(blocks, least_pages, ratio).withColumnRenamed("document", "_document")
    kept = blocks.where(garbled(F.col("text")).isNull() & ~noise() & ~matches_drm(F.col("text"), extra)).withColumn("_norm", T.squeeze(F.col("text")))
    marked = kept.join(often, (kept["document"] == often["_document"]) & (kept["_norm"] == often["norm"]), "left")
    watermark = F.col("norm").isNotNull() & (F.length("text") <= 200) & (F.col("text").rlike(EMAIL) | G.in_margin_band(F.col("bbox"), F.lit(PAGE_HEIGHT)))
    return reindex(marked.where(~watermark).select(*blocks.columns))


def reindex(blocks: DataFrame, *order: str) -> DataFrame:
    """block_index from 0 on each page, in the given order (its own by default)."""
    w = Window.partitionBy(*PAGE_KEY).orderBy(*(order or ("block_index",)))
    return blocks.withColumn("block_index", F.row_number().over(w) - 1)


def page_medians(blocks: DataFrame, default: float = 12.0) -> DataFrame:
    """(document, page, median_font): zero and null sizes do not count; `default` where none is left."""
    return blocks.groupBy(*PAGE_KEY).agg(F.coalesce(F.median(F.nullif("font", F.lit(0.0))), F.lit(default)).alias("median_font"))


def title_case(c: Column) -> Column:
    return c.rlike(r"^\p{Lu}[\p{L}\p{N}_'’-]*\.?$") | c.rlike(r"^\p{Lu}[\p{L}\p{N}_'’-]*(?: (?:[\p{Ll}][\p{L}\p{N}_'’-]*|\p{Lu}{2,})){1,5}\.?$")


def heading_kind(c: Column, font: Column, median: Column, bold: Column) -> Column:
    """The first accepting rule for a heading; null if none does."""
    words = F.size(F.split(c, " "))
    return (
        F.when((F.length(c) > 120) | (words > 14), None).when(c.rlike(r"^(?:CHAPITRE|ACTE|PARTIE|CHAPTER) "), "chapter").when(c.rlike(r"^[A-Z]-\d+$"), None)
        .when(c.isin("CRÉDITS", "EN QUELQUES MOTS", "FICHE TECHNIQUE"), "meta").when(bold & (font >= median * 1.05) & title_case(c), "title_case")
        .when(c.rlike(r"^\d+(?:\.\d+)*[.)]? ") & (bold | (font >= median * 1.05)), "numbered").when(c.rlike(r"^[A-Z][A-Z '’-]{3,}$") & (font >= median), "capitals")
        .when(bold & (font >= median * 1.15) & F.length(c).between(3, 80), "bold")
    )


def heading_level(kind: Column, font: Column, median: Column, c: Column) -> Column:
    dots = F.length(F.regexp_replace(F.regexp_extract(c, r"^(\d+(?:\.\d+)*)", 1), "[^.]", ""))
    return F.when(kind.isin("chapter", "meta"), 1).when(kind == "numbered", F.least(F.lit(4), dots + 2)).when(font >= median * 1.3, 1).when(font >= median * 1.15, 2).otherwise(3)


def spatial_rank(blocks: DataFrame, column_major: bool = False) -> DataFrame:
    """`rank` of each block on its page in reading order, from 0."""
    b = F.col("bbox")
    keys = (G.side(b, F.lit(PAGE_WIDTH)), b["y0"], b["x0"]) if column_major else (G.y_bucket(b["y0"]), b["x0"])
    return blocks.withColumn("rank", F.row_number().over(Window.partitionBy(*PAGE_KEY).orderBy(*keys, "block_index")) - 1)


def merge_drop_caps(blocks: DataFrame) -> DataFrame:
    """A single capital joins the block after it that begins in lower case."""
    w = Window.partitionBy(*PAGE_KEY).orderBy("block_index")
    cap = F.col("text").rlike(r"^\p{Lu}$") & (F.col("font") >= 12)
    pairs = cap & F.lead("text").over(w).rlike(r"^\p{Ll}") & (F.lead("bbox.x0").over(w) >= F.col("bbox.x0") - 5)
    rows = blocks.withColumn("_pair", F.coalesce(pairs, F.lit(False)))
    before = F.lag("_pair").over(w)
    merged = rows.withColumn("text", F.when(before, F.concat(F.lag("text").over(w), "text")).otherwise(F.col("text")))
    return reindex(merged.where(~F.col("_pair")).drop("_pair"))


#: Parts of the match of blocks, for each of `spark.sql.shuffle.partitions`.
FINER = 8


def best_matches(sources: DataFrame, candidates: DataFrame, least: float = 0.05, cell: tuple[float, float] = (250.0, 50.0)) -> DataFrame:
    """(document, page, source_block, match, iou) of every source block (document, page, block_index, bbox) whose page has candidates.

    The candidate of greatest overlap (IoU, the smaller index among equals) if that is at least `least`,
    else the one with the nearest centre, whose iou is its own. Overlaps meet in cells of a grid; only
    blocks without a match meet all of their page. Rows are dealt into `FINER` times the usual parts, as a
    task sorts both sides and groups what meets.
    """
    page = ["document", "page"]
    parts = FINER * int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a = sources.select(*page, F.col("block_index").alias("source_block"), F.col("bbox").alias("_a"))
    b = candidates.select(*page, F.col("block_index").alias("match"), F.col("bbox").alias("_b"))

    def celled(df: DataFrame, box: str) -> DataFrame:
        for axis, size in zip("xy", cell):
            df = df.withColumn(f"_{axis}", F.explode(F.sequence(F.floor(F.col(f"{box}.{axis}0") / size), F.floor(F.col(f"{box}.{axis}1") / size))))
        return df

    def best(pairs: DataFrame, *order) -> DataFrame:
        m = pairs.groupBy(*page, "source_block").agg(F.max_by(F.struct("match", "iou"), F.struct(*order, -F.col("match"))).alias("m"))
        return m.select(*page, "source_block", "m.match", "m.iou")

    iou = G.iou(F.col("_a"), F.col("_b"))
    cells = [*page, "_x", "_y"]
    overlaps = celled(a, "_a").repartition(parts, *cells).join(celled(b, "_b").repartition(parts, *cells), cells).withColumn("iou", iou).where(F.col("iou") >= least)
    met = best(overlaps.select(*page, "source_block", "match", "iou").repartition(parts, *page, "source_block"), F.round("iou", 9))
    centre = lambda c, axis: (F.col(f"{c}.{axis}0") + F.col(f"{c}.{axis}1")) / 2
    far = F.hypot(centre("_a", "x") - centre("_b", "x"), centre("_a", "y") - centre("_b", "y"))
    alone = a.repartition(parts, *page, "source_block").join(met, [*page, "source_block"], "left_anti")
    rest = alone.repartition(parts, *page).join(b.repartition(parts, *page), page).withColumn("iou", iou)
    return met.unionByName(best(rest, -F.round(far, 6)))
