"""Queries of layout operators over boxes of uneven size and place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.operators import audit, blocks, chunks, merging, rules, sequences
from quire.plans.catalogue import BLOCKS, _blocks, query
from quire.sources.tables import table

#: Places and sizes of boxes by expressions that Spark and DuckDB read alike: columns that overlap in part, ties, lines that touch.
PLACES = {
    "x0": "CAST(40 + (block_index * 37 + page) % 7 * 45 AS DOUBLE)", "y0": "CAST(30 + block_index * 11 - page % 3 * 4 AS DOUBLE)",
    "w": "CAST(15 + (block_index * 13 + page) % 5 * 50 AS DOUBLE)", "h": "CAST(8 + (block_index + page) % 3 * 9 AS DOUBLE)",
    "font": "CAST(9 + (block_index + page) % 4 * 2 AS DOUBLE)", "bold": "(block_index + page) % 3 = 0", "italic": "block_index % 4 = 1",
}
ODD = f"{BLOCKS}, o AS (SELECT document, page, block_index, text, {', '.join(f'{v} AS {k}' for k, v in PLACES.items())} FROM blocks), odd AS (SELECT *, x0 + w AS x1, y0 + h AS y1 FROM o)"


def _odd(spark, d) -> DataFrame:
    b = _blocks(spark, d).select("document", "page", "block_index", "text")
    b = b.withColumns({k: F.expr(v) for k, v in PLACES.items()})
    return b.withColumn("bbox", G.box(F.col("x0"), F.col("y0"), F.col("x0") + F.col("w"), F.col("y0") + F.col("h"))).drop("x0", "y0", "w", "h")


def _pairs(df: DataFrame, *cols: str) -> DataFrame:
    """Each block with the one after it on its page (`next`)."""
    w = Window.partitionBy("document", "page").orderBy("block_index")
    return df.withColumn("next", F.lead(F.struct(*cols)).over(w)).where("next IS NOT NULL")


NEXT = "nx AS (SELECT *, " + ", ".join(f"lead({c}) OVER w AS n{c}" for c in ("text", "x0", "y0", "x1", "y1", "font", "bold", "italic")) + " FROM odd WINDOW w AS (PARTITION BY document, page ORDER BY block_index))"


@query(f"WITH {ODD} SELECT document, page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM odd GROUP BY ALL")
def page_boxes(spark, d):
    return _odd(spark, d).groupBy("document", "page").agg(G.union_agg("bbox").alias("b")).select("document", "page", "b.*")


@query(f"""WITH {ODD}, {NEXT}, s AS (SELECT *, least(x1, nx1) - greatest(x0, nx0) AS shared, least(x1 - x0, nx1 - nx0) AS narrow FROM nx WHERE ntext IS NOT NULL)
 SELECT document, page, block_index, round(CASE WHEN shared > 0 THEN shared / narrow ELSE 0 END, 6) AS overlap, CASE WHEN shared > 0 THEN shared / narrow >= 0.35 ELSE FALSE END AS in_column, ny0 - y1 BETWEEN -5 AND 15 AS adjacent, least(y1, ny1) - greatest(y0, ny0) > 0 AS line, round(sqrt(pow((x0 + x1 - nx0 - nx1) / 2, 2) + pow((y0 + y1 - ny0 - ny1) / 2, 2)), 6) AS far FROM s""")
def neighbour_geometry(spark, d):
    p = _pairs(_odd(spark, d), "bbox")
    a, b = F.col("bbox"), F.col("next.bbox")
    return p.select("document", "page", "block_index", F.round(G.overlap_ratio(a, b), 6).alias("overlap"), G.in_column(a, b).alias("in_column"), G.adjacent(a, b).alias("adjacent"), G.shares_line(a, b).alias("line"), F.round(G.centre_distance(a, b), 6).alias("far"))


@query(f"""WITH {ODD} SELECT document, page, block_index, x0 * 1.5 AS x0, y0 * 2 AS y0, x1 * 1.5 AS x1, y1 * 2 AS y1, y1 < 792 * 0.08 OR y0 > 792 * 0.92 AS margin, floor(y0 / 5 + 0.5)::BIGINT * 5 AS bucket,
 regexp_matches(t, '^PAGE\\s+\\d+$') OR (x1 - x0 <= 20 AND x0 >= 612 * 0.5 AND length(t) <= 80 AND len(list_filter(regexp_split_to_array(t, '\\s+'), lambda w: w <> '')) <= 12) AS noise FROM (SELECT *, CASE WHEN block_index % 6 = 0 THEN concat('PAGE ', page) ELSE text END AS t FROM odd)""")
def margin_bands(spark, d):
    b = _odd(spark, d).withColumn("text", F.expr("CASE WHEN block_index % 6 = 0 THEN concat('PAGE ', page) ELSE text END"))
    x = F.col("bbox")
    return b.select("document", "page", "block_index", G.scaled(x, F.lit(1.5), F.lit(2.0)).alias("s"), G.in_margin_band(x, F.lit(792.0)).alias("margin"), G.y_bucket(x["y0"], half_up=True).cast("long").alias("bucket"), blocks.noise(edge=0.5).alias("noise")).select("document", "page", "block_index", "s.*", "margin", "bucket", "noise")


@query(f"WITH {ODD} SELECT document, page, block_index, row_number() OVER (PARTITION BY document, page ORDER BY round_even(y0 / 5, 0) * 5, x0, block_index) - 1 AS rank, row_number() OVER (PARTITION BY document, page ORDER BY CASE WHEN (x0 + x1) / 2 < 306 THEN 'left' ELSE 'right' END, y0, x0, block_index) - 1 AS by_column FROM odd")
def reading_orders(spark, d):
    b = _odd(spark, d)
    a = blocks.spatial_rank(b).select("document", "page", "block_index", F.col("rank").cast("long"))
    c = blocks.spatial_rank(b, column_major=True).select("document", "page", "block_index", F.col("rank").cast("long").alias("by_column"))
    return a.join(c, ["document", "page", "block_index"])


@query(f"""WITH {ODD}, k AS (SELECT document, page, block_index, page AS p, round_even(y0 / 5, 0) * 5 AS b, x0, lag(page) OVER w AS lp, lag(round_even(y0 / 5, 0) * 5) OVER w AS lb, lag(x0) OVER w AS lx FROM odd WINDOW w AS (PARTITION BY document ORDER BY page, block_index))
 SELECT document, bool_and(lp IS NULL OR p > lp OR (p = lp AND b > lb) OR (p = lp AND b = lb AND x0 > lx)) AS ordered FROM k GROUP BY 1""")
def order_check(spark, d):
    return rules.in_order(_odd(spark, d))


@query(f"""WITH {ODD}, j AS (SELECT h.document, h.page, h.block_index AS heading, b.block_index, b.y0 - h.y1 AS gap, least(h.x1, b.x1) - greatest(h.x0, b.x0) AS shared, least(h.x1 - h.x0, b.x1 - b.x0) AS narrow, h.block_index % 2 = 0 AS boxed, b.y1 > h.y0 AS below, b.x0 >= h.x0 - 35 AND b.x1 <= h.x1 + 35 AS inside FROM odd h JOIN odd b USING (document, page) WHERE h.bold AND NOT b.bold AND h.block_index < b.block_index)
 SELECT document, page, heading, count(*) AS members, min(block_index) AS first FROM j WHERE CASE WHEN boxed THEN inside AND gap BETWEEN 0 AND 130 ELSE below AND CASE WHEN shared > 0 THEN shared / narrow >= 0.35 ELSE FALSE END END GROUP BY ALL""")
def heading_zones(spark, d):
    """Blocks after each bold one in its content zone, those of even number narrow boxes."""
    b = _odd(spark, d)
    h = b.where("bold").select("document", "page", F.col("block_index").alias("heading"), F.col("bbox").alias("hbox"))
    j = b.where("NOT bold").join(h, ["document", "page"]).where((F.col("heading") < F.col("block_index")) & G.in_zone(F.col("hbox"), F.col("bbox"), F.col("heading") % 2 == 0))
    return j.groupBy("document", "page", "heading").agg(F.count(F.lit(1)).alias("members"), F.min("block_index").alias("first"))


HEADINGISH = "((length(trim({t})) > 0 AND {b} AND length(trim({t})) < 80 AND {f} >= 12) OR (length(trim({t})) BETWEEN 1 AND 49 AND upper(trim({t})) = trim({t}) AND regexp_matches(trim({t}), '\\p{{Lu}}')))"
_H = HEADINGISH.format(t="ntext", b="nbold", f="nfont")
_NEAR = "(ny0 - y1 BETWEEN -5 AND 15 AND least(x1, nx1) - greatest(x0, nx0) > 0 AND (least(x1, nx1) - greatest(x0, nx0)) / least(x1 - x0, nx1 - nx0) >= 0.25)"
_WORDS = "len(list_filter(regexp_split_to_array({t}, '\\s+'), lambda w: w <> ''))"
KINDS = rf"""kinds AS (SELECT *, CASE
 WHEN bold AND nbold AND {_NEAR} AND {' AND '.join(rf"regexp_matches(string_split({t}, chr(10))[1], '\p{{Lu}}') AND NOT regexp_matches(string_split({t}, chr(10))[1], '\p{{Ll}}') AND length(string_split({t}, chr(10))[1]) >= 4 AND {_WORDS.format(t=t)} <= 12" for t in ('text', 'ntext'))} THEN 'line_break'
 WHEN bold AND font >= 10.5 AND (regexp_matches(trim(text), '^\p{{Lu}}[\p{{L}}\p{{N}}_''’-]*\.?$') OR regexp_matches(trim(text), '^\p{{Lu}}[\p{{L}}\p{{N}}_''’-]*(?: (?:[\p{{Ll}}][\p{{L}}\p{{N}}_''’-]*|\p{{Lu}}{{2,}})){{1,5}}\.?$')) AND NOT regexp_matches(trim(ntext), '^\p{{Lu}}') AND {_WORDS.format(t='text')} <= 5 AND {_WORDS.format(t='ntext')} <= 4 AND {_NEAR} THEN 'line_break'
 WHEN x0 < 306 AND nx0 >= 306 AND (italic = nitalic OR (NOT {_H} AND abs(font - nfont) <= 1.5)) AND NOT regexp_matches(text, '[.!?»][''")\]]*\s*$') AND (regexp_matches(ntext, '^\s*\p{{Ll}}') OR regexp_matches(text, '(?i)\b(?:Les|La|Le|Des|Un|Une|Du|De|l''|d''|n''|s''|m''|t''|c''|j'')\s*$')) AND NOT {_H} AND ((abs(y0 - ny0) <= 20 AND y1 > ny1 + 10 AND least(y1, ny1) - greatest(y0, ny0) > 0) OR ny0 < y0 - 20) THEN 'line_break'
 WHEN {_H} OR NOT regexp_matches(ntext, '^\s*\p{{Ll}}') THEN NULL
 WHEN regexp_matches(text, '[-‐‑–—]\s*$') THEN CASE WHEN least(y1, ny1) - greatest(y0, ny0) > 0 OR ny0 - y1 BETWEEN -5 AND 15 THEN 'hyphenation' END
 WHEN {_NEAR} AND NOT regexp_matches(text, '[.!?»][''")\]]*\s*$') AND NOT regexp_matches(ltrim(ntext), '^(?:[\s«•–—*-]+|[A-Z][A-Z\s]{{3,}})') THEN 'line_break' END AS kind FROM nx WHERE ntext IS NOT NULL)"""
#: Lines cut in two at a space, or within a word with a hyphen, so that there is something to merge; every third piece is in lower case.
CUT = "CASE WHEN doc_id % 2 = 0 THEN replace(text, ' the ', concat(chr(10), 'the ')) ELSE replace(text, 'tion', concat('-', chr(10), 'tion')) END"
CUT_BLOCKS = ODD.replace("list_filter(string_split(text, chr(10))", "list_filter(string_split(text, chr(10))", 1)


def _fragments(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("text", F.expr(CUT.replace("chr(10)", "'\n'")))
    b = blocks.lines_as_blocks(docs).select("document", "page", F.col("block_index").cast("long"), "text").withColumns({k: F.expr(v) for k, v in PLACES.items()})
    b = b.withColumn("bbox", G.box(F.col("x0"), F.col("y0"), F.col("x0") + F.col("w"), F.col("y0") + F.col("h"))).drop("x0", "y0", "w", "h")
    return b.withColumns({"max_font": F.col("font"), "role": F.lit(None).cast("string"), "lines": F.lit(1).cast("long")})


FIELDS = ("text", "bbox", "font", "max_font", "bold", "italic", "lines", "role")


def _kinds(spark, d) -> DataFrame:
    f = _fragments(spark, d)
    w = Window.partitionBy("document", "page").orderBy("block_index")
    one = F.struct(*FIELDS)
    return f.withColumn("kind", F.when(F.lag("text").over(w).isNotNull(), merging.merge_kind(F.lag(one).over(w), one)))


FRAGMENTS = ODD.replace("FROM documents", f"FROM (SELECT source, doc_id, {CUT} AS text FROM documents)", 1)


@query(f"WITH {FRAGMENTS}, {NEXT}, {KINDS} SELECT document, page, block_index + 1 AS block_index, kind FROM kinds WHERE kind IS NOT NULL")
def pair_merge(spark, d):
    """How each fragment continues the one before it, where it does."""
    return _kinds(spark, d).where("kind IS NOT NULL").select("document", "page", "block_index", "kind")


@query(f"""WITH RECURSIVE {FRAGMENTS}, {NEXT}, {KINDS}, r AS (SELECT o.*, k.kind, row_number() OVER (PARTITION BY o.document, o.page ORDER BY o.block_index) AS rn FROM odd o LEFT JOIN kinds k ON k.document = o.document AND k.page = o.page AND k.block_index + 1 = o.block_index),
 g AS (SELECT *, sum(CASE WHEN kind IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY document, page ORDER BY block_index) - 1 AS grp FROM r)
 SELECT document, page, grp::BIGINT AS block_index, count(*) AS lines, min(x0) AS x0, max(y1) AS y1, max(font) AS max_font, bool_or(bold) AS bold, bool_or(italic) AS italic, regexp_replace(string_agg(CASE WHEN kind IS NULL THEN text ELSE concat(CASE WHEN kind = 'hyphenation' THEN chr(7) ELSE ' ' END, ltrim(text)) END, '' ORDER BY block_index), concat('[ ‐‑–—-]*', chr(7)), '', 'g') AS text FROM g GROUP BY document, page, grp""")
def fold_merge(spark, d):
    """The fragments of every page merged."""
    out = merging.merge_runs(_kinds(spark, d), ["document", "page"], "block_index", "kind")
    return out.select("document", "page", "block_index", "lines", "bbox.x0", "bbox.y1", "max_font", "bold", "italic", "text")


# rules over texts built from parts
TEXTS = "CASE p_partkey % 12 WHEN 0 THEN ' CRÉDITS ' WHEN 1 THEN 'INTRODUCTION du jeu' WHEN 2 THEN concat('Chapitre ', p_size, ' ', p_brand) WHEN 3 THEN concat('Si ', p_brand) WHEN 4 THEN concat('• ', p_brand) WHEN 5 THEN concat('Récompense ', p_size) WHEN 6 THEN concat('Tous droits réservés ', p_name) WHEN 7 THEN upper(p_type) WHEN 8 THEN 'CONCLUSION' WHEN 9 THEN concat(p_brand, ' : ', p_size) WHEN 10 THEN 'EN QUELQUES MOTS' ELSE p_name END"
FONT, BOLD, TOP = "CAST(8 + p_size % 25 AS DOUBLE)", "p_partkey % 5 < 3", "CAST(p_size * 17 % 700 AS DOUBLE)"


def _rule_rows(spark, d) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", F.expr(TEXTS).alias("c"), F.expr(FONT).alias("font"), F.expr(BOLD).alias("bold"), F.expr(TOP).alias("y0"))
    return p.withColumn("b", G.box(F.lit(50.0), F.col("y0"), F.lit(300.0), F.col("y0") + 12.0))


_CAPS = r"(regexp_matches(c, '\p{Lu}') AND NOT regexp_matches(c, '\p{Ll}'))"
_N = "len(list_filter(regexp_split_to_array(c, '\\s+'), lambda w: w <> ''))"
RULES = f"r AS (SELECT p_partkey, {TEXTS} AS c, {FONT} AS font, {BOLD} AS bold, {TOP} AS y0 FROM part)"


@query(rf"""WITH {RULES}, s AS (SELECT *, trim(c) IN ('CRÉDITS', 'EN QUELQUES MOTS', 'FICHE TECHNIQUE') AS meta, (upper(c) LIKE 'INTRODUCTION%' OR upper(c) LIKE 'IMPLICATION%' OR upper(c) LIKE 'CONCLUSION%') AND y0 < 264 AND length(regexp_replace(c, '\P{{Lu}}', '', 'g')) >= length(regexp_replace(c, '\P{{L}}', '', 'g')) * 0.8 AS banner, regexp_matches(c, '(?i)^(?:chapitre|acte|partie|chapter)\s+(?:\d+|[IVXLC]+)\b') AS chapter, regexp_matches(c, '^Si\s+') AND {_N} <= 10 AND bold AND font >= 10.5 AND font < 15 AS hook FROM r)
 SELECT p_partkey, meta, banner, chapter, hook, {_CAPS} AND (font >= 28 OR font >= 20) AND y0 <= 792 * 0.33 AND {_N} <= 4 AS spread, upper(trim(c)) LIKE 'RÉCOMPENSE%' OR upper(trim(c)) LIKE 'RECOMPENSE%' AS reward, trim(c) = 'CRÉDITS' AS credits, contains(lower(c), 'black book') OR contains(lower(c), 'tous droits réservés') OR contains(lower(c), 'tous droits reserves') AS editorial,
 regexp_matches(c, '^\s*[•◦▪‣*–-]\s+') OR (regexp_matches(c, '^[^:\n]{{1,78}} :') AND length(c) <= 80 AND NOT (bold AND {_N} <= 6)) AS item, bold AND {_CAPS} AND length(c) >= 4 AND {_N} <= 12 AS boxed,
 CASE WHEN meta THEN 'meta' WHEN banner THEN 'banner' WHEN chapter THEN 'chapter' WHEN hook OR (bold AND NOT {_CAPS} AND font < 15) THEN 'subordinate' ELSE 'other' END AS tier FROM s""")
def heading_rules(spark, d):
    c, b, font, med, bold, h = F.col("c"), F.col("b"), F.col("font"), F.lit(10.0), F.col("bold"), F.lit(792.0)
    return _rule_rows(spark, d).select(
        "p_partkey", rules.meta_box(c).alias("meta"), rules.page_banner(c, b, h).alias("banner"), rules.chapter(c).alias("chapter"), rules.conditional_hook(c, font, med, bold).alias("hook"), rules.spread_title(c, b, font, med, h).alias("spread"),
        rules.reward_box(c).alias("reward"), rules.credits_heading(c).alias("credits"), rules.editorial_credits(c).alias("editorial"), rules.list_item(c, bold).alias("item"), rules.boxed_title(c, bold).alias("boxed"), rules.visual_tier(c, b, h, font, med, bold).alias("tier"),
    )


@query(rf"""WITH {RULES} SELECT p_partkey, regexp_matches(c, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}') OR regexp_matches(c, '\d{{6}}/\d+/\d+') OR regexp_matches(c, 'PAGE\s+\d+') OR (y0 + 12 < 792 * 0.04 AND length(c) < 80) AS parasite, font <= 9 AND regexp_matches(c, '^W+$') AND length(c) <= 6 AS glyph FROM (SELECT p_partkey, font, y0, CASE p_partkey % 4 WHEN 0 THEN concat('a', p_size, '@x.org') WHEN 1 THEN concat('n° 123456/', p_size, '/1') WHEN 2 THEN left('WWWWWWWWWW', p_size % 10) ELSE c END AS c FROM (SELECT r.*, p_size FROM r JOIN part USING (p_partkey)))""")
def parasites(spark, d):
    rows = _rule_rows(spark, d).join(table(spark, d, "part").select("p_partkey", "p_size"), "p_partkey")
    rows = rows.withColumn("c", F.expr("CASE p_partkey % 4 WHEN 0 THEN concat('a', p_size, '@x.org') WHEN 1 THEN concat('n° 123456/', p_size, '/1') WHEN 2 THEN left('WWWWWWWWWW', p_size % 10) ELSE c END"))
    return rows.select("p_partkey", rules.parasite(F.col("c"), F.col("b"), F.lit(792.0)).alias("parasite"), rules.glyph_parasite(F.col("c"), F.col("font") - 2).alias("glyph"))


@query(rf"""WITH {ODD}, t AS (SELECT *, CASE WHEN page % 4 = 0 THEN concat('PAGE ', block_index) ELSE text END AS c FROM odd), b AS (SELECT *, NOT (regexp_matches(c, '^PAGE\s+\d+$') OR (x1 - x0 <= 20 AND x0 >= 612 * 0.85 AND length(c) <= 80 AND {_N} <= 12)) AS body FROM t), p AS (SELECT document, page, count(*) FILTER (WHERE body) AS n, coalesce(sum(length(regexp_replace(regexp_replace(c, '[\p{{Cf}}\p{{Co}}]', '', 'g'), '^\s+|\s+$', '', 'g'))) FILTER (WHERE body), 0) AS chars FROM b GROUP BY ALL)
 SELECT document, page, n = 0 OR chars < 30 AS decorative, n <= 2 AS sparse FROM p""")
def page_kinds(spark, d):
    b = _odd(spark, d).withColumn("text", F.expr("CASE WHEN page % 4 = 0 THEN concat('PAGE ', block_index) ELSE text END"))
    return rules.page_kinds(b)


@query("WITH p AS (SELECT DISTINCT o_custkey, o_orderkey % 97 AS page, o_orderkey % 97 % 3 = 0 AS decorative FROM orders) SELECT o_custkey, page, max(CASE WHEN NOT decorative THEN page END) OVER (PARTITION BY o_custkey ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM p")
def last_text_page(spark, d):
    p = table(spark, d, "orders").select("o_custkey", (F.col("o_orderkey") % 97).alias("page"), (F.col("o_orderkey") % 97 % 3 == 0).alias("decorative")).distinct()
    return sequences.asof_preceding(p, ["o_custkey"], ["page"], ~F.col("decorative"), "page", "before").select("o_custkey", "page", "before")


@query("WITH p AS (SELECT DISTINCT o_custkey AS k, o_orderkey % 97 AS page, o_orderkey % 97 % 3 = 0 AS decorative, o_orderkey % 2 = 0 AS mine FROM orders), m AS (SELECT k, page, lag(page) OVER (PARTITION BY k ORDER BY page) AS before FROM (SELECT DISTINCT k, page FROM p WHERE mine)), s AS (SELECT m.*, before IS NOT NULL AND EXISTS (SELECT 1 FROM p WHERE p.k = m.k AND NOT p.decorative AND p.page > m.before AND p.page < m.page) AS cut FROM m) SELECT k, page, sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY page)::BIGINT AS part FROM s")
def substantive_gaps(spark, d):
    """A customer's even orders as the pages of a chunk, split where a page with text is left out."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), (F.col("o_orderkey") % 97).alias("page"), (F.col("o_orderkey") % 97 % 3 == 0).alias("decorative"), (F.col("o_orderkey") % 2 == 0).alias("mine"))
    return chunks.split_at_substantive_gaps(o.where("mine").select("k", "page").distinct(), o.select("k", "page", "decorative").distinct(), ["k"], "page", "decorative")


@query(f"""WITH {ODD}, m AS (SELECT document, page, block_index, x0, x1, y0, lag(y0) OVER (PARTITION BY document, page ORDER BY block_index) AS before FROM odd WHERE NOT bold), s AS (SELECT m.*, before IS NOT NULL AND EXISTS (SELECT 1 FROM odd h WHERE h.bold AND h.document = m.document AND h.page = m.page AND h.y0 > m.before AND h.y0 < m.y0 AND least(h.x1, m.x1) - greatest(h.x0, m.x0) > 0 AND (least(h.x1, m.x1) - greatest(h.x0, m.x0)) / least(h.x1 - h.x0, m.x1 - m.x0) >= 0.35) AS cut FROM m)
 SELECT document, page, block_index, sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY document, page ORDER BY block_index)::BIGINT AS part FROM s""")
def subordinate_splits(spark, d):
    """Blocks of each page split where a bold one of their column lies between two of them."""
    b = _odd(spark, d)
    return chunks.split_at_headings_between(b.where("NOT bold"), b.where("bold"), ["document", "page"], "block_index").select("document", "page", "block_index", "part")


@query("SELECT l_orderkey, l_linenumber, sum(CASE WHEN l_linestatus = 'O' AND l_quantity < 10 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS UNBOUNDED PRECEDING)::BIGINT AS part FROM (SELECT DISTINCT l_orderkey, l_linenumber, min(l_linestatus) OVER w AS l_linestatus, min(l_quantity) OVER w AS l_quantity FROM lineitem WINDOW w AS (PARTITION BY l_orderkey, l_linenumber))")
def heading_splits(spark, d):
    one = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_linestatus").alias("s"), F.min("l_quantity").alias("q"))
    return sequences.split_at_flags(one, ["l_orderkey"], ["l_linenumber"], (F.col("s") == "O") & (F.col("q") < 10)).select("l_orderkey", "l_linenumber", "part")


@query(rf"""WITH {RULES} SELECT p_partkey, CASE WHEN length(c) > 120 OR len(string_split(c, ' ')) > 14 THEN NULL WHEN regexp_matches(c, '^(?:CHAPITRE|ACTE|PARTIE|CHAPTER) ') THEN 1 WHEN regexp_matches(c, '^\d+(?:\.\d+)*[.)]? ') AND (bold OR font >= 10.5) THEN least(4, length(regexp_replace(regexp_extract(c, '^(\d+(?:\.\d+)*)', 1), '[^.]', '', 'g')) + 2) WHEN font >= 13 THEN 1 WHEN font >= 11.5 THEN 2 ELSE 3 END AS level FROM (SELECT p_partkey, font, bold, CASE p_partkey % 3 WHEN 0 THEN concat('CHAPITRE ', p_size) WHEN 1 THEN concat(p_size, '.2.', p_size, ' Titre') ELSE 'TITRE' END AS c FROM (SELECT r.*, p_size FROM r JOIN part USING (p_partkey))) WHERE bold""")
def heading_levels(spark, d):
    rows = _rule_rows(spark, d).join(table(spark, d, "part").select("p_partkey", "p_size"), "p_partkey").where("bold")
    rows = rows.withColumn("c", F.expr("CASE p_partkey % 3 WHEN 0 THEN concat('CHAPITRE ', p_size) WHEN 1 THEN concat(p_size, '.2.', p_size, ' Titre') ELSE 'TITRE' END"))
    kind = blocks.heading_kind(F.col("c"), F.col("font"), F.lit(10.0), F.col("bold"))
    return rows.select("p_partkey", blocks.heading_level(kind, F.col("font"), F.lit(10.0), F.col("c")).alias("level"))


@query("SELECT c_custkey, c_name FROM customer WHERE (contains(lower(c_comment_), 'black book') OR contains(lower(c_comment_), 'tous droits')) AND contains(lower(c_comment_), 'introduction') AND upper(c_mktsegment) <> 'CRÉDITS' AND c_custkey % 7 <> 0".replace("c_comment_", "(CASE WHEN c_custkey % 2 = 0 THEN 'Black Book. Introduction' WHEN c_custkey % 3 = 0 THEN 'Introduction, tous droits réservés' ELSE 'rien' END)"))
def credits_mixing(spark, d):
    c = table(spark, d, "customer").withColumns({"t": F.expr("CASE WHEN c_custkey % 2 = 0 THEN 'Black Book. Introduction' WHEN c_custkey % 3 = 0 THEN 'Introduction, tous droits réservés' ELSE 'rien' END"), "s": F.expr("CASE WHEN c_custkey % 7 = 0 THEN 'Crédits' ELSE c_mktsegment END")})
    return audit.credits_mixed(c, "t", "s").select("c_custkey", "c_name")
