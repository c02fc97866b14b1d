from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.operators import chunks, glyphs, rules, sections


def test_rules(spark):
    row = spark.sql("SELECT 'INTRODUCTION' AS c, named_struct('x0', 0.0, 'y0', 10.0, 'x1', 100.0, 'y1', 30.0) AS b, 30.0 AS font, 10.0 AS med, true AS bold, 792.0 AS h")
    c, b, font, med, bold, h = (F.col(x) for x in ("c", "b", "font", "med", "bold", "h"))
    got = row.select(rules.page_banner(c, b, h), rules.spread_title(c, b, font, med, h), rules.visual_tier(c, b, h, font, med, bold), rules.meta_box(F.lit(" CRÉDITS ")), rules.reward_box(F.lit("Récompenses")), rules.list_item(F.lit("• un"), F.lit(False)), rules.conditional_hook(F.lit("Si les PJ fuient"), F.lit(11.0), F.lit(10.0), F.lit(True)), rules.editorial_credits(F.lit("© Black Book")), rules.boxed_title(F.lit("LE ROI"), F.lit(True)), rules.chapter(F.lit("Acte II")), rules.glyph_parasite(F.lit("WW"), F.lit(6.0))).first()
    assert tuple(got) == (True, True, "banner", True, True, True, True, True, True, True, True)


def test_page_kinds_and_order(spark):
    rows = [("d", 1, 0, "PAGE 3", 10.0), ("d", 2, 0, "Un long corps de texte qui compte vraiment", 10.0), ("d", 2, 1, "suite", 40.0)]
    df = spark.createDataFrame(rows, "document string, page int, block_index int, text string, y double").withColumn("bbox", G.box(F.lit(50.0), F.col("y"), F.lit(250.0), F.col("y") + 10.0))
    assert {r["page"]: (r["decorative"], r["sparse"]) for r in rules.page_kinds(df).collect()} == {1: (True, True), 2: (False, True)}
    assert rules.in_order(df).first()["ordered"]


def test_sections(spark):
    head = [("d", 1, 0, 10.0, 20.0, "ACTE I", "chapter", 1, True), ("d", 1, 3, 60.0, 70.0, "La porte", "subordinate", 2, False), ("d", 2, 1, 10.0, 20.0, "Grand", "other", 1, False), ("d", 3, 0, 10.0, 20.0, "Petit", "other", 2, False)]
    h = spark.createDataFrame(head, "document string, page int, block int, y0 double, y1 double, title string, tier string, level int, caps boolean")
    last = spark.createDataFrame([("d", 5), ("e", 2)], "document string, last_page int")
    got = {(r["document"], r["title"]): r for r in sections.detect_sections(h, last).collect()}
    assert got["d", "La porte"]["parent"] == 0 and got["d", "Grand"]["parent"] is None and got["d", "Petit"]["parent"] == 2
    assert got["d", "ACTE I"]["page_end"] == 1 and got["d", "Petit"]["page_end"] == 5 and got["e", "Document"]["page_end"] == 2


def test_chunks(spark):
    rows = [("d", 0, i, 1 + i // 3, i, None if i != 4 else "s1", i == 2, "x" * 30) for i in range(8)]
    df = spark.createDataFrame(rows, "document string, section int, ord int, page int, block_index int, stat_id string, is_heading boolean, text string").withColumn("bbox", G.box(F.lit(0.0), F.col("ord") * 1.0, F.lit(9.0), F.col("ord") + 1.0))
    grouped = chunks.group_blocks(df, budget=60)
    by = {r["ord"]: r["chunk"] for r in grouped.collect()}
    assert [by[i] for i in range(8)] == [0, 0, 1, 1, 2, 3, 3, 4]
    out = chunks.build_chunks(grouped).orderBy("chunk").collect()
    assert len(out) == 5 and [len(s["page_block_ids"]) for c in out for s in c["source_spans"]] == [2, 1, 1, 1, 1, 1, 1] and out[0]["text"] == "x" * 30 + "\n\n" + "x" * 30


def test_glyphs(spark):
    rows = [("d", 1, 10.0 + 5 * i, 20.0, 5.0, 10.0, ch) for i, ch in enumerate("Le ")] + [("d", 1, 200.0, 20.4, 5.0, 10.0, "X")] + [("d", 1, 10.0 + 5 * i, 32.0, 5.0, 10.0, ch) for i, ch in enumerate("roi")]
    df = spark.createDataFrame(rows, "document string, page int, x double, y double, width double, font double, text string")
    segs = glyphs.segments(df)
    assert sorted(r["text"] for r in segs.collect()) == ["Le ", "X", "roi"]
    assert any(r["text"].split() == ["Le", "roi"] for r in glyphs.paragraphs(segs.where("text <> 'X'")).collect())
