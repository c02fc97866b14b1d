import json
import unicodedata

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import text as T
from quire.operators import audit, blocks, catalog, merging, semantic, sequences, statblocks
from quire.sources.layout import layout_blocks, layout_nodes
from quire.streaming.coverage import running_coverage


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_text_functions(spark):
    assert one(spark, T.reflow(F.lit("un mon-\nstre\nvert\n\n\nfin"))) == "un monstre vert\n\nfin"
    assert one(spark, T.reflow(T.reflow(F.lit("a\nb")))) == "a b"
    assert one(spark, T.preview(F.lit("x" * 300))) == "x" * 199 + "…"
    assert one(spark, T.fold_key(F.lit("  Éclair Straße "))) == "eclair strasse"
    assert one(spark, T.first_keyword(F.lit("in Truth, a SECRET"))) == "secret" and one(spark, T.first_keyword(F.lit("an ambush and a trap"))) is None
    assert one(spark, T.fold_key(F.lit(" Ǆ ﬁn Ệ Straße ½ É́"))) == "dz fin e strasse 1⁄2 e"
    assert one(spark, T.slug_from_filename(F.lit("L'Été noir.PDF"))) == "l-ete-noir"
    assert one(spark, T.strip_layout_glyphs(F.lit("W Garde\nW\n\n épée"))) == "Garde\népée"
    assert one(spark, T.from_url_name(T.url_name(F.lit("a b+c é")))) == "a b+c é"


def test_geometry(spark):
    box = lambda *v: G.box(*(F.lit(float(x)) for x in v))
    assert one(spark, G.overlap_ratio(box(0, 0, 10, 1), box(5, 0, 25, 1))) == 0.5
    assert one(spark, G.iou(box(0, 0, 2, 2), box(1, 0, 3, 2))) == 1 / 3
    assert one(spark, G.y_bucket(F.lit(12.5))) == 10
    assert one(spark, G.coverage(F.lit(""), F.lit(1.0), F.lit(1.0))) == 0.0


def test_merges(spark):
    rows = [("d", 1, 0, "un long mon-"), ("d", 1, 1, "stre gris"), ("d", 1, 2, "et vert."), ("d", 1, 3, "puis rien"), ("d", 1, 4, "Fin")]
    style = {"font": F.lit(10.0), "max_font": F.lit(10.0), "bold": F.lit(False), "italic": F.lit(False), "lines": F.lit(1).cast("long"), "role": F.lit(None).cast("string")}
    pieces = spark.createDataFrame(rows, "document string, page int, ord int, text string").withColumns({"bbox": G.box(F.lit(50.0), F.col("ord") * 12.0, F.lit(250.0), F.col("ord") * 12.0 + 10.0), **style})
    one_ = F.struct("text", "bbox", *style)
    w = Window.partitionBy("document", "page").orderBy("ord")
    pieces = pieces.withColumn("kind", F.when(F.lag("text").over(w).isNotNull(), merging.merge_kind(F.lag(one_).over(w), one_)))
    out = merging.merge_runs(pieces, ["document", "page"], "ord", "kind").orderBy("block_index").collect()
    assert [r["lines"] for r in out] == [3, 1, 1] and tuple(out[0]["bbox"]) == (50.0, 0.0, 250.0, 34.0)
    caps = spark.createDataFrame([("d", 1, 0, "L", 20.0, 5.0), ("d", 1, 1, "e roi", 10.0, 9.0), ("d", 1, 2, "Fin", 10.0, 9.0)], "document string, page int, block_index int, text string, font double, x double")
    caps = caps.withColumn("bbox", G.box(F.col("x"), F.lit(0.0), F.lit(50.0), F.lit(9.0)))
    assert [r["text"] for r in blocks.merge_drop_caps(caps).orderBy("block_index").collect()] == ["Le roi", "Fin"]


def test_filters(spark):
    rows = [("d", p, 0, "shop@example.com", 760.0) for p in range(1, 5)] + [("d", p, 1, f"Un corps de texte numero {p}", 300.0) for p in range(1, 5)] + [("d", 1, 2, "PAGE 12", 500.0)]
    df = spark.createDataFrame(rows, "document string, page int, block_index int, text string, y double").withColumn("bbox", G.box(F.lit(50.0), F.col("y"), F.lit(250.0), F.col("y") + 10.0))
    out = blocks.filter_blocks(df).collect()
    assert len(out) == 4 and all(r["text"].startswith("Un corps") and r["block_index"] == 0 for r in out)


def test_sequences(spark):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate([300, 400, 200, 900, 10])], "k int, o int, s int")
    assert [r["chunk"] for r in sequences.greedy_pack(df, ["k"], "o", "s", 700).orderBy("o").collect()] == [0, 0, 1, 2, 3]
    flags = sequences.split_at_flags(df, ["k"], ["o"], F.col("s") == 400, "part").orderBy("o").collect()
    assert [r["part"] for r in flags] == [0, 1, 1, 1, 1]
    assert [(r["after"], r["missing"]) for r in sequences.gaps(spark.createDataFrame([(1, 1), (1, 4), (1, 4)], "k int, p int"), ["k"], "p").collect()] == [(1, 2)]


def test_catalog(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string")
    assert sorted(map(tuple, catalog.upsert(old, new, ["id"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, catalog.upsert(old, new, ["id"], keep=("v",)).collect())) == [(1, "a"), (2, "b"), (3, "d")]
    assert sorted(map(tuple, catalog.insert_absent(old, new, ["id"]).collect())) == [(1, "a"), (2, "b"), (3, "d")]
    assert catalog.in_list(old, "id", []).count() == 0
    found = catalog.lookup(spark.createDataFrame([(1, "Garde", None), (2, "x", "GARDÉ")], "id int, n string, s string"), ["n", "s"], F.lit("garde"), T.fold_key, "id").collect()
    assert len(found) == 2 and found[0]["matches"] == 2


def test_semantic_and_audit(spark):
    f = semantic.validate([semantic.bad_confidence(spark.createDataFrame([(1, 2.0), (2, 0.5), (3, None)], "id int, c double"), "id", "c", "entity"), semantic.relations_without_refs(spark.createDataFrame([(1, [])], "id int, r array<int>"), "id", "r")])
    assert tuple(semantic.verdict(f).first()) == (False, 1, 1)
    u = audit.chunk_uniqueness(spark.createDataFrame([(["a", "b"],), (["b", "a"],), (["c"],)], "m array<string>"), "m").first()
    assert (u["chunks"], u["unique_chunks"], u["duplicates"]) == (3, 2, 1)
    assert audit.chunk_uniqueness(spark.createDataFrame([], "m array<string>"), "m").first()["ratio"] == 1.0
    assert [r["t"] for r in audit.truncated_titles(spark.createDataFrame([("LE ROI",), ("LE",), ("FIN",)], "t string"), "t").orderBy("t").collect()] == ["FIN", "LE ROI"]


def test_stat_blocks(spark):
    assert tuple(one(spark, statblocks.header(F.lit("GARDE NOIR, capitaine | NC 1/2")))) == ("GARDE NOIR", "capitaine", "1/2", None)
    assert one(spark, statblocks.attributes(F.lit("AGI +1 CON -2 AGI +3"))) == {"AGI": 3, "CON": -2}
    assert [tuple(a) for a in one(spark, statblocks.attacks(F.lit("Epée longue +5 · DM 1d8+2")))] == [("Epée longue", 5, "1d8+2")]
    assert one(spark, statblocks.ability(F.lit("ATTAQUE BRUTALE (L) : il frappe\n fort"))) == ("ATTAQUE BRUTALE", "il frappe\nfort") and one(spark, statblocks.ability(F.lit("Attaque brutale (L) : il frappe"))) is None
    assert one(spark, statblocks.attributes(F.lit("agi +2 FOR +1"))) == {"AGI": 2, "FOR": 1} and one(spark, statblocks.header(F.lit("x\nGarde noir | NC 2")))["name"] == "Garde noir"
    assert one(spark, statblocks.rulebook_reference(F.lit("Voir le profil de gobelin (COF)"))) == one(spark, statblocks.rulebook_reference(F.lit("Utilisez le profil du gobelin que vous trouverez dans le livre de règles de COF"))) == "gobelin"


def test_layout(spark):
    span = lambda t, size, flags=0: {"text": t, "size": size, "flags": flags, "font": "f", "color": 0, "bbox": [0, 0, 1, 1]}
    page = {"blocks": [{"type": 0, "bbox": [0, 0, 9, 9], "lines": [{"bbox": [0, 0, 9, 4], "spans": [span("Le ", 10.0), span("roi", 14.0, 16)]}, {"bbox": [0, 4, 9, 9], "spans": [span(" ", 9.0)]}]}, {"type": 1, "bbox": [0, 0, 1, 1]}, {"type": 0, "bbox": [0, 0, 1, 1], "lines": [{"bbox": [0, 0, 1, 1], "spans": [span("  ", 9.0)]}]}]}
    pages = spark.createDataFrame([("d", 1, json.dumps(page)), ("d", 2, None)], "doc string, page int, raw_layout string")
    b = layout_blocks(pages).collect()
    assert len(b) == 1 and b[0]["text"] == "Le roi" and b[0]["is_bold"] and b[0]["line_count"] == 1 and b[0]["block_index"] == 0
    nodes = layout_nodes(pages, ["doc", "page"])
    assert sorted(r["id"] for r in nodes.collect()) == ["b0", "b0_l0", "b0_l0_s0", "b0_l0_s1", "b0_l1", "b1", "b2", "b2_l0"]
    assert layout_nodes(pages, ["doc", "page"], level="span").count() == 2


def test_stream(spark, tmp_path):
    spark.createDataFrame([("a", "x" * 9000), ("a", "x"), ("b", None)], "document string, text string").write.parquet(str(tmp_path / "in"))
    stream = running_coverage(spark.readStream.schema("document string, text string").parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("cov").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert {r["document"]: r["status"] for r in spark.table("cov").collect()} == {"a": "completed", "b": "rejected"}


def test_tree_paths_loses_no_level(spark):
    rows = [(i, i - 1 if i else None, f"t{i}") for i in range(4)]
    df = spark.createDataFrame(rows, "id int, parent int, title string")
    assert {(r["id"], r["depth"], r["path"]) for r in catalog.tree_paths(df, "id", "parent", "title", 4).collect()} == {(i, i, "/".join(f"t{j}" for j in range(i + 1))) for i in range(4)}
    with pytest.raises(ValueError):
        catalog.tree_paths(df, "id", "parent", "title", 3)


def test_best_matches_of_whole_pages(spark):
    import math
    import random

    r = random.Random(5)

    def boxes(n):
        corners = [(p, i, float(r.randint(0, 900)), float(r.randint(0, 2000))) for p in range(2) for i in range(n)]
        return [("d", p, i, x, y, x + r.randint(5, 300), y + r.randint(5, 60)) for p, i, x, y in corners]

    def iou(p, q):
        i = max(0, min(p[5], q[5]) - max(p[3], q[3])) * max(0, min(p[6], q[6]) - max(p[4], q[4]))
        return i / (sum((z[5] - z[3]) * (z[6] - z[4]) for z in (p, q)) - i)

    def match(p):
        near = [q for q in b if q[1] == p[1]]
        top = max(near, key=lambda q: (round(iou(p, q), 9), -q[2]))
        return top[2] if iou(p, top) >= 0.05 else min(near, key=lambda q: (math.hypot((p[3] + p[5]) / 2 - (q[3] + q[5]) / 2, (p[4] + p[6]) / 2 - (q[4] + q[6]) / 2), q[2]))[2]

    a, b = boxes(60), boxes(40)
    df = lambda rows: spark.createDataFrame(rows, "document string, page int, block_index long, x0 double, y0 double, x1 double, y1 double").select("document", "page", "block_index", G.box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("bbox"))
    got = {(g["page"], g["source_block"]): g["match"] for g in blocks.best_matches(df(a), df(b)).collect()}
    assert got == {(p[1], p[2]): match(p) for p in a} and any(iou(p, q) < 0.05 for p in a for q in b if p[1] == q[1] and q[2] == match(p))


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_once_evaluates_what_it_names_once(spark):
    """a text is stripped once however many patterns are held against it."""
    df = spark.createDataFrame([("A\nb",)], "t string")
    for made in (statblocks.hinted_abilities(df.t), statblocks.header(T.strip_layout_glyphs(df.t)), statblocks.ability(df.t), statblocks.inline_abilities(df.t), statblocks.rulebook_reference(df.t)):
        assert _plan(df.select(made.alias("x"))).count("^W\\s+") == 1
    assert _plan(df.select(T.fold_key(df.t).alias("x"))).count("^\\s+|\\s+$") == 1


def test_fold_key_is_that_of_unicode(spark):
    """Characters that fold to several, to one, away; alone and among others."""
    one, _, gone, many = T.fold_table()
    texts = [*list(many)[::7], *(f"a{c}{d}B" for c, d in zip(one[::40], list(many)[::11])), *(f"x{c}" for c in gone[::50]), "Straße", "", None]
    bare = lambda t: "".join(x for x in unicodedata.normalize("NFKD", t.casefold()) if not unicodedata.combining(x))
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r["i"]: r["k"] for r in df.select("i", T.fold_key(df.t).alias("k")).collect()}
    assert [got[i] for i in range(len(texts))] == [None if t is None else "".join(map(bare, t.strip("\t\n\x0b\f\r "))).lower() for t in texts]


def test_lookup_folds_its_rows_once(spark):
    """the number of rows found is that of the rows as written, they are not folded anew."""
    df = spark.createDataFrame([(1, "Été"), (2, "ete"), (3, "x"), (4, None)], "i int, t string")
    found = catalog.lookup(df, ["t"], F.lit("ÉTÉ "), T.fold_key, "i")
    assert "translate" not in _plan(found)
    assert sorted((r["i"], r["matches"]) for r in found.collect()) == [(1, 2), (2, 2)]


def test_best_matches_deals_finer_parts(spark):
    """a task sorts and groups an eighth of what a usual part has."""
    df = spark.createDataFrame([("d", "p", i, (0.0, 9.0 * i, 9.0, 9.0 * i + 9)) for i in range(4)], "document string, page string, block_index long, bbox struct<x0:double,y0:double,x1:double,y1:double>")
    out = blocks.best_matches(df, df.where("block_index % 2 = 0"))
    wanted = blocks.FINER * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert _plan(out).count(f", {wanted}") >= 5
    assert sorted((r["source_block"], r["match"]) for r in out.collect()) == [(0, 0), (1, 0), (2, 2), (3, 2)]
