"""The queries over the driver's tables and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import ids
from quire.functions import text as T
from quire.operators import audit, blocks, catalog, sections, semantic, sequences, statblocks
from quire.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

BLOCKS = r"""blocks AS (SELECT source AS document, doc_id AS page, CAST(i - 1 AS BIGINT) AS block_index, line AS text
 FROM (SELECT source, doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (SELECT source, doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\S')) AS l FROM documents WHERE text IS NOT NULL) WHERE len(l) > 0)),
boxes AS (SELECT *, 50.0::DOUBLE + 260.0::DOUBLE * (block_index % 2) AS x0, 250.0::DOUBLE + 260.0::DOUBLE * (block_index % 2) AS x1, 40.0::DOUBLE + 14.0::DOUBLE * (block_index // 2) AS y0, 52.0::DOUBLE + 14.0::DOUBLE * (block_index // 2) AS y1,
 CASE WHEN length(text) < 40 THEN 14.0::DOUBLE ELSE 10.0::DOUBLE END AS font, length(text) < 40 AS is_bold FROM blocks)"""


def query(sql: str | None = None):
    """Register a query and its SQL under the function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return blocks.lines_as_blocks(table(spark, d, "documents")).withColumn("block_index", F.col("block_index").cast("long"))


@query(r"""SELECT source, round(avg(least(1.0::DOUBLE, length(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')) * 50.0::DOUBLE / (612.0 * 792.0)::DOUBLE)), 6) AS coverage, count(*) AS pages,
 CASE WHEN avg(least(1.0::DOUBLE, length(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')) * 50.0::DOUBLE / (612.0 * 792.0)::DOUBLE)) < 0.3 THEN 'rejected' ELSE 'completed' END AS status FROM documents GROUP BY source""")
def coverage_by_source(spark, d):
    """Mean text coverage of each source's pages and whether the source is rejected."""
    ratio = G.coverage(F.coalesce("text", F.lit("")), F.lit(612.0), F.lit(792.0))
    out = table(spark, d, "documents").groupBy("source").agg(F.avg(ratio).alias("c"), F.count(F.lit(1)).alias("pages"))
    return out.select("source", F.round("c", 6).alias("coverage"), "pages", F.when(F.col("c") < 0.3, "rejected").otherwise("completed").alias("status"))


@query(f"WITH {BLOCKS} SELECT document, page, block_index, x0, y0, x1, y1, round_even(y0 / 5, 0)::DOUBLE * 5 AS y_bucket, CASE WHEN (x0 + x1) / 2 < 306 THEN 'left' ELSE 'right' END AS side, 'block_' || document || '_' || lpad(page::VARCHAR, greatest(3, length(page::VARCHAR))::INT, '0') || '_' || lpad(block_index::VARCHAR, greatest(3, length(block_index::VARCHAR))::INT, '0') AS id FROM boxes")
def page_blocks_view(spark, d):
    b = _blocks(spark, d)
    box = F.col("bbox")
    return b.select("document", "page", "block_index", "bbox.*", G.y_bucket(box["y0"]).cast("double").alias("y_bucket"), G.side(box, F.lit(612.0)).alias("side"), ids.block_id(F.col("document"), F.col("page"), F.col("block_index")).alias("id"))


@query(rf"WITH {BLOCKS}, n AS (SELECT DISTINCT document, page, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS norm FROM blocks WHERE length(text) <= 200) SELECT document, norm, count(*) AS pages FROM n GROUP BY ALL HAVING count(*) >= 3")
def repeated_line_watermarks(spark, d):
    return blocks.repeated_texts(_blocks(spark, d), 3, 0.0)


MARKED_LINES = "concat(text, CASE WHEN block_index % 5 = 0 THEN concat(' a', page, '@shop.example 123456/', page, '/7') WHEN block_index % 7 = 0 THEN ' x@y.org' ELSE '' END)"


@query(rf"WITH {BLOCKS} SELECT document, page, block_index FROM (SELECT *, {MARKED_LINES} AS t FROM blocks) WHERE regexp_matches(t, '(?:[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}.*[0-9]{{6}}/[0-9]+/[0-9]+)|(?:[0-9]{{6}}/[0-9]+/[0-9]+.*[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}})') OR regexp_matches(t, '^[^@\n]{{1,80}} - [A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}') OR contains(t, 'passw')")
def drm_pattern_lines(spark, d):
    b = _blocks(spark, d).withColumn("text", F.expr(MARKED_LINES))
    return b.where(blocks.matches_drm(F.col("text"), ("passw",))).select("document", "page", "block_index")


@query(rf"""WITH {BLOCKS}, c AS (SELECT document, page, block_index, text, trim(regexp_replace(regexp_replace(text, '[\x{{E000}}-\x{{F8FF}}\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{{9F}}]', '', 'g'), '\s+', ' ', 'g')) AS t FROM blocks), m AS (SELECT *, length(t) AS n, length(regexp_replace(t, '\P{{L}}', '', 'g')) AS l FROM c),
 r AS (SELECT document, page, block_index, CASE WHEN regexp_matches(text, '(?i)\b(AGI|FOR|CON|INT|PER|CHA|VOL)\s*[+-]|\|\s*NC\s*\d') THEN NULL WHEN regexp_matches(text, '[\x0C\x0F\x{{9A}}]|Princesse d.') THEN 'diagram' WHEN n = 0 THEN 'empty' WHEN n < 12 AND l < 4 THEN 'short' WHEN n >= 12 AND l < n * 0.35 THEN 'sparse' END AS rule FROM m) SELECT * FROM r WHERE rule IS NOT NULL""")
def garbled_lines(spark, d):
    return _blocks(spark, d).withColumn("rule", blocks.garbled(F.col("text"))).where("rule IS NOT NULL").select("document", "page", "block_index", "rule")


@query(f"WITH {BLOCKS} SELECT document, page, coalesce(median(nullif(font, 0)), 12.0)::DOUBLE AS median_font FROM boxes GROUP BY ALL")
def page_median_font(spark, d):
    return blocks.page_medians(_blocks(spark, d))


@query(rf"WITH {BLOCKS}, m AS (SELECT document, page, coalesce(median(nullif(font, 0)), 12.0) AS med FROM boxes GROUP BY ALL) SELECT document, page, block_index, text FROM boxes JOIN m USING (document, page) WHERE is_bold AND font >= med * 1.05 AND (regexp_matches(text, '^\p{{Lu}}[\p{{L}}\p{{N}}_''’-]*\.?$') OR regexp_matches(text, '^\p{{Lu}}[\p{{L}}\p{{N}}_''’-]*(?: (?:[\p{{Ll}}][\p{{L}}\p{{N}}_''’-]*|\p{{Lu}}{{2,}})){{1,5}}\.?$')) AND length(text) <= 120 AND NOT regexp_matches(text, '^[A-Z]-\d+$') AND NOT regexp_matches(text, '^(?:CHAPITRE|ACTE|PARTIE|CHAPTER) ')")
def heading_candidates(spark, d):
    b = _blocks(spark, d)
    b = b.join(blocks.page_medians(b), ["document", "page"])
    kind = blocks.heading_kind(F.col("text"), F.col("font"), F.col("median_font"), F.col("is_bold"))
    return b.where(kind == "title_case").select("document", "page", "block_index", "text")


@query(f"WITH {BLOCKS} SELECT document, page, block_index, row_number() OVER (PARTITION BY document, page ORDER BY round_even(y0 / 5, 0) * 5, x0, block_index) - 1 AS rank FROM boxes")
def spatial_sort(spark, d):
    return blocks.spatial_rank(_blocks(spark, d)).select("document", "page", "block_index", F.col("rank").cast("long"))


@query(f"WITH {BLOCKS} SELECT document, page, block_index, row_number() OVER (PARTITION BY document, page ORDER BY CASE WHEN (x0 + x1) / 2 < 306 THEN 'left' ELSE 'right' END, y0, x0, block_index) - 1 AS rank FROM boxes")
def column_major_sort(spark, d):
    return blocks.spatial_rank(_blocks(spark, d), column_major=True).select("document", "page", "block_index", F.col("rank").cast("long"))


@query(r"""SELECT conv_id::VARCHAR AS conv_id, turn, array_to_string(list_filter(list_transform(regexp_split_to_array(t, '\n\s*\n'), lambda p: CASE WHEN len(list_filter(list_transform(string_split(p, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')) = 0 THEN '' ELSE
 trim(regexp_replace(list_reduce(list_filter(list_transform(string_split(p, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), lambda a, x: CASE WHEN regexp_matches(a, '[-­‐‑‒–—−﹣]$') THEN regexp_replace(a, '[-­‐‑‒–—−﹣]$', '') || x ELSE a || ' ' || x END), ' {2,}', ' ', 'g')) END), lambda x: x <> ''), chr(10) || chr(10)) AS flowed FROM (SELECT *, replace(text, ', ', '-' || chr(10)) AS t FROM conversations)""")
def reflow_text(spark, d):
    """Every turn, its commas made into line ends within words."""
    return table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("conv_id"), "turn", T.reflow(F.replace("text", F.lit(", "), F.lit("-\n"))).alias("flowed"))


@query(r"SELECT c_custkey, strip_accents(lower(trim(c_mktsegment))) AS key, count(*) OVER () AS matches FROM customer WHERE lower(c_mktsegment) = 'building' OR lower(c_name) = 'building'")
def fold_key_lookup(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_name").withColumn("marked", F.translate("c_mktsegment", "UI", "ÜÎ"))
    found = catalog.lookup(c, ["marked", "c_name"], F.lit(" Bûilding"), T.fold_key, "c_custkey")
    return found.select("c_custkey", T.fold_key(F.col("marked")).alias("key"), "matches")


@query(r"SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE regexp_replace(left(text, 199), '\s+$', '') || '…' END AS preview FROM documents")
def preview_truncate(spark, d):
    return table(spark, d, "documents").select("doc_id", T.preview(F.col("text")).alias("preview"))


@query("SELECT r_regionkey, r_name, count(n_nationkey) AS nations FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL")
def list_parents_with_counts(spark, d):
    return catalog.with_counts(table(spark, d, "region"), table(spark, d, "nation"), "r_regionkey", "n_regionkey", "nations")


@query("SELECT o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS lines, (SELECT count(*) FROM orders p WHERE p.o_custkey = o.o_custkey) AS siblings FROM orders o")
def document_counts(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    out = catalog.with_counts(o, table(spark, d, "lineitem"), "o_orderkey", "l_orderkey", "lines")
    return catalog.with_counts(out, o, "o_custkey", "o_custkey", "siblings").select("o_orderkey", "lines", "siblings")


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_run(spark, d):
    return catalog.latest(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_orderstatus"])


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def missing_refs_anti(spark, d):
    return catalog.without(table(spark, d, "orders"), table(spark, d, "lineitem"), "o_orderkey", "l_orderkey").select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size <= 25) OR NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey AND s_acctbal > 0)")
def unknown_endpoints(spark, d):
    e = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return catalog.unknown_endpoints(e, "l_partkey", "l_suppkey", table(spark, d, "part").where("p_size <= 25").select("p_partkey"), table(spark, d, "supplier").where("s_acctbal > 0").select("s_suppkey"))


@query("WITH r AS (SELECT o_orderkey, unnest(range(1, 5)) AS m FROM orders) SELECT o_orderkey, string_agg(m::VARCHAR, ',' ORDER BY m) AS missing FROM r WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = m) GROUP BY 1")
def unknown_block_ids(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.sequence(F.lit(1), F.lit(4)).alias("ids"))
    out = catalog.missing_members(o, "o_orderkey", "ids", table(spark, d, "lineitem"), "l_orderkey", "l_linenumber")
    return out.select("o_orderkey", F.array_join("missing", ",").alias("missing"))


@query("SELECT l_orderkey, min(l_linenumber)::BIGINT AS page_start, max(l_linenumber)::BIGINT AS page_end FROM lineitem GROUP BY 1 HAVING max(l_linenumber) >= 3 AND min(l_linenumber) <= 2")
def interval_overlap(spark, d):
    spans = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_linenumber").cast("long").alias("page_start"), F.max("l_linenumber").cast("long").alias("page_end"))
    return catalog.overlapping(spans, "page_start", "page_end", F.lit(3), F.lit(2))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 50 OFFSET 100")
def pagination(spark, d):
    return catalog.page_of(table(spark, d, "orders"), ["o_orderdate", "o_orderkey"], 50, 100).select("o_orderkey", "o_totalprice")


@query("SELECT event_id, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS view_id FROM events QUALIFY event_type = 'purchase'")
def asof_preceding(spark, d):
    e = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type")
    out = sequences.asof_preceding(e, ["user_id"], ["ts", "event_id"], F.col("event_type") == "view", "event_id", "view_id")
    return out.where("event_type = 'purchase'").select("event_id", "view_id")


@query("SELECT event_id, first_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS purchase_id FROM events QUALIFY event_type = 'view'")
def forward_asof(spark, d):
    e = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type")
    out = sequences.asof_following(e, ["user_id"], ["ts", "event_id"], F.col("event_type") == "purchase", "event_id", "purchase_id")
    return out.where("event_type = 'view'").select("event_id", "purchase_id")


@query(f"WITH {BLOCKS} SELECT h.document, h.page, h.block_index AS heading, count(*) AS members FROM boxes h JOIN boxes b ON b.document = h.document AND b.page = h.page AND h.is_bold AND NOT b.is_bold AND b.y1 > h.y0 AND least(h.x1, b.x1) > greatest(h.x0, b.x0) GROUP BY ALL")
def zone_theta_join(spark, d):
    b = _blocks(spark, d)
    h = b.where("is_bold").select("document", "page", F.col("block_index").alias("heading"), F.col("bbox").alias("hbox"))
    j = b.where("NOT is_bold").join(h, ["document", "page"]).where(G.in_zone(F.col("hbox"), F.col("bbox"), F.lit(False)))
    return j.groupBy("document", "page", "heading").agg(F.count(F.lit(1)).alias("members"))


@query(f"""WITH {BLOCKS}, p AS (SELECT a.document, a.page, a.block_index AS source_block, b.block_index AS match, sqrt(pow((a.x0 + 3.0 + a.x1 + 3.0 - b.x0 - b.x1) / 2, 2) + pow((a.y0 + 5.0 + a.y1 + 5.0 - b.y0 - b.y1) / 2, 2)) AS far,
 greatest(0.0, least(a.x1 + 3.0, b.x1) - greatest(a.x0 + 3.0, b.x0)) * greatest(0.0, least(a.y1 + 5.0, b.y1) - greatest(a.y0 + 5.0, b.y0)) AS inter FROM boxes a JOIN boxes b USING (document, page) WHERE b.block_index % 3 = 0), q AS (SELECT *, (inter / (200.0 * 12.0 * 2 - inter))::DOUBLE AS iou FROM p)
 SELECT document, page, source_block, match, round(iou, 6) AS iou FROM q QUALIFY row_number() OVER (PARTITION BY document, page, source_block ORDER BY CASE WHEN iou >= 0.05 THEN -round(iou, 9) ELSE 0 END, CASE WHEN iou >= 0.05 THEN 0 ELSE round(far, 6) END, match) = 1""")
def best_iou_match(spark, d):
    """Every block, shifted, with its best match among every third block of its page, the nearest centre where none overlaps."""
    b = _blocks(spark, d).select("document", "page", "block_index", "bbox")
    x = F.col("bbox")
    moved = b.withColumn("bbox", G.box(x["x0"] + 3.0, x["y0"] + 5.0, x["x1"] + 3.0, x["y1"] + 5.0))
    return blocks.best_matches(moved, b.where("block_index % 3 = 0")).withColumn("iou", F.round("iou", 6))


@query(f"WITH {BLOCKS} SELECT document, page, string_agg(block_index::VARCHAR, ',' ORDER BY block_index) FILTER (WHERE block_index % 2 = 0) AS a, string_agg(block_index::VARCHAR, ',' ORDER BY block_index) FILTER (WHERE block_index % 2 = 1) AS b FROM blocks GROUP BY ALL HAVING count(*) FILTER (WHERE block_index % 2 = 1) > 0")
def lane_pivot(spark, d):
    b = _blocks(spark, d).withColumn("lane", F.when(F.col("block_index") % 2 == 0, "a").otherwise("b"))
    p = b.groupBy("document", "page").pivot("lane", ["a", "b"]).agg(F.array_sort(F.collect_list("block_index")))
    return p.where(F.size("b") > 0).select("document", "page", F.array_join("a", ",").alias("a"), F.array_join("b", ",").alias("b"))


@query("WITH e AS (SELECT c_custkey AS a, 'lives_in' AS kind, c_nationkey::BIGINT AS b FROM customer UNION ALL SELECT s_suppkey, 'sells_in', s_nationkey FROM supplier) SELECT a AS entity, 'out' AS direction, kind, count(*) AS n, sum(b)::BIGINT AS others FROM e GROUP BY ALL UNION ALL SELECT b, 'in', kind, count(*), sum(a)::BIGINT FROM e GROUP BY ALL")
def edges_in_out(spark, d):
    e = table(spark, d, "customer").select(F.col("c_custkey").alias("a"), F.lit("lives_in").alias("kind"), F.col("c_nationkey").cast("long").alias("b")).unionByName(table(spark, d, "supplier").select(F.col("s_suppkey").alias("a"), F.lit("sells_in").alias("kind"), F.col("s_nationkey").cast("long").alias("b")))
    return catalog.edges_of(e, "a", "kind", "b").groupBy("entity", "direction", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("other").alias("others"))


@query("WITH RECURSIVE n AS (SELECT 'r' || r_regionkey AS id, NULL AS parent, r_name AS title FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_name FROM supplier), t AS (SELECT id, 0 AS depth, title AS path FROM n WHERE parent IS NULL UNION ALL SELECT n.id, t.depth + 1, t.path || '/' || n.title FROM n JOIN t ON n.parent = t.id) SELECT id, depth, path FROM t")
def section_tree(spark, d):
    r = table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("title"))
    n = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"), "n_name")
    s = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey"), F.concat(F.lit("n"), "s_nationkey"), "s_name")
    return catalog.tree_paths(r.union(n).union(s), "id", "parent", "title")


@query("SELECT count(*) AS chunks, count(toxic) AS classified, count(*) FILTER (WHERE c < 0.5) AS needs_review FROM (SELECT d.doc_id, toxic, (d.doc_id % 10) / 10.0 AS c FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)")
def conditional_summary(spark, d):
    chunks = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 10 / 10.0).alias("c")).join(table(spark, d, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return semantic.summary(chunks, "toxic", "c")


@query("WITH s AS (SELECT list_aggregate(list_sort(list_distinct(string_split(text, chr(10)))), 'string_agg', '|') AS s, count(*) AS n FROM documents GROUP BY 1) SELECT sum(n)::BIGINT AS chunks, count(*) AS unique_chunks, (sum(n) - count(*))::BIGINT AS duplicates, round(count(*) / sum(n), 6)::DOUBLE AS ratio FROM s")
def chunk_signature_dups(spark, d):
    out = audit.chunk_uniqueness(table(spark, d, "documents").select(F.split("text", "\n").alias("m")), "m")
    return out.select("chunks", "unique_chunks", "duplicates", F.round("ratio", 6).alias("ratio"))


@query("SELECT o_orderkey, coalesce(m, 1)::BIGINT AS page_end FROM orders LEFT JOIN (SELECT l_orderkey, max(l_linenumber) AS m FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def refine_page_end(spark, d):
    chunks = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").cast("long").alias("page_end"))
    found = table(spark, d, "orders").select("o_orderkey", F.lit(1).cast("long").alias("page_end"))
    return sections.refine_page_ends(found, chunks, ["o_orderkey"])


@query(r"SELECT md5(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS norm, arg_max(doc_id, (length(text)::BIGINT << 32) - doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def dedupe_keep_largest(spark, d):
    docs = table(spark, d, "documents").select(F.md5(T.squeeze(F.col("text"))).alias("norm"), "doc_id", F.length("text").alias("n"))
    return catalog.keep_largest(docs, ["norm"], "n", "doc_id").select("norm", "doc_id", "copies")


@query("WITH c AS (SELECT *, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS ch, row_number() OVER w AS rn FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT event_id, sum(CASE WHEN rn = 1 THEN 0 ELSE ch END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM c")
def island_partition(spark, d):
    e = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type")
    return sequences.islands(e, ["user_id"], ["ts", "event_id"], "event_type").select("event_id", "island")


@query("WITH x AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem), g AS (SELECT l_orderkey, l_linenumber AS after, lead(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS before FROM x) SELECT l_orderkey, after, before, (before - after - 1)::BIGINT AS missing FROM g WHERE before > after + 1")
def page_gap_split(spark, d):
    return audit.page_gaps(table(spark, d, "lineitem"), ["l_orderkey"], "l_linenumber")


@query("""WITH RECURSIVE r AS (SELECT conv_id, turn, length(text) AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM (SELECT conv_id, turn, max_by(text, length(text)) AS text FROM conversations GROUP BY ALL)), p AS (SELECT conv_id, turn, rn, s AS used, 0 AS chunk FROM r WHERE rn = 1
 UNION ALL SELECT r.conv_id, r.turn, r.rn, CASE WHEN p.used + r.s > 800 THEN r.s ELSE p.used + r.s END, p.chunk + CASE WHEN p.used + r.s > 800 THEN 1 ELSE 0 END FROM p JOIN r ON r.conv_id = p.conv_id AND r.rn = p.rn + 1) SELECT conv_id::VARCHAR AS conv_id, turn, chunk FROM p""")
def greedy_pack(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id", "turn").agg(F.max(F.length("text")).alias("s"))
    return sequences.greedy_pack(c, ["conv_id"], "turn", "s", 800).select(F.col("conv_id").cast("string").alias("conv_id"), "turn", "chunk")


@query(f"WITH {BLOCKS}, c AS (SELECT document, page, 2 * block_index AS o, left(text, 1) AS text FROM blocks UNION ALL SELECT document, page, 2 * block_index + 1, substr(text, 2) FROM blocks WHERE length(text) > 1), w AS (SELECT *, lead(text) OVER p AS nxt, lag(text) OVER p AS prv FROM c WINDOW p AS (PARTITION BY document, page ORDER BY o)), m AS (SELECT document, page, o, CASE WHEN regexp_matches(prv, '^\\p{{Lu}}$') AND regexp_matches(text, '^\\p{{Ll}}') THEN prv || text ELSE text END AS text, coalesce(regexp_matches(text, '^\\p{{Lu}}$') AND regexp_matches(nxt, '^\\p{{Ll}}'), false) AS gone FROM w) SELECT document, page, row_number() OVER (PARTITION BY document, page ORDER BY o) - 1 AS block_index, text FROM m WHERE NOT gone")
def drop_cap_merge(spark, d):
    b = _blocks(spark, d)
    first = b.select("document", "page", (F.col("block_index") * 2).alias("block_index"), F.substring("text", 1, 1).alias("text"))
    rest = b.where(F.length("text") > 1).select("document", "page", (F.col("block_index") * 2 + 1).alias("block_index"), F.expr("substring(text, 2)").alias("text"))
    parts = first.unionByName(rest).withColumns({"font": F.lit(14.0), "bbox": G.box(F.lit(50.0), F.lit(40.0), F.lit(250.0), F.lit(52.0))})
    return blocks.merge_drop_caps(parts).select("document", "page", F.col("block_index").cast("long"), "text")


@query("SELECT event_id, json_extract_string(props, '$.k') AS raw, CASE WHEN regexp_matches(json_extract_string(props, '$.k'), '^[0-9]+$') THEN json_extract_string(props, '$.k')::INT END AS num FROM events")
def json_path_extract(spark, d):
    raw = F.get_json_object("props", "$.k")
    return table(spark, d, "events").select("event_id", raw.alias("raw"), T.number_or_null(raw).alias("num"))


@query(r"SELECT p_partkey, (p_size % 7) AS agi, -(p_size % 5) AS con, 10 + p_size AS defense, p_size + 2 AS attack_bonus, '2d6+' || (p_size % 9 + 1) AS damage FROM part")
def attribute_map(spark, d):
    s = F.col("p_size").cast("string")
    text = F.concat(F.lit("GOBELIN | NC 1\nAGI +9 AGI +"), (F.col("p_size") % 7).cast("string"), F.lit(" CON -"), (F.col("p_size") % 5).cast("string"), F.lit("\nDEF "), (F.col("p_size") + 10).cast("string"), F.lit(" PV 12\nEpée +"), (F.col("p_size") + 2).cast("string"), F.lit(" · DM 2d6+"), (F.col("p_size") % 9 + 1).cast("string"), F.lit(" "), F.substring(s, 1, 0))
    p = table(spark, d, "part").select("p_partkey", text.alias("t"))
    m, a = statblocks.attributes(F.col("t")), F.get(statblocks.attacks(F.col("t")), F.lit(0))
    return p.select("p_partkey", F.try_element_at(m, F.lit("AGI")).alias("agi"), F.try_element_at(m, F.lit("CON")).alias("con"), statblocks.combat(F.col("t"))["defense"].alias("defense"), a["attack_bonus"].alias("attack_bonus"), a["damage"].alias("damage"))


@query(r"SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'armor class|hit points|\bac\s*\d+|\bhp\s*\d+') THEN 'stat_block' WHEN regexp_matches(text, '\|[^|\n]+\|') THEN 'stat_block' WHEN contains(lower(text), 'secret') OR contains(lower(text), 'gm only') THEN 'secret' WHEN contains(lower(text), 'clue') THEN 'clue' WHEN contains(lower(text), 'handout') THEN 'handout' WHEN contains(left(lower(text), 200), 'map') THEN 'map' ELSE 'lore' END AS hint FROM documents")
def chunk_type_hint(spark, d):
    return table(spark, d, "documents").select("doc_id", statblocks.type_hint(F.col("text")).alias("hint"))


SPOILERS = ("that", "with", "is")


@query("SELECT conv_id::VARCHAR AS conv_id, turn, CASE WHEN contains(lower(text), 'that') THEN 'that' WHEN contains(lower(text), 'with') THEN 'with' WHEN contains(lower(text), 'is') THEN 'is' END AS hit FROM conversations")
def spoiler_scan(spark, d):
    return table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("conv_id"), "turn", T.first_keyword(F.col("text"), SPOILERS).alias("hit"))


@query("""SELECT code, target_type, severity, count(*) AS n FROM (
 SELECT 'missing_source_ref' AS code, 'entity' AS target_type, 'error' AS severity FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
 UNION ALL SELECT 'unknown_chunk_id', 'entity', 'error' FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size <= 25)
 UNION ALL SELECT 'invalid_chunk_type', 'chunk', 'error' FROM customer WHERE c_custkey % 4 = 1
 UNION ALL SELECT 'invalid_confidence', 'entity', 'error' FROM events WHERE value NOT BETWEEN 0 AND 1
 UNION ALL SELECT 'player_safe_spoiler', 'entity', 'error' FROM documents WHERE regexp_matches(lower(text), 'secret|gm only|gm-only|hidden truth|behind the scenes|actually|in truth|cult leader|true identity|\\bthe truth is\\b')
 UNION ALL SELECT 'relation_missing_source_ref', 'relation', 'warning' FROM orders WHERE o_orderpriority = '5-LOW') GROUP BY ALL""")
def validate_all(spark, d):
    o, line = table(spark, d, "orders"), table(spark, d, "lineitem")
    found = [
        semantic.without_refs(o, line, "o_orderkey", "l_orderkey"),
        semantic.unknown_refs(line, table(spark, d, "part").where("p_size <= 25"), "l_orderkey", "l_partkey", "p_partkey"),
        semantic.bad_labels(table(spark, d, "customer").withColumn("label", F.element_at(F.array(*map(F.lit, ("faction", "introduction", "lore", "npc"))), (F.col("c_custkey") % 4 + 1).cast("int"))), "c_custkey", "label"),
        semantic.bad_confidence(table(spark, d, "events"), "event_id", "value", "entity"),
        semantic.spoilers(table(spark, d, "documents"), "doc_id", F.col("text")),
        semantic.relations_without_refs(o.withColumn("refs", F.when(F.col("o_orderpriority") != "5-LOW", F.array(F.lit(1)))), "o_orderkey", "refs"),
    ]
    return semantic.validate(found).groupBy("code", "target_type", "severity").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5('7|' || doc_id), doc_id) <= 5")
def seeded_sample(spark, d):
    return catalog.sample(table(spark, d, "documents").select("source", "doc_id"), ["source"], "doc_id", 7, 5)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE o_orderstatus END AS status, o_totalprice FROM orders")
def upsert_merge(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), "o_totalprice")
    new = o.where("o_orderkey % 3 = 0").withColumn("status", F.lit("new"))
    return catalog.upsert(o.where("o_orderkey % 5 <> 0"), new, ["o_orderkey"]).unionByName(o.where("o_orderkey % 5 = 0 AND o_orderkey % 3 <> 0"))


@query("WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z0-9]+)', 1)) AS tag FROM pages WHERE html IS NOT NULL) SELECT page_id, tag, count(*) AS n FROM t GROUP BY ALL")
def html_flatten(spark, d):
    tags = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<([a-z0-9]+)"), F.lit(1))).alias("tag"))
    return tags.groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n"))


@query("WITH t AS (SELECT DISTINCT t FROM (SELECT p_type AS t FROM part UNION ALL SELECT left(p_type, 7) FROM part)) SELECT a.t FROM t a WHERE upper(a.t) = a.t AND len(string_split(a.t, ' ')) <= 4 AND length(a.t) < 25 AND NOT EXISTS (SELECT 1 FROM t b WHERE b.t <> a.t AND starts_with(b.t, a.t))")
def truncated_titles(spark, d):
    p = table(spark, d, "part").select(F.col("p_type").alias("t"))
    return audit.truncated_titles(p.unionByName(p.select(F.substring("t", 1, 7).alias("t"))), "t")


@query("WITH s AS (SELECT 'n' || n_nationkey AS id, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 'r' || r_regionkey, NULL FROM region), c AS (SELECT DISTINCT 'n' || s_nationkey AS id FROM supplier WHERE s_acctbal > 9000) SELECT id FROM s WHERE id NOT IN (SELECT id FROM c) AND NOT EXISTS (SELECT 1 FROM s k JOIN c USING (id) WHERE k.parent = s.id)")
def empty_sections(spark, d):
    s = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent")).unionByName(table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent")))
    c = table(spark, d, "supplier").where("s_acctbal > 9000").select(F.concat(F.lit("n"), "s_nationkey").alias("section"))
    return audit.empty_sections(s, c, "id", "parent", "section").select("id")


@query(f"WITH {BLOCKS} SELECT document, count(*) AS orphans, CASE WHEN count(*) > 3 THEN 'major' ELSE 'minor' END AS severity FROM (SELECT document, page || ':' || block_index AS b FROM boxes WHERE is_bold) GROUP BY 1")
def orphan_blocks(spark, d):
    b = _blocks(spark, d).withColumn("b", F.concat_ws(":", "page", "block_index"))
    return audit.orphan_blocks(b, b.where("NOT is_bold"), "document", "b").select("document", "orphans", "severity")


@query("SELECT c_custkey, replace(replace(c_name, '#', '-'), ' ', '-') AS x, regexp_matches(lower(replace(c_name, '#', '-')), '^[a-z0-9][a-z0-9_-]{0,63}$') AS slug, 'doc_' || substr(sha256(c_name), 1, 12) AS id FROM customer")
def slugs_and_ids(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.replace(F.replace("c_name", F.lit("#"), F.lit("-")), F.lit(" "), F.lit("-")).alias("x"), T.is_slug(F.lower(F.replace("c_name", F.lit("#"), F.lit("-")))).alias("slug"), ids.document_id(F.col("c_name").cast("binary")).alias("id"))


@query("SELECT r_regionkey, r_name FROM region WHERE r_regionkey <> 2")
def cascade_delete(spark, d):
    r = table(spark, d, "region")
    return catalog.cascade_delete({"region": (r, "r_regionkey")}, r.where("r_regionkey = 2").select("r_regionkey"))["region"]


@query("SELECT c_custkey, coalesce(CASE WHEN c_custkey % 2 = 0 THEN 'GAMES' END, c_mktsegment) AS c_mktsegment FROM customer")
def partial_update(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return catalog.update_fields(c, c.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, "GAMES").alias("c_mktsegment")), "c_custkey")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


from quire.plans import layouts, relations, scalars  # noqa: E402, F401 (they register more queries)
