"""Queries of catalogue, semantic and audit operators over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import catalog, chunks, semantic
from quire.plans.catalogue import query
from quire.sources.tables import table


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 2 = 0 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1 UNION ALL SELECT c_custkey, NULL, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0)")
def upsert_last_wins(spark, d):
    """Customers with an opening row, replaced by their last even order."""
    old = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.lit(None).cast("long").alias("o_orderkey"), F.col("c_acctbal").alias("o_totalprice"), F.lit(None).cast("date").alias("at"))
    o = table(spark, d, "orders").where("o_orderkey % 2 = 0")
    new = o.select("o_custkey", "o_orderkey", "o_totalprice", F.col("o_orderdate").alias("at"))
    return catalog.upsert(old.withColumn("at", F.col("at").cast(new.schema["at"].dataType)), new, ["o_custkey"], order="at").drop("at")


@query("SELECT c_custkey AS id, 'customer' AS what FROM customer UNION ALL SELECT s_suppkey, 'supplier' FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer)")
def insert_if_absent(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("customer").alias("what"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("supplier").alias("what"))
    return catalog.insert_absent(c, s.unionByName(s), ["id"])


@query("WITH n AS (SELECT 'r' || r_regionkey AS id, r_name AS ordinal, 0 AS depth FROM region UNION ALL SELECT 'n' || n_nationkey, n_name, 1 FROM nation UNION ALL SELECT 's' || s_suppkey, s_name, 2 FROM supplier) SELECT id, depth, row_number() OVER (ORDER BY depth, ordinal, id) - 1 AS place FROM n")
def parent_first_order(spark, d):
    r = table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("ordinal"))
    n = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"), "n_name")
    s = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey"), F.concat(F.lit("n"), "s_nationkey"), "s_name")
    return catalog.parents_first(r.union(n).union(s), "id", "parent", "ordinal").select("id", "depth", "place")


LANES = "concat('lane_', CAST(p_size AS VARCHAR(20)), CASE WHEN p_partkey % 2 = 0 THEN '_' ELSE 'x' END, CAST(p_partkey AS VARCHAR(20)))"


@query(f"SELECT p_partkey, {LANES} AS id FROM part WHERE NOT starts_with({LANES}, 'lane_1_') AND NOT starts_with({LANES}, 'lane%2')")
def prefix_delete(spark, d):
    return catalog.without_prefix(table(spark, d, "part").select("p_partkey", F.expr(LANES).alias("id")), "id", ["lane_1_", "lane%2"])


@query("SELECT r_name, count(DISTINCT n_nationkey) AS documents, count(c_custkey) AS chunks, count(c_custkey) FILTER (WHERE c_acctbal < 0) AS needs_review FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def campaign_rollup(spark, d):
    """Documents (nations) and chunks (customers) of each campaign (region), those to review among them."""
    per = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("c_acctbal") < 0).alias("needs_review"))
    return catalog.rolled_up(table(spark, d, "region"), table(spark, d, "nation").join(per, "n_nationkey", "left"), "r_regionkey", "n_regionkey", "documents", ["chunks", "needs_review"]).select("r_name", "documents", "chunks", "needs_review")


@query("SELECT count(DISTINCT source) AS documents, count(DISTINCT (source, doc_id)) AS pages, count(*) AS blocks, count(*) FILTER (WHERE length(line) = 1) AS one_char, count(*) FILTER (WHERE length(line) > 400) AS needs_rechunk, coalesce(sum(length(line)), 0)::BIGINT AS chars FROM (SELECT source, doc_id, unnest(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\S'))) AS line FROM documents)")
def run_statistics(spark, d):
    from quire.plans.catalogue import _blocks

    return catalog.run_statistics(_blocks(spark, d), 400)


@query("SELECT l_orderkey, string_agg(DISTINCT p::VARCHAR, ',' ORDER BY p::VARCHAR) AS pages FROM (SELECT l_orderkey, unnest([l_linenumber::BIGINT, l_linenumber::BIGINT + 1, l_quantity::BIGINT]) AS p FROM lineitem) GROUP BY 1")
def page_union(spark, d):
    """The pages that a section or a chunk of an order names."""
    rows = table(spark, d, "lineitem").select("l_orderkey", F.array(F.col("l_linenumber").cast("long"), F.col("l_linenumber").cast("long") + 1).alias("a"), F.array(F.col("l_quantity").cast("long")).alias("b"))
    return catalog.united(rows, ["l_orderkey"], ["a", "b"]).select("l_orderkey", F.array_join(F.array_sort(F.transform("members", lambda x: x.cast("string"))), ",").alias("pages"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE p_name END AS a, CASE WHEN p_partkey % 2 = 1 THEN p_type END AS b, p_name AS c FROM part")
def metadata_merge(spark, d):
    p = table(spark, d, "part")
    old = F.create_map(F.lit("a"), F.col("p_name"), F.lit("b"), F.col("p_type"))
    new = F.create_map(F.lit("c"), F.col("p_name"), F.lit("b2"), F.lit(None).cast("string"))
    new = F.when(F.col("p_partkey") % 3 == 0, F.map_concat(new, F.create_map(F.lit("a"), F.col("p_brand")))).otherwise(new)
    new = F.when(F.col("p_partkey") % 2 == 0, F.map_concat(new, F.create_map(F.lit("b"), F.lit(None).cast("string")))).otherwise(new)
    m = p.select("p_partkey", catalog.merged_maps(old, new).alias("m"))
    return m.where(F.size("m") <= 3).select("p_partkey", *(F.try_element_at("m", F.lit(k)).alias(k) for k in "abc"))


@query("SELECT p_partkey, p_name, strip_accents(lower(trim(p_name))) AS lookup_name, CASE WHEN p_partkey % 3 = 0 THEN lower(p_brand) END AS lookup_subtitle FROM part")
def metadata_enrichment(spark, d):
    p = table(spark, d, "part").withColumn("stat_block", F.struct(F.concat(F.lit(" "), F.upper("p_name")).alias("name"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).otherwise("  ").alias("subtitle")))
    e = catalog.with_lookup_keys(p, "stat_block", T.fold_key)
    return e.select("p_partkey", "p_name", "stat_block._lookup_name", "stat_block._lookup_subtitle").toDF("p_partkey", "p_name", "lookup_name", "lookup_subtitle")


@query("SELECT o_orderkey AS target_id, string_agg(m::VARCHAR, ',' ORDER BY m) AS message, 'unknown_page_block_id' AS code, 'error' AS severity FROM (SELECT o_orderkey, unnest(range(1, 5)) AS m FROM orders) r WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = m) GROUP BY 1")
def unknown_page_blocks(spark, d):
    refs = table(spark, d, "orders").select("o_orderkey", F.col("o_orderkey").alias("document"), F.sequence(F.lit(1), F.lit(4)).alias("ids"))
    out = semantic.unknown_blocks(refs, "o_orderkey", "document", "ids", table(spark, d, "lineitem"), "l_orderkey", "l_linenumber")
    return out.select(F.col("target_id").cast("long").alias("target_id"), "message", "code", "severity")


@query("""SELECT code, target_type, count(*) AS n FROM (SELECT 'invalid_confidence' AS code, 'chunk' AS target_type FROM part WHERE p_size / 40.0 > 1 UNION ALL SELECT 'invalid_confidence', 'entity' FROM supplier WHERE s_acctbal / 5000 NOT BETWEEN 0 AND 1 UNION ALL SELECT 'invalid_confidence', 'relation' FROM lineitem WHERE l_discount * 12 > 1
 UNION ALL SELECT 'unknown_chunk_id', 'relation' FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 40) UNION ALL SELECT 'unknown_entity_in_relation', 'relation' FROM nation WHERE n_regionkey IN (3, 4) OR n_nationkey % 5 = 0) GROUP BY ALL""")
def validate_values(spark, d):
    line, nation = table(spark, d, "lineitem"), table(spark, d, "nation")
    ends = catalog.unknown_endpoints(nation, "n_regionkey", "n_nationkey", table(spark, d, "region").where("r_regionkey < 3").select("r_regionkey"), nation.where("n_nationkey % 5 <> 0").select("n_nationkey"))
    found = [
        semantic.bad_confidence(table(spark, d, "part").withColumn("v", F.col("p_size") / 40.0), "p_partkey", "v", "chunk"),
        semantic.bad_confidence(table(spark, d, "supplier").withColumn("v", F.col("s_acctbal") / 5000), "s_suppkey", "v", "entity"),
        semantic.bad_confidence(line.withColumn("v", F.col("l_discount") * 12), "l_orderkey", "v", "relation"),
        semantic.unknown_refs(line, table(spark, d, "part").where("p_size <= 40"), "l_orderkey", "l_partkey", "p_partkey", "relation"),
        semantic.unknown_entities(ends, "n_nationkey"),
    ]
    return semantic.validate(found).groupBy("code", "target_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT (SELECT count(*) FROM customer WHERE c_custkey % 4 = 1) = 0 AS valid, (SELECT count(*) FROM customer WHERE c_custkey % 4 = 1) AS errors, (SELECT count(*) FROM orders WHERE o_orderpriority = '5-LOW') AS warnings")
def validation_verdict(spark, d):
    labels = F.element_at(F.array(*map(F.lit, ("faction", "introduction", "lore", "npc"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    found = [semantic.bad_labels(table(spark, d, "customer").withColumn("label", labels), "c_custkey", "label"), semantic.relations_without_refs(table(spark, d, "orders").withColumn("refs", F.when(F.col("o_orderpriority") != "5-LOW", F.array(F.lit(1)))), "o_orderkey", "refs")]
    return semantic.verdict(semantic.validate(found))


@query("SELECT 'chunk' AS kind, unnest(['location', 'npc', 'faction', 'scene', 'encounter', 'clue', 'secret', 'item', 'handout', 'map', 'stat_block', 'lore', 'rule', 'table', 'other']) AS label UNION ALL SELECT 'entity', unnest(['location', 'npc', 'faction', 'scene', 'encounter', 'secret', 'clue', 'item', 'monster', 'organization', 'timeline_event', 'handout', 'rule_reference']) UNION ALL SELECT 'relation', unnest(['located_in', 'contains', 'knows_secret', 'reveals', 'points_to', 'requires', 'unlocks', 'opposes', 'serves', 'member_of', 'appears_in', 'connected_to', 'caused_by', 'threatens'])")
def label_enums(spark, d):
    lists = {"chunk": semantic.CHUNK_TYPES, "entity": semantic.ENTITY_TYPES, "relation": semantic.RELATION_TYPES}
    return spark.createDataFrame([(k, x) for k, v in lists.items() for x in v], "kind string, label string")


@query("SELECT d.doc_id FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE toxic IS NULL OR d.doc_id % 10 < 5")
def review_queue(spark, d):
    chunks_ = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 10 / 10.0).alias("c")).join(table(spark, d, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return semantic.review_queue(chunks_, "toxic", "c").select("doc_id")


@query("SELECT s_suppkey, s_name, s_nationkey FROM supplier WHERE s_acctbal > 0")
def player_safe_entities(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal", F.when(F.col("s_acctbal") > 0, True).alias("safe"))
    return semantic.player_safe(s, "safe", ("s_acctbal", "safe"))


@query("SELECT d.doc_id, coalesce(CASE WHEN quality = 1 THEN 'lore' ELSE 'other' END, 'none') AS chunk_type, coalesce(toxic::DOUBLE, 0.5) AS confidence FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE quality IS NOT NULL UNION ALL SELECT d.doc_id, 'none', 0.5 FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels WHERE quality IS NOT NULL)")
def classification_update(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.lit("none").alias("chunk_type"), F.lit(0.5).alias("confidence"))
    labels = table(spark, d, "labels").where("quality IS NOT NULL").select("doc_id", F.when(F.col("quality") == 1, "lore").otherwise("other").alias("chunk_type"), F.col("toxic").cast("double").alias("confidence"))
    return semantic.classify(docs, labels, ["doc_id"])


@query("SELECT l_orderkey, l_linenumber, max(s) AS section FROM (SELECT l_orderkey, l_linenumber, s FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) CROSS JOIN (VALUES (0, 1, 3), (1, 3, 4), (2, 6, 6)) v(s, a, b) WHERE l_linenumber BETWEEN a AND b UNION ALL SELECT l_orderkey, l_linenumber, NULL FROM lineitem) GROUP BY 1, 2")
def page_range_assignment(spark, d):
    b = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("document"), F.col("l_linenumber").alias("page"), F.col("l_linenumber").alias("block_index")).distinct()
    s = b.select("document").distinct().withColumn("_s", F.explode(F.array(*(F.struct(F.lit(i).alias("section"), F.lit(x).alias("page_start"), F.lit(y).alias("page_end")) for i, x, y in ((0, 1, 3), (1, 3, 4), (2, 6, 6)))))).select("document", "_s.*")
    return chunks.assign_by_page(b, s).select(F.col("document").alias("l_orderkey"), F.col("page").alias("l_linenumber"), "section")


@query("SELECT DISTINCT o_orderpriority AS section FROM orders WHERE o_orderstatus IN ('F', 'P')")
def distinct_sections(spark, d):
    return catalog.in_list(table(spark, d, "orders"), "o_orderstatus", ["F", "P"]).select(F.col("o_orderpriority").alias("section")).distinct()


@query("SELECT c_custkey, c_name, count(o_orderkey) AS refs, min(o_orderkey) AS first FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL")
def entities_with_refs(spark, d):
    e = catalog.nested(table(spark, d, "customer").select("c_custkey", "c_name"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey"), "c_custkey", "refs")
    return e.select("c_custkey", "c_name", F.size("refs").cast("long").alias("refs"), F.get("refs.o_orderkey", F.lit(0)).alias("first"))
