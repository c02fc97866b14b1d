"""The engine's query surface: one method for each thing a client can ask, over the relational tables.

`tables` maps table names (campaigns, documents, ingestion_runs, pages, page_blocks, sections, chunks, entities,
entity_source_refs, entity_relations) to DataFrames. Every method returns a DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import catalog, semantic
from quire.sources.layout import layout_nodes

#: What a client may import; fixed values.
GAME_SYSTEMS = ("cof2",)
#: Details of a structured block, each present only where its key is; fixed values.
DETAIL_FIELDS = ("name", "subtitle", "nc", "attributes", "defense", "vigor", "initiative", "mana", "attacks", "abilities", "rulebook_reference", "raw_text")


class Engine:
    def __init__(self, tables: dict[str, DataFrame]):
        self.tables = tables

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    # listings
    def list_campaigns(self) -> DataFrame:
        out = catalog.with_counts(self["campaigns"], self["documents"], "id", "campaign_id", "document_count")
        return out.orderBy(F.col("updated_at").desc(), "id")

    def list_documents(self, campaign: str | None = None) -> DataFrame:
        docs = self["documents"] if campaign is None else self["documents"].where(F.col("campaign_id") == campaign)
        out = catalog.with_counts(docs, self["sections"], "id", "document_id", "section_count")
        out = catalog.with_counts(out, self["chunks"], "id", "document_id", "chunk_count")
        runs = catalog.latest(self["ingestion_runs"].where("stage = 'raw'"), ["document_id"], ["started_at", "id"], ["id", "status"])
        return out.join(runs.select(F.col("document_id").alias("id"), F.col("id").alias("latest_run_id"), F.col("status").alias("latest_run_status")), "id", "left").orderBy("created_at", "id")

    def list_sections(self, document: str) -> DataFrame:
        return self["sections"].where(F.col("document_id") == document).orderBy("page_start", "level", "title")

    def list_chunks(self, document: str, first: int | None = None, last: int | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
        rows = self["chunks"].where(F.col("document_id") == document)
        if first is not None:
            rows = rows.where(F.col("page_end") >= first)
        if last is not None:
            rows = rows.where(F.col("page_start") <= last)
        return catalog.page_of(rows, ["page_start", "id"], limit, offset)

    def chunks_of_sections(self, sections: list[str]) -> DataFrame:
        return catalog.in_list(self["chunks"], "section_id", sections).orderBy("page_start", "id")

    def sections_with_chunks(self, document: str) -> DataFrame:
        return self["chunks"].where((F.col("document_id") == document) & F.col("section_id").isNotNull()).select("section_id").distinct()

    def get(self, table: str, key: str) -> DataFrame:
        return self[table].where(F.col("id") == key)

    def latest_raw_run(self, document: str) -> DataFrame:
        runs = self["ingestion_runs"].where((F.col("document_id") == document) & (F.col("stage") == "raw") & (F.col("status") == "completed"))
        return runs.orderBy(F.col("started_at").desc(), "id").limit(1)

    def source_path(self, document: str) -> DataFrame:
        """The source file that the latest completed run names."""
        return self.latest_raw_run(document).select(F.coalesce(F.get_json_object("stats", "$.source_pdf_path"), F.get_json_object("stats", "$['source-pdf-path']")).alias("path"))

    # pages
    def page(self, document: str, number: int) -> DataFrame:
        return self["pages"].where((F.col("document_id") == document) & (F.col("page_number") == number))

    def page_blocks(self, document: str, number: int) -> DataFrame:
        return self["page_blocks"].where((F.col("document_id") == document) & (F.col("page_number") == number)).orderBy("block_index")

    def page_nodes(self, document: str, number: int, level: str | None = None) -> DataFrame:
        return layout_nodes(self.page(document, number), ["document_id", "page_number"], "raw_layout", level)

    def excerpt(self, block_ids: list[str]) -> DataFrame:
        return catalog.in_list(self["page_blocks"], "id", block_ids).select("id", "page_number", "block_index", "text", "bbox").orderBy("page_number", "block_index")

    def page_count_mismatch(self, left: str = "pymupdf", right: str = "pdfbox") -> DataFrame:
        """Pages that only one extractor's lane has."""
        lane = F.regexp_extract("id", "^([a-z]+)_", 1)
        key = self["page_blocks"].withColumn("_lane", lane).where(F.col("_lane").isin(left, right)).select("document_id", "page_number", "_lane").distinct()
        return key.groupBy("document_id", "page_number").agg(F.array_sort(F.collect_set("_lane")).alias("lanes")).where(F.size("lanes") < 2)

    # structured blocks
    def list_stat_blocks(self, document: str) -> DataFrame:
        rows = self["chunks"].where(F.col("document_id") == document)
        field = lambda n: F.get_json_object("metadata", f"$.stat_block.{n}")
        out = rows.select("id", "section_id", "page_start", field("name").alias("name"), field("subtitle").alias("subtitle"), field("nc").alias("nc_raw"), T.number_or_null(field("nc")).alias("nc"), field("rulebook_reference").isNotNull().alias("uses_rulebook"), T.preview(F.col("text")).alias("preview"))
        return out.where("name <> ''").orderBy("page_start", "id")

    def stat_block(self, document: str, name: str) -> DataFrame:
        """Rows that the name finds (by looked-up or folded name and subtitle), with how many they are: 0 unknown, more than 1 ambiguous."""
        rows = self["chunks"].where(F.col("document_id") == document)
        field = lambda n: F.get_json_object("metadata", f"$.{n}")
        keyed = rows.withColumns({"_n": F.coalesce(field("_lookup_name"), field("stat_block.name")), "_s": F.coalesce(field("_lookup_subtitle"), field("stat_block.subtitle"))}).where("_n IS NOT NULL")
        return catalog.lookup(keyed, ["_n", "_s"], F.lit(name), T.fold_key, "id").drop("_n", "_s").orderBy("page_start", "id")

    def stat_block_detail(self, chunk: str) -> DataFrame:
        rows = self.get("chunks", chunk)
        return rows.select("id", *(F.get_json_object("metadata", f"$.stat_block.{f}").alias(f) for f in DETAIL_FIELDS), F.coalesce(F.get_json_object("metadata", "$.stat_block.game_system"), F.lit(GAME_SYSTEMS[0])).alias("game_system"))

    # semantic layer
    def list_entities(self, campaign: str, kind: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
        rows = self["entities"].where(F.col("campaign_id") == campaign)
        return catalog.page_of(rows if kind is None else rows.where(F.col("type") == kind), ["name", "id"], limit, offset)

    def entity(self, key: str) -> DataFrame:
        refs = self["entity_source_refs"].groupBy(F.col("entity_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("page_number", F.col("id").alias("ref_id"), "chunk_id"))).alias("source_refs"))
        return self.get("entities", key).join(refs, "id", "left")

    def relations_of(self, entity: str) -> DataFrame:
        r = self["entity_relations"]
        return catalog.edges_of(r, "from_entity_id", "relation_type", "to_entity_id").where(F.col("entity") == entity).orderBy("direction", "kind", "other")

    def player_safe(self, campaign: str) -> DataFrame:
        return self["entities"].where(F.col("campaign_id") == campaign).select("id", "player_safe", "gm_only")

    def semantic_summary(self, campaign: str) -> DataFrame:
        mine = lambda t: self[t].where(F.col("campaign_id") == campaign)
        c = mine("chunks").agg(F.count(F.lit(1)).alias("chunks"), F.count("chunk_type").alias("classified"))
        e = mine("entities").agg(F.count(F.lit(1)).alias("entities"), F.count_if(F.col("confidence") < semantic.LOW_CONFIDENCE).alias("needs_review"))
        return c.crossJoin(e).crossJoin(mine("entity_relations").agg(F.count(F.lit(1)).alias("relations")))

    def validate(self, campaign: str) -> DataFrame:
        mine = lambda t: self[t].where(F.col("campaign_id") == campaign)
        entities, chunks, relations = mine("entities"), mine("chunks"), mine("entity_relations")
        refs = self["entity_source_refs"].join(entities.select(F.col("id").alias("entity_id")), "entity_id", "left_semi")
        blocks = refs.where(F.size("page_block_ids") > 0).join(self["chunks"].select(F.col("id").alias("chunk_id"), F.col("document_id").alias("_doc")), "chunk_id")
        flat = blocks.select("entity_id", "_doc", F.explode("page_block_ids").alias("_block"))
        lost = flat.join(self["page_blocks"].select(F.col("document_id").alias("_doc"), F.col("id").alias("_block")), ["_doc", "_block"], "left_anti")
        known = self["entities"].select("id")
        ends = catalog.unknown_endpoints(relations, "from_entity_id", "to_entity_id", known, known)
        rel_refs = relations.select("id", F.explode("source_refs").alias("r")).select("id", F.col("r.chunk_id").alias("chunk_id")).where("chunk_id <> ''")
        return semantic.validate([
            semantic.without_refs(entities, self["entity_source_refs"], "id", "entity_id"), semantic.unknown_refs(refs, self["chunks"], "entity_id", "chunk_id", "id"),
            semantic.finding(lost, "unknown_page_block_id", "entity", "entity_id", F.col("_block")), semantic.bad_labels(chunks, "id", "chunk_type"),
            semantic.bad_confidence(chunks.select("id", F.get_json_object("metadata", "$.classification_confidence").try_cast("double").alias("c")), "id", "c", "chunk"), semantic.bad_confidence(entities, "id", "confidence", "entity"),
            semantic.bad_confidence(relations, "id", "confidence", "relation"), semantic.unknown_entities(ends, "id"), semantic.spoilers(entities, "id", F.col("player_safe")),
            semantic.relations_without_refs(relations, "id", "source_refs"), semantic.unknown_refs(rel_refs, self["chunks"], "id", "chunk_id", "id", "relation"),
        ])

    # writes: each gives the engine with its tables replaced
    def _with(self, **changed: DataFrame) -> Engine:
        return Engine({**self.tables, **changed})

    def ensure_campaign(self, rows: DataFrame) -> Engine:
        return self._with(campaigns=catalog.insert_absent(self["campaigns"], rows, ["id"]))

    def upsert(self, table: str, rows: DataFrame) -> Engine:
        keys = ["document_id", "page_number"] if table == "pages" else ["id"]
        return self._with(**{table: catalog.upsert(self[table], rows, keys, ("campaign_id",) if table == "documents" else ())})

    def submit_classifications(self, rows: DataFrame) -> Engine:
        return self._with(chunks=catalog.update_fields(self["chunks"], rows.select("id", "chunk_type"), "id"))

    def submit_entities(self, entities: DataFrame, refs: DataFrame) -> Engine:
        """Entities replaced by id, and all references of the submitted ones by the new ones."""
        kept = self["entity_source_refs"].join(entities.select(F.col("id").alias("entity_id")), "entity_id", "left_anti")
        return self._with(entities=catalog.upsert(self["entities"], entities, ["id"]), entity_source_refs=kept.unionByName(refs.select(*kept.columns)))

    def submit_relations(self, rows: DataFrame) -> Engine:
        return self._with(entity_relations=self["entity_relations"].unionByName(rows))

    def update_run(self, rows: DataFrame) -> Engine:
        return self._with(ingestion_runs=catalog.update_fields(self["ingestion_runs"], rows, "id"))

    def delete_campaign(self, campaign: str) -> Engine:
        gone = self["campaigns"].where(F.col("id") == campaign).select("id")
        own = {t: (self[t], "id" if t == "campaigns" else "campaign_id") for t in self.tables if t == "campaigns" or "campaign_id" in self[t].columns}
        docs = self["documents"].where(F.col("campaign_id") == campaign).select("id")
        by_doc = {t: (self[t], "document_id") for t in ("pages", "page_blocks") if t in self.tables}
        return self._with(**catalog.cascade_delete(own, gone), **catalog.cascade_delete(by_doc, docs))

    def delete_raw(self, document: str) -> Engine:
        return self._with(**{t: self[t].where(F.col("document_id") != document) for t in ("chunks", "sections", "page_blocks", "pages")})

    def delete_lanes(self, document: str) -> Engine:
        return self._with(page_blocks=catalog.without_prefix(self["page_blocks"], "id", [f"pymupdf_{document}_", f"pdfbox_{document}_"]))


def check_upload(rows: DataFrame, longest: int = 50 << 20) -> DataFrame:
    """Import requests (campaign, game_system, filename, content_type, size) with the first reason to refuse each, and a safe name."""
    reason = (
        F.when(~T.is_slug(F.col("campaign")), "campaign").when(~F.col("game_system").isin(*GAME_SYSTEMS), "game_system").when(~(F.lower("filename").endswith(".pdf") | (F.col("content_type") == "application/pdf")), "type")
        .when(F.col("size") <= 0, "empty").when(F.col("size") > longest, "size")
    )
    return rows.withColumns({"refused": reason, "safe_name": T.safe_filename(F.col("filename"))})


def import_mode_tables(mode: str) -> tuple[str, ...]:
    """The tables that an import of this mode writes."""
    modes = {"full": ("pages", "page_blocks", "sections", "chunks"), "layout_only": ("pages", "page_blocks"), "extractor_compare": ("page_blocks",)}
    if mode not in modes:
        raise ValueError(f"unknown mode {mode!r}")
    return modes[mode]
