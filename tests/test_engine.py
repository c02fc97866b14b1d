from quire.engine import Engine, check_upload, import_mode_tables


def engine(spark):
    t = lambda rows, schema: spark.createDataFrame(rows, schema)
    return Engine({
        "campaigns": t([("c", "T", 1), ("d", "U", 2)], "id string, title string, updated_at int"), "documents": t([("doc", "c", 1)], "id string, campaign_id string, created_at int"),
        "ingestion_runs": t([("r1", "doc", "raw", "completed", '{"source_pdf_path": "/a.pdf"}', 1), ("r2", "doc", "raw", "failed", "{}", 2)], "id string, document_id string, stage string, status string, stats string, started_at int"),
        "pages": t([("p", "doc", 1)], "id string, document_id string, page_number int"), "page_blocks": t([("b", "doc", 1, 0, "x", None), ("pdfbox_doc_1", "doc", 1, 1, "y", None)], "id string, document_id string, page_number int, block_index int, text string, bbox string"),
        "sections": t([("s", "c", "doc", 1, 1, "A")], "id string, campaign_id string, document_id string, page_start int, level int, title string"),
        "chunks": t([("k1", "c", "doc", "s", 1, 1, "texte", "lore", '{"stat_block": {"name": "Garde Noir", "nc": "1/2"}}'), ("k2", "c", "doc", None, 2, 3, "autre", "odd", '{"classification_confidence": 3}')], "id string, campaign_id string, document_id string, section_id string, page_start int, page_end int, text string, chunk_type string, metadata string"),
        "entities": t([("e1", "c", "npc", "A", 0.3, "the Secret", "{}"), ("e2", "c", "npc", "B", 0.9, "ok", "{}")], "id string, campaign_id string, type string, name string, confidence double, player_safe string, gm_only string"),
        "entity_source_refs": t([("x1", "e1", "k1", 1, ["b", "zz"]), ("x2", "e1", "nope", 1, [])], "id string, entity_id string, chunk_id string, page_number int, page_block_ids array<string>"),
        "entity_relations": t([("q", "c", "e1", "knows", "e9", 0.5, [])], "id string, campaign_id string, from_entity_id string, relation_type string, to_entity_id string, confidence double, source_refs array<struct<chunk_id:string>>"),
    })


def test_reads(spark):
    e = engine(spark)
    assert [(r["id"], r["document_count"]) for r in e.list_campaigns().collect()] == [("d", 0), ("c", 1)]
    d = e.list_documents().first()
    assert (d["section_count"], d["chunk_count"], d["latest_run_status"]) == (1, 2, "failed")
    assert e.source_path("doc").first()["path"] == "/a.pdf" and [r["id"] for r in e.list_chunks("doc", 2, 2).collect()] == ["k2"]
    s = e.list_stat_blocks("doc").collect()
    assert len(s) == 1 and s[0]["nc_raw"] == "1/2" and s[0]["nc"] is None and e.stat_block("doc", " GARDE noir").first()["matches"] == 1
    assert sorted(r["code"] for r in e.validate("c").collect()) == ["invalid_chunk_type", "invalid_confidence", "missing_source_ref", "player_safe_spoiler", "relation_missing_source_ref", "unknown_chunk_id", "unknown_entity_in_relation", "unknown_page_block_id"]
    assert tuple(e.semantic_summary("c").first()) == (2, 2, 2, 1, 1)


def test_writes(spark):
    e = engine(spark)
    gone = e.delete_campaign("c")
    assert gone["campaigns"].count() == 1 and all(gone[t].count() == 0 for t in ("documents", "pages", "page_blocks", "sections", "chunks", "entities", "entity_relations"))
    assert e.delete_lanes("doc")["page_blocks"].count() == 1 and e.delete_raw("doc")["chunks"].count() == 0
    moved = e.upsert("documents", spark.createDataFrame([("doc", "d", 9)], "id string, campaign_id string, created_at int"))["documents"].first()
    assert (moved["campaign_id"], moved["created_at"]) == ("c", 9)
    up = check_upload(spark.createDataFrame([("ok", "cof2", "a b.pdf", "x", 5), ("No", "cof2", "a.pdf", "x", 5), ("ok", "cof2", "a.txt", "x", 5)], "campaign string, game_system string, filename string, content_type string, size long")).collect()
    assert [r["refused"] for r in up] == [None, "campaign", "type"] and up[0]["safe_name"] == "a_b.pdf" and "sections" in import_mode_tables("full")
