"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from quire.plans import catalogue

HEADLINE = (
    "coverage_by_source", "page_blocks_view", "repeated_line_watermarks", "heading_candidates", "spatial_sort", "list_parents_with_counts", "document_counts", "latest_run", "missing_refs_anti", "unknown_endpoints",
    "asof_preceding", "zone_theta_join", "best_iou_match", "greedy_pack", "fold_merge", "island_partition", "page_gap_split", "validate_all", "seeded_sample", "upsert_merge", "section_tree", "chunk_type_hint",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    catalogue.queries()["label_enums"](spark, folder).collect()  # start-up is not timed
    spark.read.parquet(f"{folder}/documents.parquet").groupBy("source").count().collect()
    seconds = {}
    for name in HEADLINE:
        began = time.time()
        catalogue.queries()[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(folder).removeprefix("sf")}))


if __name__ == "__main__":
    main()
