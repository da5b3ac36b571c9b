"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from gneiss.plans.catalogue import QUERIES

HEADLINE = [
    "tokenize_distinct", "document_frequency", "term_rarity_points", "topk_components", "mrr", "edge_dedup_best_evidence", "graph_merge_upsert",
    "top_level_components", "depth1_expansion", "transitive_dependents", "snapshot_diff", "longest_prefix_owner", "evidence_validation", "policy_compliance", "outbound_regex_counts",
    "bounded_running_allocation", "greedy_budget_pack", "topn_with_remainder", "integrity_summary",
]


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["file_inventory"](spark, folder).write.format("noop").mode("overwrite").save()  # start the JVM's pools
    took, failed = {}, {}
    for name in HEADLINE:
        began = time.perf_counter()
        try:
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            took[name] = round(time.perf_counter() - began, 3)
        except Exception as e:  # timings of the others are still worth having
            failed[name] = str(e).splitlines()[0][:200]
    line = {"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": folder.rsplit("sf", 1)[-1]}
    print(json.dumps(line | ({"failed": failed} if failed else {})), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
