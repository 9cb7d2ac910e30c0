"""Seconds of each headline query: the median of three runs after one to warm up, written to Spark's no-op sink."""

import json
import os
import time

from pyspark.sql import SparkSession

from laborline.queries import QUERIES

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "ranked_distribution", "multi_valued_distribution", "price_stats", "mode_and_top2", "degree_gate", "must_preferred_split", "core_selection_capped", "first_k_per_group",
    "salary_parse", "date_standardize", "layered_dedup", "clean_html", "three_way_decision", "evidence_sentence", "graph_edges", "representative_paths", "student_job_ranking",
    "ability_gap", "profile_scores", "cosine_topk", "hash_embedding", "event_windows", "semi_anti_gap", "backfill_keys",
]


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    seconds = {}
    for name in HEADLINE:
        times = []
        for _ in range(4):
            began = time.time()
            QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            times.append(time.time() - began)
        seconds[name] = round(sorted(times[1:])[1], 4)
    spark.stop()
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": SF_DIR.rsplit("sf", 1)[-1], "cores": int(CPUS)}))


if __name__ == "__main__":
    main()
