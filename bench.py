"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1) and BENCH_CPUS
the local cores. Every query is computed in full into the no-op sink.
"""

from __future__ import annotations

import json
import os
import time

from casebook.session import build_session
from casebook.suite import QUERIES

HEADLINE = [
    "incidents_per_year", "reports_per_year", "rolling_average", "risk_by_year_reports", "risk_by_year_incidents",
    "risk_heatmap_share", "attention_per_incident", "top_domains", "lorenz_curve", "country_reports", "network_table",
    "network_edges", "filtered_context", "kpi_summary", "incident_level", "label_frame", "classification_labels",
    "report_level_direct", "dedup_keep_first", "group_split_3way", "split_components", "modeling_frame", "normalize_text",
    "combine_text", "tokenize", "vocabulary", "tfidf", "cluster_keywords", "cluster_examples", "knn_examples",
    "classification_report", "kmeans_clusters", "train_text_classifier", "stream_report_counts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", **{
        "spark.master": f"local[{cpus}]",
        "spark.sql.shuffle.partitions": cpus,
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1).count()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
