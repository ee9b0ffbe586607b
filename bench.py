"""Times the headline graph queries; prints one JSON line. BENCH_SF_DIR and BENCH_CPUS set the input and the cores."""

from __future__ import annotations

import json
import os
import re
import time

from pyspark.sql import SparkSession

from hopgrid.plans.queries import QUERIES

HEADLINE = [
    "hop_one", "hop_chain_revenue", "hop_five_chain", "hop_incoming", "match_unique_edges", "match_theta", "optional_inner_where", "optional_two_hops", "exists_pattern",
    "count_subquery", "pattern_comprehension", "hops_trail", "hops_acyclic_from_zero", "aggregates", "collect_values", "order_skip_limit", "with_limit_then_where",
    "functions_text", "functions_time", "vector_cosine", "fulltext_bm25", "merge_partial_rows", "delete_detach", "relational_join", "colleagues_two_hop",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        best = 1e9
        for _ in range(2):  # the first run compiles code
            began = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best, time.time() - began)
        took[name] = round(best, 3)
    scale = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({"metric": "graph_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(scale[1]) if scale else None}))
    spark.stop()


if __name__ == "__main__":
    main()
