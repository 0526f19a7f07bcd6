"""Headline queries, timed. Prints one JSON line; BENCH_SF_DIR and BENCH_CPUS choose tables and cores."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from siltstone import catalogue

HEADLINE = (
    "f_and_or_not t_phrase t_postings r_knn_cosine r_knn_filtered r_order_desc r_bm25 r_bm25_stemmed r_sparse r_rrf_hybrid "
    "r_ann_nprobe8 a_group_multi a_foreach_unique a_rank_with_facets m_patch m_compaction_equiv s_stream_fold"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalogue.QUERIES["f_eq"](spark, sf_dir).count()  # start-up is not measured
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
