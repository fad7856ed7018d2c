"""Times the index build and the headline queries; prints one JSON line.

BENCH_SF_DIR is the folder of the tables, BENCH_CPUS the number of cores.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from sieveline import queries

HEADLINE = ["term", "conj", "disj", "nested", "phrase2", "phrase3", "neg", "conj_neg", "label", "neg_label", "field_group", "limit", "page2", "count_term", "count_complex", "term_stats", "tokens", "snippets"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.files.maxPartitionBytes", "4m")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/documents.parquet").limit(1).collect()  # starts the engine
    took: dict[str, float] = {}
    text_mb = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("sum(octet_length(text)) / 1e6 AS mb").first().mb

    def best(name: str, run, times: int = 2) -> None:
        for _ in range(times):
            began = time.perf_counter()
            run()
            took[name] = min(took.get(name, 1e9), round(time.perf_counter() - began, 3))

    best("index_build", lambda: queries.build_index(spark, sf_dir))
    index = queries.index_of(spark, sf_dir)
    for name in HEADLINE:
        best(name, lambda name=name: queries.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save())
    postings_mb = index.folder.size("postings") / 1e6
    print(
        json.dumps(
            {
                "metric": "index build and headline queries, best of two each",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "sf": os.path.basename(sf_dir.rstrip("/")),
                "index_mb_per_sec": round(text_mb / took["index_build"], 2),
                "postings_share_of_text": round(postings_mb / text_mb, 3),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
