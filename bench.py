"""Seconds of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS], as one line of JSON."""

import json
import os
import sys
import time
from pathlib import Path

SF_DIR, CPUS = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
HEADLINE = "term_stats postings bm25_topk all_models jelinek_mercer eval_macro links frontier_order politeness_delay inlinks_upsert graph_clean pagerank_steps hits_steps base_set cosine_search stream_index".split()


def main() -> None:
    from pyspark.sql import SparkSession

    sys.path.insert(0, str(Path(__file__).resolve().parent))
    from sextant.plans.catalogue import QUERIES

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    QUERIES["tokens_per_doc"](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    took = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
        spark.catalog.clearCache()
    sf = Path(SF_DIR).name.removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf}))


if __name__ == "__main__":
    main()
