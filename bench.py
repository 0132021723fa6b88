"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import time
from importlib.util import find_spec

from pyspark.sql import SparkSession

from aksharflow.plans.queries import QUERIES

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = ("detect_by_lang", "convert_krutidev", "post_process_legacy", "frequency_lexicon", "clean_none", "quality_metrics", "batch_summary", "page_slice")
LLM = ("op2_mixing", "op4_quality", "op6_language_id", "op8_packing", "op9_exact_dedup", "op10_toxicity")


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        # one small file of documents would otherwise be a single task
        .config("spark.sql.files.maxPartitionBytes", "2m")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    chosen = {n: QUERIES[n] for n in HEADLINE}
    if find_spec("aksharflow.llm") is not None:
        from aksharflow.llm import queries as llm

        chosen |= {n: llm.QUERIES[n] for n in LLM}
    spark.read.parquet(f"{SF_DIR}/documents.parquet").write.format("noop").mode("overwrite").save()
    seconds = {}
    for name, query in chosen.items():
        began = time.perf_counter()
        query(spark, SF_DIR).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    sf = re.search(r"sf([\d.]+)", SF_DIR)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": float(sf[1]) if sf else SF_DIR}))
    spark.stop()


if __name__ == "__main__":
    main()
