"""Splitting of whole folders of PDF files by configuration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranges import plan_splits, resolve_config
from ..sources.pdf import Opener, pdf_files, pdf_info, pypdf_opener, write_splits


def plan_directory(spark: SparkSession, root: str, config: DataFrame, opener: Opener = pypdf_opener) -> DataFrame:
    """(path, base, total_pages, key, part, start, end, out_name, valid); files that no entry applies to have a null key and no part."""
    info = pdf_info(pdf_files(spark, root), opener).select("path", F.regexp_replace("filename", r"\.[^.]*$", "").alias("base"), "total_pages")
    resolved = resolve_config(info, config)
    skipped = resolved.where("key is null").select("path", "base", "total_pages", "key")
    return plan_splits(resolved.where("key is not null")).unionByName(skipped, allowMissingColumns=True)


def process_directory(spark: SparkSession, root: str, config: DataFrame, out_dir: str) -> dict:
    plan = plan_directory(spark, root, config)
    written = write_splits(pdf_files(spark, root), plan.where("key is not null"), out_dir).groupBy("path").count()
    counts = plan.groupBy("path").agg(F.max("key").alias("key")).agg(F.count("key").alias("processed"), F.count_if(F.col("key").isNull()).alias("skipped")).first()
    return {"processed_count": counts["processed"], "skipped_count": counts["skipped"], "files": written.agg(F.sum("count")).first()[0] or 0}
