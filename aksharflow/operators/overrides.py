"""Literal replacements for all pages and for single ones."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "scope string, page_num int, seq int, src string, dst string"


def parse_overrides(spark: SparkSession, text: str) -> DataFrame:
    """(scope, page_num, seq, src, dst) from {"global": {"replacements": [[from, to]]}, "pages": {"n": {...}}}; anything but an object raises."""
    data = json.loads(text)
    if not isinstance(data, dict):
        raise ValueError("overrides must be a JSON object")
    rows = []
    sections = [("global", None, data.get("global") or {})] + [("page", int(n), s or {}) for n, s in (data.get("pages") or {}).items()]
    for scope, page, section in sections:
        pairs = section.get("replacements", []) if isinstance(section, dict) else []
        if not isinstance(pairs, list):
            raise ValueError("replacements must be a list")
        for i, pair in enumerate(pairs):
            if not isinstance(pair, list) or len(pair) != 2:
                raise ValueError("a replacement must be a pair")
            if pair[0]:
                rows.append((scope, page, i, str(pair[0]), str(pair[1])))
    return spark.createDataFrame(rows, SCHEMA)


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    row = spark.read.text(path, wholetext=True).first()
    return parse_overrides(spark, row[0] if row else "")


def apply_overrides(pages: DataFrame, rules: DataFrame, text: str = "text", page: str = "page_num", out: str = "text", applied: str = "overrides_applied") -> DataFrame:
    """Global rules, then the page's own, one after the other; ``applied`` counts what each replaced.

    Rules are few by nature: per page they are one array, joined by page number, and folded over the text in its row.
    """
    rule = F.struct("seq", "src", "dst")
    general = rules.where("scope = 'global'").agg(F.array_sort(F.collect_list(rule)).alias("_general"))
    own = rules.where("scope = 'page'").groupBy(F.col("page_num").alias("_page")).agg(F.array_sort(F.collect_list(rule)).alias("_own"))
    joined = pages.crossJoin(F.broadcast(general)).join(own, pages[page] == F.col("_page"), "left")
    todo = F.concat("_general", F.coalesce("_own", F.array().cast("array<struct<seq:int,src:string,dst:string>>")))

    def fold(acc, r):  # noqa: ANN001, ANN202
        gone = (F.length(acc["t"]) - F.length(F.replace(acc["t"], r["src"], F.lit("")))) / F.length(r["src"])
        return F.struct(F.replace(acc["t"], r["src"], r["dst"]).alias("t"), (acc["n"] + gone.cast("int")).alias("n"))

    done = F.aggregate(todo, F.struct(F.col(text).alias("t"), F.lit(0).alias("n")), fold)
    return joined.withColumn("_done", done).withColumn(out, F.col("_done.t")).withColumn(applied, F.coalesce("_done.n", F.lit(0))).drop("_general", "_page", "_own", "_done")
