"""Page ranges, split configurations and split plans."""

from __future__ import annotations

import json
import re
from typing import Any
from urllib.parse import unquote_plus

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RANGES = "array<struct<start:int,end:int,name:string>>"
_RANGE = r"(\d+)-(\d+)(?::([^,]*)?)?"


def clamp(start: Column, end: Column, total: Column) -> Column:
    """struct(first, stop): 0-based half-open page indexes, always at least one page."""
    first = F.greatest(F.lit(0), F.least(start - 1, total - 1))
    return F.struct(first.alias("first"), F.greatest(first + 1, F.least(end, total)).alias("stop"))


def slice_pages(pages: DataFrame, start: int, end: int, by: list[str], page: str = "page_num") -> DataFrame:
    """The pages ``start`` to ``end`` of each document, counted from 1 and clamped to what there is."""
    totals = pages.groupBy(*by).agg(F.max(page).alias("_total"))
    r = clamp(F.lit(start), F.lit(end), F.col("_total"))
    return pages.join(totals, by).withColumn("_r", r).where((F.col(page) > F.col("_r.first")) & (F.col(page) <= F.col("_r.stop"))).drop("_total", "_r")


def mark_pages(pages: DataFrame, start: int, end: int, by: list[str], page: str = "page_num") -> DataFrame:
    """All pages up to ``end``, with whether each is ``wanted`` and whether the encoding is ``sampled`` from it."""
    totals = pages.groupBy(*by).agg(F.max(page).alias("_total"))
    near = pages.join(totals, by).withColumn("_r", clamp(F.lit(start), F.lit(end), F.col("_total"))).where(F.col(page) <= F.col("_r.stop"))
    return near.withColumn("wanted", F.col(page) > F.col("_r.first")).withColumn("sampled", F.col(page) <= F.col("_r.first") + 3).drop("_total", "_r")


def sample_text(pages: DataFrame, by: list[str], text: str = "raw", page: str = "page_num", most_pages: int | None = 3, enough: int = 1000) -> DataFrame:
    """(*by, sample): the texts of the pages up to ``most_pages`` (None: of all) joined, until ``enough`` characters are there."""
    order = Window.partitionBy(*by).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    near = (pages if most_pages is None else pages.where(F.col(page) <= most_pages)).withColumn("_before", F.coalesce(F.sum(F.length(text)).over(order), F.lit(0))).where(F.col("_before") < enough)
    rows = F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), F.coalesce(text, F.lit("")).alias("t"))))
    return near.groupBy(*by).agg(F.array_join(F.transform(rows, lambda r: r["t"]), "").alias("sample"))


def parse_single_range(text: str | None, strict: bool = True) -> tuple[int, int] | None:
    """ "a-b" or "n"; what can't be read raises if ``strict`` and is None otherwise."""
    try:
        a, _, b = (text or "").strip().partition("-")
        return int(a), int(b or a)
    except ValueError:
        if strict:
            raise ValueError(f"Invalid page range: {text}") from None
        return None


def parse_ranges(text: Column) -> Column:
    """Array of (start, end, name) from "1-3:Intro,4-10", URL-encoded or not; digits of any script."""
    plain = F.url_decode(text)
    digits = F.translate(plain, "".join(chr(0x966 + i) for i in range(10)), "0123456789")
    part = lambda g: F.regexp_extract_all(digits if g < 3 else plain, F.lit("(?U)" + _RANGE), F.lit(g))
    a, b, names = part(1), part(2), part(3)
    at = lambda x, i: F.get(x, i.cast("int"))
    return F.transform(a, lambda x, i: F.struct(x.cast("int").alias("start"), at(b, i).cast("int").alias("end"), F.nullif(F.trim(at(names, i)), F.lit("")).alias("name")))


def parse_ranges_string(text: str) -> list[tuple[int, int, str | None]]:
    """As parse_ranges, on the driver, and raising ValueError on what is no range."""
    found = re.findall(_RANGE, unquote_plus(text))
    if not found:
        raise ValueError(f"Invalid ranges: {text}")
    out = []
    for a, b, name in found:
        start, end = int(a), int(b)
        if start < 1 or end < 1:
            raise ValueError("page numbers must be positive")
        if end < start:
            raise ValueError(f"end {end} must be >= start {start}")
        out.append((start, end, name.strip() or None))
    return out


def validate_config(config: Any) -> bool:
    if not isinstance(config, dict):
        raise ValueError("configuration must be a dictionary")
    for key, entry in config.items():
        if not isinstance(entry, dict) or not isinstance(entry.get("page_ranges"), list):
            raise ValueError(f"{key}: 'page_ranges' must be a list")
        for r in entry["page_ranges"]:
            if not isinstance(r, dict):
                raise ValueError(f"{key}: a range must be a dictionary")
            if not isinstance(r.get("start"), int) or r["start"] <= 0:
                raise ValueError(f"{key}: 'start' must be an integer > 0")
            if not isinstance(r.get("end"), int) or r["end"] < r["start"]:
                raise ValueError(f"{key}: 'end' must be an integer >= 'start'")
    return True


def config_table(spark: SparkSession, text: str) -> DataFrame:
    """(seq, key, page_ranges, prefix, unit_name) in the order of the file; invalid JSON or content raises."""
    config = json.loads(text)
    validate_config(config)
    rows = [(i, k, [(r["start"], r["end"], r.get("name")) for r in e["page_ranges"]], e.get("prefix"), e.get("unit_name")) for i, (k, e) in enumerate(config.items())]
    return spark.createDataFrame(rows, f"seq int, key string, page_ranges {RANGES}, prefix string, unit_name string")


def read_config(spark: SparkSession, path: str) -> DataFrame:
    return config_table(spark, spark.read.text(path, wholetext=True).first()[0])


def resolve_config(files: DataFrame, config: DataFrame, name: str = "base") -> DataFrame:
    """``files`` with the entry that applies: the exact key, else the first key that is a matching ^pattern$, else "default", else nulls."""
    kind = (
        F.when(F.col(name) == F.col("key"), F.lit(0))
        .when(F.col("key").startswith("^") & F.col("key").endswith("$") & F.rlike(F.col(name), F.col("key")), F.lit(1))
        .when(F.col("key") == "default", F.lit(2))
    )
    hits = files.select(name).distinct().join(F.broadcast(config), kind.isNotNull()).withColumn("_kind", kind)
    best = hits.groupBy(name).agg(F.min_by(F.struct("key", "page_ranges", "prefix", "unit_name"), F.struct("_kind", "seq")).alias("e"))
    return files.join(best.select(name, "e.*"), name, "left")


def plan_splits(resolved: DataFrame, base: str = "base", total: str = "total_pages") -> DataFrame:
    """(…, part, start, end, out_name, valid): one row a range; invalid ranges stay, marked."""
    parts = resolved.select("*", F.posexplode("page_ranges").alias("_i", "_r"))
    label = F.coalesce(F.nullif(F.col("_r.name"), F.lit("")), F.concat(F.lit("Lecture"), F.col("_i") + 1))
    filled = F.filter(F.array("prefix", F.coalesce(F.nullif(F.col("unit_name"), F.lit("")), F.col(base)), label), lambda x: x.isNotNull() & (x != ""))
    ok = (F.col("_r.start") >= 1) & (F.col("_r.end") <= F.col(total)) & (F.col("_r.start") <= F.col("_r.end"))
    return parts.select(
        *(c for c in resolved.columns if c not in ("page_ranges", "prefix", "unit_name")), (F.col("_i") + 1).alias("part"), F.col("_r.start").alias("start"), F.col("_r.end").alias("end"),
        F.concat(F.array_join(filled, "_"), F.lit(".pdf")).alias("out_name"), ok.alias("valid"),
    )
