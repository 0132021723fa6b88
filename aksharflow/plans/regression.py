"""Before and after the second stage, page by page, document by document, and over all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import lexicon as lex
from ..operators.quality import measure_quality, measured_tokens
from ..operators.tokens import STATS
from .extract import extract_pages


def page_report(
    pages: DataFrame, by: list[str] = ("path",), font: str = "auto", second_stage: str = "lexicon", lexicon: lex.Lexicon | None = None, words: frozenset[str] | None = None,
    bootstrap: bool = True, overrides: DataFrame | None = None, page_limit: int | None = None,
) -> DataFrame:
    """Pages with baseline and corrected quality, their differences, and whether it helped.

    (*by, page_num, detected_font_type, baseline, corrected, corrections, delta, lexicon_hit_delta, artifact_delta,
    correction_stats, improved, contextual_lexicon_size, effective_lexicon_size). Both texts come from one extraction.
    Quality counts hits of the corrector's lexicon, the document's contextual words among them; ``words`` are counted
    instead where they are given. Failed files (rows with an ``error``) are one row with it and no measures.
    """
    by = list(by)
    errors = pages.where("error is not null").select(*by, "error").distinct() if "error" in pages.columns else None
    if errors is not None:
        pages = pages.where("error is null")
    if page_limit:
        pages = pages.where(F.col("page_num") <= page_limit)
    use = lexicon or lex.Lexicon.of(pages.sparkSession)
    done = extract_pages(pages, by, font, overrides=overrides, second_stage=second_stage, lexicon=use, bootstrap=bootstrap, keep_before=True)
    done = done.withColumn("text", F.coalesce("text", F.lit("")))
    context = None
    counted = "context_words" in done.columns
    if counted:
        done = done.withColumnRenamed("context_words", "contextual_lexicon_size")
    elif bootstrap:
        context = lex.contextual_lexicon(done, "text_before", use, by)
        sizes = context.groupBy(*by).agg(F.count("*").alias("contextual_lexicon_size"))
        done = done.join(sizes, by, "left")
    else:
        done = done.withColumn("contextual_lexicon_size", F.lit(None).cast("bigint"))
    done = done.withColumn("contextual_lexicon_size", F.coalesce("contextual_lexicon_size", F.lit(0).cast("bigint")))
    if counted and words is None:
        for name, column, hits in (("b", "text_before", F.col("hits_before")), ("a", "text", F.when(F.col("second_stage_applied"), F.col("hits_after")).otherwise(F.col("hits_before")))):
            done = done.withColumn(name, measure_quality(F.col(column), hits=hits))
    elif words is not None or (context is None and use.literal is not None):
        known = use.literal if words is None else words
        done = done.withColumn("b", measure_quality(F.col("text_before"), known)).withColumn("a", measure_quality(F.col("text"), known))
    else:
        found = _hits(done, by, use, context)
        done = done.join(found, [*by, "page_num"], "left")
        for name, column in (("b", "text_before"), ("a", "text")):
            done = done.withColumn(name, measure_quality(F.col(column), hits=F.coalesce(f"_{name}", F.lit(0).cast("bigint"))))
    stats = F.col("page_correction_stats") if second_stage == "lexicon" else F.lit(None).cast(STATS)
    corrections = F.coalesce(stats["corrected_tokens"], F.lit(0))
    delta = F.round(F.col("a.quality_index") - F.col("b.quality_index"), 4)
    report = done.select(
        *by, "page_num", "detected_font_type", F.col("b").alias("baseline"), F.col("a").alias("corrected"), corrections.alias("corrections"), delta.alias("delta"),
        F.round(F.col("a.lexicon_hit_rate") - F.col("b.lexicon_hit_rate"), 4).alias("lexicon_hit_delta"), (F.col("a.artifact_total") - F.col("b.artifact_total")).alias("artifact_delta"),
        stats.alias("correction_stats"), ((delta > 0) | (corrections > 0)).alias("improved"), "contextual_lexicon_size", (F.col("contextual_lexicon_size") + F.lit(use.size)).alias("effective_lexicon_size"),
    )
    return report.unionByName(errors, allowMissingColumns=True) if errors is not None else report.withColumn("error", F.lit(None).cast("string"))


def _hits(pages: DataFrame, by: list[str], lexicon: lex.Lexicon, context: DataFrame | None) -> DataFrame:
    """(*by, page_num, _b, _a): measured tokens of both texts that are words in general or in the document. Tokens are shuffled, texts are not."""
    both = F.array(F.struct(F.lit("b").alias("w"), measured_tokens(F.col("text_before")).alias("t")), F.struct(F.lit("a").alias("w"), measured_tokens(F.col("text")).alias("t")))
    tokens = pages.select(*by, "page_num", F.explode(both).alias("x")).select(*by, "page_num", "x.w", F.explode("x.t").alias("token"))
    tokens = tokens.groupBy(*by, "page_num", "w", "token").agg(F.count("*").alias("n"))
    known = (lexicon if context is None else lexicon.within(context, by)).flag(tokens, "token", "_known").where("_known")
    side = lambda w: F.sum(F.when(F.col("w") == w, F.col("n")).otherwise(0)).alias(f"_{w}")
    return known.groupBy(*by, "page_num").agg(side("b"), side("a"))


def rollup_report(report: DataFrame, by: list[str] = ("path",)) -> DataFrame:
    """Documents and, with nulls for ``by``, the whole: pages, improved pages, corrections and mean difference."""
    # these have four digits: as decimals their mean doesn't depend on the order of the rows
    mean = lambda c: F.round(F.avg(F.col(c).cast("decimal(18,4)")), 4).cast("double")
    return report.where("page_num is not null").rollup(*by).agg(
        F.count("*").alias("pages"), F.count_if("improved").alias("improved_pages"), F.sum("corrections").alias("corrections"), mean("delta").alias("avg_delta"),
        mean("baseline.quality_index").alias("avg_baseline"), mean("corrected.quality_index").alias("avg_corrected"),
    )


def _failures(report: DataFrame, by: list[str]) -> str:
    return "".join(f"\n{'/'.join(str(r[c]) for c in by)}: {r['error']}" for r in report.where("error is not null").orderBy(*by).toLocalIterator())


def format_report(report: DataFrame, by: list[str] = ("path",)) -> list[str]:
    """A line for the whole, then one for each page, in order."""
    whole = rollup_report(report, by).where(" and ".join(f"{c} is null" for c in by)).first()
    if not whole or not whole["pages"]:
        return [f"0 pages{_failures(report, by)}"]
    lines = [f"{whole['pages']} pages, {whole['improved_pages']} improved, {whole['corrections']} corrections, mean change {whole['avg_delta']}{_failures(report, by)}"]
    for r in report.where("page_num is not null").orderBy(*by, "page_num").toLocalIterator():
        lines.append(f"{'/'.join(str(r[c]) for c in by)} page {r['page_num']}: {r['baseline']['quality_index']} -> {r['corrected']['quality_index']} ({r['corrections']} corrections)")
        if r["corrections"]:
            lines.append("  e.g. " + ", ".join(f"{c['from']} > {c['to']}" for c in r["correction_stats"]["corrections"][:3]))
    return lines
