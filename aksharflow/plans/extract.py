"""Extraction from pages: the document decides the font, its pages are converted, overridden and corrected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.detect import artifact_total, detect_encoding, latin_chunk, summarize_extraction
from ..functions.repair import post_process
from ..operators import lexicon as lex
from ..operators.overrides import apply_overrides
from ..operators.ranges import mark_pages, sample_text
from .clean import cleaned, converted, with_encoding

NO_FONT = ("unknown", "none")


def extract_pages(
    pages: DataFrame,
    by: list[str] = ("path",),
    font: str = "auto",
    post: bool = True,
    overrides: DataFrame | None = None,
    second_stage: str = "none",
    lexicon: lex.Lexicon | None = None,
    bootstrap: bool = False,
    max_distance: int = 2,
    page_range: tuple[int, int] | None = None,
    keep_before: bool = False,
) -> DataFrame:
    """Pages (*by, page_num, raw) with text, the document's encoding, overrides_applied and page_correction_stats.

    Encoding is judged on a sample of each document's pages up to the third of those that are asked for, from its
    beginning, and joined back by document. ``page_range`` (from 1, clamped) or pages that read_pages() has marked say
    which are asked for. With ``keep_before`` the text ahead of the second stage is added as text_before, and what
    correct_bootstrapped() counts where that is used. Null and empty pages stay as they are.
    """
    if second_stage not in ("none", "lexicon"):
        raise ValueError(f"second stage must be none or lexicon: {second_stage!r}")
    by = list(by)
    if page_range is not None:
        pages = mark_pages(pages, *page_range, by)
    marked = {"wanted", "sampled"} <= set(pages.columns)
    sample = sample_text(pages.where("sampled"), by, most_pages=None) if marked else sample_text(pages, by)
    judged = with_encoding(sample, "sample", font).drop("sample")
    out = pages.where("wanted").drop("wanted", "sampled") if marked else pages
    out = out.join(judged, by, "left").withColumn("text", cleaned("raw", font) if post else converted("raw", font))
    if overrides is not None:
        out = apply_overrides(out, overrides)
    else:
        out = out.withColumn("overrides_applied", F.lit(0))
    staged = F.lit(False)
    if keep_before:
        out = out.withColumn("text_before", F.coalesce("text", F.lit("")))
    if second_stage == "lexicon":
        use = lexicon or lex.Lexicon.of(pages.sparkSession)
        staged = ~F.col("effective_font_type").isin(*NO_FONT)
        out = out.withColumn("_before", F.col("text"))
        if bootstrap and lex.groups_in_place(use, by):
            out = lex.correct_bootstrapped(out, "text", use, by, max_distance, out="_fixed", stats="page_correction_stats")
            out = out if keep_before else out.drop("context_words", "hits_before", "hits_after")
        else:
            if bootstrap:
                use = use.within(lex.contextual_lexicon(out, "text", use, by), by)
            out = lex.correct(out, "text", use, max_distance, out="_fixed", stats="page_correction_stats")
        out = out.withColumn("text", F.when(staged, F.col("_fixed")).otherwise(F.col("_before"))).withColumn("page_correction_stats", F.when(staged, F.col("page_correction_stats"))).drop("_before", "_fixed")
    return out.withColumn("second_stage_applied", staged)


def documents_of(pages: DataFrame, by: list[str] = ("path",)) -> DataFrame:
    """A row a document: full text, counts, and correction statistics with its first 20 corrections."""
    rows = F.array_sort(F.collect_list(F.struct("page_num", F.coalesce("text", F.lit("")).alias("text"))))
    aggs = [
        F.count("*").alias("processed_pages"),
        F.bool_or("has_encoding_issues").alias("has_encoding_issues"),
        F.max("detected_font_type").alias("detected_font_type"),
        F.bool_or("is_scrambled_devanagari").alias("is_scrambled_devanagari"),
        F.sum(artifact_total(F.col("text"))).alias("artifact_count"),
        F.sum("overrides_applied").alias("overrides_applied"),
        F.bool_or("second_stage_applied").alias("second_stage_applied"),
        F.array_join(F.transform(rows, lambda r: r["text"]), "\n\n").alias("full_text"),
    ]
    if "page_correction_stats" in pages.columns:
        first = F.array_sort(F.collect_list(F.struct("page_num", F.col("page_correction_stats.corrections").alias("c"))))
        total = lambda n: F.sum(f"page_correction_stats.{n}").alias(n)
        aggs.append(
            F.struct(*(total(n) for n in ("tokens_seen", "tokens_considered", "corrected_tokens")), F.slice(F.flatten(F.transform(first, lambda r: r["c"])), 1, 20).alias("corrections")).alias("correction_stats")
        )
    return pages.groupBy(*by).agg(*aggs)


def compare(pages: DataFrame, text: str = "raw", convert_text: bool = True) -> DataFrame:
    """Pages with corrected text and the comparison of both; English pages that are no legacy font stay raw."""
    e = detect_encoding(F.col(text))
    out = pages.withColumn("_e", e).withColumn("_latin", latin_chunk(F.col(text)) & ~F.col("_e.font").isin("krutidev", "chanakya"))
    out = with_encoding(out, text, "auto")
    fixed = out.withColumn("_c", cleaned(text, "auto") if convert_text else F.col(text))
    fixed = fixed.withColumn("corrected", F.when(F.col("_latin"), F.col(text)).otherwise(F.col("_c"))).withColumn("has_encoding_issues", F.col("has_encoding_issues") & ~F.col("_latin"))
    summary = summarize_extraction(F.col(text), F.col("corrected"), F.col("has_encoding_issues"), F.col("detected_font_type"), F.lit(convert_text), F.col("_latin"))
    return fixed.withColumn("comparison", summary).drop("_e", "_c", "_latin")


def correct_text_route(text: str = "text"):
    """The text converted where an encoding is detected, and repaired in any case."""
    e = detect_encoding(F.col(text))
    from ..functions.glyphs import convert

    return post_process(F.when(e["has_issues"], convert(F.col(text), e["font"])).otherwise(F.col(text)), True)
