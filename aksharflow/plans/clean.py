"""Cleaning of raw text: detect, convert, repair, correct, and say what was done."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.detect import artifact_total, detect_encoding, detect_scrambled
from ..functions.glyphs import FONTS, convert, convert_and_repair
from ..functions.repair import post_process
from ..operators import lexicon as lex
from ..operators.symspell import SymSpell

SCRAMBLED = "scrambled_devanagari"
DISTANCE = {"safe": 0, "aggressive": 2}


def check_mode(mode: str) -> None:
    if mode not in lex.MODES:
        raise ValueError(f"correction mode must be one of {', '.join(lex.MODES)}: {mode!r}")


def with_encoding(df: DataFrame, text: str, font: str) -> DataFrame:
    """Adds has_encoding_issues, detected_font_type, is_scrambled_devanagari and effective_font_type."""
    e = detect_encoding(F.col(text))
    df = df.withColumn("_e", e).withColumn("is_scrambled_devanagari", (F.col("_e.font") == "unknown") & detect_scrambled(F.col(text)))
    reported = F.when(F.col("is_scrambled_devanagari"), F.lit(SCRAMBLED)).otherwise(F.col("_e.font"))
    df = df.withColumn("has_encoding_issues", F.col("_e.has_issues") | F.col("is_scrambled_devanagari")).withColumn("detected_font_type", reported).drop("_e")
    return df.withColumn("effective_font_type", F.col("detected_font_type") if font == "auto" else F.lit(font))


def converted(text: str, font: str) -> Column:
    """The text converted from its effective font, where that is one."""
    if font == "auto":
        return convert(F.col(text), F.col("effective_font_type"))
    return convert(F.col(text), font)


def repaired(text: str, font: str) -> Column:
    if font == "none":
        return F.col(text)
    return post_process(F.col(text), F.col("effective_font_type").isin(*FONTS) if font == "auto" else font in FONTS)


def cleaned(text: str, font: str) -> Column:
    """converted() and repaired(), by one worker where the font is a column."""
    if font == "auto":
        return convert_and_repair(F.col(text), F.col("effective_font_type"))
    if font == "none":
        return F.col(text)
    return post_process(converted(text, font), font in FONTS)


def stages(text: str, mode: str, symspell: bool = False) -> Column:
    """What was done to the text, in order; nothing is done to an empty one but the optional speller."""
    effective, some = F.col("effective_font_type"), F.length(text) > 0
    legacy = ~effective.isin("unknown", "none", SCRAMBLED)
    found = F.array(
        F.when(some & legacy, F.concat(F.lit("convert:"), effective)),
        F.when(some & (effective != "none"), F.lit("post_process")),
        F.when(some, F.lit(f"lexicon:{mode}" if mode != "none" else None).cast("string")),
        F.lit("symspell" if symspell else None).cast("string"),
    )
    return F.filter(found, lambda x: x.isNotNull())


def clean(
    df: DataFrame,
    text: str = "text",
    font: str = "auto",
    mode: str = "none",
    lexicon: lex.Lexicon | None = None,
    bootstrap: bool = False,
    context: DataFrame | None = None,
    by: list[str] = (),
    symspell: SymSpell | None = None,
) -> DataFrame:
    """``df`` with the cleaning result: a column for each of its fields, ``cleaned_text`` the last.

    ``context`` (column ``text`` and ``by``) gives the texts whose recurring clean tokens count as words; with
    ``bootstrap`` these are the cleaned texts themselves, per group of ``by``. Mode "none" is a projection of the scan, and
    so are corrections by a literal lexicon; with ``bootstrap`` the rows are shuffled once, by group.
    """
    check_mode(mode)
    df = with_encoding(df, text, font)
    df = df.withColumn("artifact_count_before", artifact_total(F.col(text)))
    df = df.withColumn("cleaned_text", cleaned(text, font))
    if mode != "none":
        use = lexicon or lex.Lexicon.of(df.sparkSession)
        if bootstrap and context is None and lex.groups_in_place(use, list(by)):
            df = lex.correct_bootstrapped(df, "cleaned_text", use, list(by), DISTANCE[mode], out="cleaned_text", stats="correction_stats")
            df = df.drop("context_words", "hits_before", "hits_after")
        else:
            if context is not None or bootstrap:
                seed, column = (df, "cleaned_text") if context is None else (context, "text")
                use = use.within(lex.contextual_lexicon(seed, column, use, list(by)), by)
            df = lex.correct(df, "cleaned_text", use, DISTANCE[mode], out="cleaned_text", stats="correction_stats")
        df = df.withColumn("lexicon_size", F.lit(use.size))
    if symspell is not None:
        df = symspell.correct(df, "cleaned_text", out="cleaned_text", stats="symspell_stats")
    last = df.withColumn("artifact_count_after", artifact_total(F.col("cleaned_text")))
    last = last.withColumn("artifacts_removed", F.col("artifact_count_before") - F.col("artifact_count_after"))
    return last.withColumns(
        {
            "input_char_count": F.length(text),
            "output_char_count": F.length("cleaned_text"),
            "correction_mode": F.lit(mode),
            "stages_applied": stages(text, mode, symspell is not None),
        }
    )


def summarise(results: DataFrame) -> DataFrame:
    """One row: files, errors, artefacts removed, corrected tokens, and files by font."""
    column = lambda path, kind: F.col(path) if path.split(".")[0] in results.columns else F.lit(None).cast(kind)
    fonts = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("f").isNotNull(), F.struct("f", "n")))))
    failed = F.coalesce(column("error", "string").isNotNull(), F.lit(False))
    per_font = results.withColumn("_failed", failed).groupBy(F.col("detected_font_type").alias("f")).agg(
        F.count("*").alias("files"),
        F.count_if("_failed").alias("errors"),
        F.coalesce(F.sum("artifacts_removed"), F.lit(0)).alias("artifacts"),
        F.coalesce(F.sum(column("correction_stats.corrected_tokens", "int")), F.lit(0)).alias("lexicon"),
        F.coalesce(F.sum(column("symspell_stats.corrected_tokens", "int")), F.lit(0)).alias("symspell"),
        F.count_if(~F.col("_failed") & F.col("detected_font_type").isNotNull()).alias("n"),
    )
    return per_font.agg(
        F.coalesce(F.sum("files"), F.lit(0)).alias("files"),
        F.coalesce(F.sum("errors"), F.lit(0)).alias("errors"),
        F.coalesce(F.sum("artifacts"), F.lit(0)).alias("artifacts_removed"),
        F.coalesce(F.sum("lexicon"), F.lit(0)).alias("lexicon_corrected_tokens"),
        F.coalesce(F.sum("symspell"), F.lit(0)).alias("symspell_corrected_tokens"),
        F.map_filter(fonts, lambda k, v: v > 0).alias("font_types"),
    )
