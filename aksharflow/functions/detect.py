"""Detection and measurement of text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from . import texts

KRUTIDEV_SIGNS = ("osQ", "kjk", "ykZ", "Fk", "Hk", "/k", "'k")
CHANAKYA_SIGNS = ("Aa", "ao", "AO", "\xac", "\xa4")
GENERAL_SIGNS = ("kk", "kh", "kz", "gh", "ph", "ek", "ea", "kj", "dj")
ENGLISH = tuple("a an and answers below complete do family for given in is it questions read respond share teacher that the to what with word you your".split())


def occurrences(text: Column, part: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def _sum(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out + c
    return out


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0: an optimiser may evaluate it ahead of the condition that guards it."""
    return a / F.nullif(b, F.lit(0))


def count(text: Column, regex: str) -> Column:
    return F.regexp_count(text, F.lit(regex))


def detect_encoding(text: Column) -> Column:
    """struct(has_issues, font): whether the text looks like a legacy glyph font, and like which one."""
    signs = {"k": KRUTIDEV_SIGNS, "c": CHANAKYA_SIGNS, "g": GENERAL_SIGNS}
    s = texts.measured(text, {"deva": f"[{P.DEVA}]"}, {}, ["deva", *signs], literals=signs)
    share = ratio(s["deva"], F.length(text))
    none = F.struct(F.lit(False).alias("has_issues"), F.lit("unknown").alias("font"))
    font = F.when(s["k"] >= s["c"], F.lit("krutidev")).otherwise(F.lit("chanakya"))
    return F.when((s["k"] + s["c"] + s["g"] > 4) & (share < 0.1), F.struct(F.lit(True).alias("has_issues"), font.alias("font"))).otherwise(none)


ARTIFACTS = (
    ("control_chars", P.CONTROL),
    ("stray_zwj", P.STRAY_ZWJ),
    ("leading_matra", f"(^|{P.WS})([{P.MARKS}])(?=[{P.C}])"),
    ("detached_mark", f"([{P.CP}]){P.WS}+([{P.MARKS}])"),
    ("halant_space", f"({P.HALANT}){P.WS}+([{P.DEVA}])"),
    ("duplicate_marks", f"([{P.DOUBLED}\u0949])\\1"),
    ("double_e_anusvara", "\u0947\u0947(?=\u0902)"),
)


def _counted(text: Column) -> Column:
    """struct of the artefacts and deva, the Devanagari characters; null for null."""
    return texts.measured(text, {"deva": f"[{P.DEVA}]"}, dict(ARTIFACTS), ["deva", *dict(ARTIFACTS)])


def count_artifacts(text: Column) -> Column:
    """struct of the seven extraction artefacts and their total."""
    found = _counted(text)
    counts = [F.coalesce(found[n], F.lit(0)) for n, _ in ARTIFACTS]
    return F.struct(*(c.alias(n) for c, (n, _) in zip(counts, ARTIFACTS)), _sum(counts).alias("total"))


def artifact_total(text: Column) -> Column:
    return count_artifacts(text)["total"]


def detect_scrambled(text: Column, threshold: float = 0.01) -> Column:
    found = _counted(text)
    total = _sum([F.coalesce(found[n], F.lit(0)) for n, _ in ARTIFACTS])
    return F.coalesce((found["deva"] >= 50) & (ratio(found["deva"], F.length(text)) >= 0.3) & (ratio(total, found["deva"]) > threshold), F.lit(False))


PUNCTUATION = r"[.,!?;:()\[\]{}\"'\-=/\u2000-\u206f]"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{P.WS}+|{P.WS}+$", "")


#: Characters by which a text is judged.
KINDS = {"point": PUNCTUATION, "letter": "[A-Za-z\u0900-\u0d7f]", "digit": "[0-9]"}


def garbage(text: Column, counts: Column | None = None) -> Column:
    """struct(is_garbage, score, reason): whether a page's text is too noisy to use. ``counts``: struct of length, visible and KINDS."""
    if counts is None:
        counts = texts.measured(text, KINDS, {}, ["length", "visible", *KINDS])
    total, point, letter, digit = (counts[n] for n in ("visible", *KINDS))
    shares = F.struct(ratio(point, total).alias("p"), ratio(letter, total).alias("l"), ratio(total - point - letter - digit, total).alias("g"))
    result = lambda bad, score, reason: F.struct(F.lit(bad).alias("is_garbage"), score.cast("double").alias("score"), reason.alias("reason"))
    percent = lambda what, x: F.format_string(f"{what}: %.1f%%", x * 100)

    def decide(s: Column) -> Column:
        p, letters, g = s["p"], s["l"], s["g"]
        return (
            F.when(p > 0.5, result(True, 1.0 - p, percent("Too much punctuation", p)))
            .when(letters < 0.4, result(True, letters, percent("Too few letters", letters)))
            .when(g > 0.3, result(True, 1.0 - g, percent("Too many unreadable characters", g)))
            .otherwise(result(False, F.lit(0.7) * letters + F.lit(0.2) * (1.0 - g) + F.lit(0.1) * (1.0 - p), F.lit("Text quality acceptable")))
        )

    short = text.isNull() | (counts["length"] < 50)
    return F.when(short, result(True, F.lit(0.0), F.lit("Text too short (< 50 chars)"))).otherwise(F.element_at(F.transform(F.array(shares), decide), 1))


def latin_chunk(text: Column) -> Column:
    """Whether the text is English rather than a legacy font."""
    latin, deva = count(text, "[A-Za-z]"), count(text, f"[{P.TOKEN}]")
    hits = F.size(F.filter(F.regexp_extract_all(text, F.lit("[A-Za-z]{2,}"), F.lit(0)), lambda w: F.lower(w).isin(*ENGLISH)))
    return F.coalesce((latin >= 24) & (latin >= F.greatest(F.lit(8), deva * 4)) & (hits >= 3), F.lit(False))


NOISE = (
    ("mark_spacing", f"[{P.DEVA}]{P.WS}+[{P.MARKS}]"),
    ("halant_spacing", f"{P.HALANT}{P.WS}+[{P.DEVA}]"),
    ("duplicate_marks", P.DUP_MARKS),
    ("spurious_nukta", P.NONSTANDARD_NUKTA.replace("\u091a\u091b", "\u091a\u091b\u091e", 1)),
    ("suspicious_mark_sequence", P.SUSPICIOUS_MARKS),
    ("latin_residue", "[A-Za-z]"),
)
SUMMARY = "tone string, status string, font_label string, show_font_badge boolean, diff string, display_mode string"


def summarize_extraction(raw: Column, corrected: Column, has_issues: Column, font: Column, convert: Column, latin: Column) -> Column:
    """struct: how a raw and a corrected extraction compare, and what to show of them."""
    same = raw == corrected
    applied = convert & ~same
    scrambled = applied & (font == "scrambled_devanagari")
    legacy = has_issues & applied & ~font.isin("unknown", "scrambled_devanagari")
    view = lambda tone, status, label, badge, diff, mode="comparison": F.struct(
        F.lit(tone).alias("tone"), (status if isinstance(status, Column) else F.lit(status)).alias("status"), (label if isinstance(label, Column) else F.lit(label)).alias("font_label"), F.lit(badge).alias("show_font_badge"), F.lit(diff).alias("diff"), F.lit(mode).alias("display_mode")
    )
    none = "No legacy font"
    shown = (
        F.when(latin, view("secondary", "English / Latin text detected", "", False, "no conversion needed", "raw_only"))
        .when(~convert, view("secondary", "Raw extraction only", "", False, "conversion disabled"))
        .when(legacy, view("success", F.concat(F.lit("Legacy encoding detected: "), font), F.initcap(font), True, "changed"))
        .when(scrambled, view("info", "Scrambled Devanagari detected", none, True, "changed"))
        .when(applied, view("info", "Unicode Hindi text detected", none, True, "changed"))
        .when(has_issues, view("info", "Legacy-looking text detected", F.initcap(font), True, "kept"))
        .otherwise(view("secondary", "Unicode / No issues", none, True, "kept"))
    )
    return F.struct(
        same.alias("raw_equals_corrected"), applied.alias("conversion_applied"), legacy.alias("legacy_conversion_applied"), scrambled.alias("scrambled_cleanup_applied"), latin.alias("latin_text_detected"),
        shown.alias("view"), F.length(raw).alias("raw_char_count"), F.length(corrected).alias("unicode_char_count"),
    )
