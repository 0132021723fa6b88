"""Legacy glyph fonts to Unicode Devanagari."""

from __future__ import annotations

import re
from functools import cache
from importlib.resources import files

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import patterns as P
from . import texts
from .detect import detect_encoding
from .repair import post_processed

FONTS = ("krutidev", "chanakya", "walkman_chanakya")
#: Fonts that store the short i before its consonant cluster.
REORDERED = ("krutidev", "walkman_chanakya")


@cache
def _tables() -> dict[str, dict[str, str]]:
    out: dict[str, dict[str, str]] = {}
    text = lambda s: "".join(chr(int(x, 16)) for x in s.split("+"))
    for line in (files("aksharflow") / "data/glyphs.tsv").read_text().splitlines()[1:]:
        table, glyph, uni = line.split("\t")
        out.setdefault(table, {})[text(glyph)] = text(uni)
    return out


def mapping(font: str) -> dict[str, str]:
    """Glyphs to Unicode; the walkman table overrides the krutidev one, which both of these fonts use. Unknown names get krutidev's."""
    tables = _tables()
    return dict(tables["chanakya"]) if font == "chanakya" else {**tables["krutidev"], **tables["walkman"]}


def glyph_table(spark: SparkSession) -> DataFrame:
    """(font, glyph, uni): all mappings as rows."""
    return spark.createDataFrame([(f, g, u) for f in FONTS for g, u in sorted(mapping(f).items())], "font string, glyph string, uni string")


def glyph_regex(font: str) -> str:
    """Longest glyph first, then runs of what no glyph starts with, then any character."""
    keys = sorted(mapping(font), key=lambda k: (-len(k), k))
    starts = "".join(re.escape(c) for c in sorted({k[0] for k in keys}))
    return "(?s)" + "|".join(re.escape(k) for k in keys) + f"|[^{starts}]+|."


#: First of the private-use characters that stand for values in transit; texts that hold such take the plain way.
_PRIVATE = 0xF0000


@cache
def _passes(font: str) -> tuple[str, dict[str, str], dict[str, str], list[tuple[str, str]], dict[str, str]]:
    """What fast substitution needs: a regex of pieces, values of longer glyphs, single glyphs to characters in transit, (class in transit, what follows it), transit to first characters.

    A value of several characters is its first one, in transit, followed by the rest; values with one rest share a class.
    """
    table = mapping(font)
    longer = {k: v for k, v in table.items() if len(k) > 1}
    single = {k: v for k, v in table.items() if len(k) == 1}
    starts = "".join(re.escape(c) for c in sorted({k[0] for k in longer}))
    regex = "(?s)" + "|".join(re.escape(k) for k in sorted(longer, key=lambda k: (-len(k), k))) + f"|[^{starts}]+|."
    unsafe = set(single)
    transit: dict[str, str] = {}

    def carried(value: str) -> str:
        if len(value) == 1:
            return value
        return transit.setdefault(value, chr(_PRIVATE + len(transit)))

    # longer glyphs are replaced first: what of their values would be taken for a single glyph travels too
    pieces = {k: v if not unsafe & set(v) else transit.setdefault(v, chr(_PRIVATE + len(transit))) for k, v in longer.items()}
    singles = {k: carried(v) for k, v in single.items()}
    rests: dict[str, list[str]] = {}
    for value, mark in transit.items():
        rests.setdefault(value[1:], []).append(mark)
    classes = [("[" + "".join(marks) + "]", rest) for rest, marks in rests.items() if rest]
    return regex, pieces, singles, classes, {mark: value[0] for value, mark in transit.items()}


def _plain_substitute(text: Column, font: str) -> Column:
    table = F.create_map(*[F.lit(x) for pair in sorted(mapping(font).items()) for x in pair])
    pieces = F.regexp_extract_all(text, F.lit(glyph_regex(font)), F.lit(0))
    return F.array_join(F.transform(pieces, lambda x: F.coalesce(F.try_element_at(table, x), x)), "")


def _substitute(text: Column, font: str) -> Column:
    """Longer glyphs by a map over pieces, single ones by translation of whole texts, so that no character is looked up in a long map."""
    regex, pieces, singles, classes, firsts = _passes(font)
    table = F.create_map(*[F.lit(x) for pair in sorted(pieces.items()) for x in pair])
    longest = max(map(len, pieces))
    out = F.array_join(
        F.transform(F.regexp_extract_all(text, F.lit(regex), F.lit(0)), lambda x: F.when((F.length(x) > 1) & (F.length(x) <= longest), F.coalesce(F.try_element_at(table, x), x)).otherwise(x)), ""
    )
    out = F.translate(out, "".join(singles), "".join(singles.values()))
    for marks, rest in classes:
        out = F.regexp_replace(out, f"({marks})", "$1" + rest)
    out = F.translate(out, "".join(firsts), "".join(firsts.values()))
    return F.when(text.rlike("[\\x{F0000}-\\x{FFFFD}]"), _plain_substitute(text, font)).otherwise(out)


def reorder_i(text: Column) -> Column:
    return F.regexp_replace(text, f"{P.I_SIGN}(\u0902?)({P.CLUSTER})", f"$2{P.I_SIGN}$1")


@cache
def substitution(font: str) -> texts.Substitution:
    return texts.Substitution(mapping(font), font in REORDERED)


def convert(text: Column, font: str | Column = "auto") -> Column:
    """Greedy longest-match substitution, left to right, then reordering where the font needs it; in a worker.

    ``font``: a name, "auto" (what detect_encoding finds, krutidev where it finds none) or a column of names. A name
    that is no font leaves the text as it is.
    """
    if isinstance(font, str):
        if font == "auto":
            found = detect_encoding(text)["font"]
            return convert(text, F.coalesce(F.nullif(found, F.lit("unknown")), F.lit("krutidev")))
        if font not in FONTS:
            return text

        def run(text: pa.Array) -> pa.Array:
            return texts.each(text, substitution(font))

        return F.arrow_udf(run, "string")(text)

    def by_row(text: pa.Array, font: pa.Array) -> pa.Array:
        return _converted(text, font)

    return F.arrow_udf(by_row, "string")(text, font)


def _converted(text: pa.Array, font: pa.Array) -> pa.Array:
    done = text
    for name in FONTS:
        asked = pc.fill_null(pc.equal(font, name), False)
        if pc.any(asked).as_py():
            done = pc.if_else(asked, texts.each(pc.if_else(asked, text, None), substitution(name)), done)
    return done


def convert_and_repair(text: Column, font: Column) -> Column:
    """convert() and then post_process(), which repairs where the name is that of a font: both in one worker."""

    def run(text: pa.Array, font: pa.Array) -> pa.Array:
        legacy = pc.fill_null(pc.is_in(font, value_set=pa.array(FONTS)), False)
        return post_processed(_converted(text, font), legacy)

    return F.arrow_udf(run, "string")(text, font)
