"""Repair of converted or extracted Devanagari."""

from __future__ import annotations

import re
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from . import texts


def steps(repair: bool) -> list[tuple[str, str]]:
    """(regex, replacement) in order; ``repair``: read doubled consonants as a lost short i."""
    out = [
        (P.CONTROL, ""),
        (P.STRAY_ZWJ, ""),
        (P.DUP_HALANT, P.HALANT),
        (P.HALANT_DUP, P.HALANT + "$1"),
        ("\u0947\u0947(?=\u0902)", "\u0947"),
        (f"([{P.CP}]){P.WS}+([{P.MARKS}]){P.WS}+", "$1$2 "),
        (f"([{P.CP}]){P.WS}+([{P.MARKS}])", "$1$2"),
        (f"({P.HALANT}){P.WS}+([{P.DEVA}])", "$1$2"),
        (f"(^|{P.WS})([{P.MARKS}])(?=[{P.C}])", "$1"),
    ]
    if repair:
        out.append((f"([{P.C}])\\1(?=[{P.C}]|[\u0901-\u0903])", "$1" + P.I_SIGN))
    out += [
        ("\u0936\u094d\u0936\u094d\u093f", "\u0936\u094d\u091a\u093f"),
        ("([\u0921\u0922])\\1\u093c", "$1\u093c\u093f"),
        (f"(?<![{P.TOKEN}])({'|'.join(P.AUXILIARIES)})\\1(?![{P.TOKEN}])", "$1"),
        *((m + m, m) for m in P.SINGLE_MARKS),
        *P.WORD_FIXES,
        (P.DUP_MARK_CLUSTER, "$1"),
    ]
    return out


@cache
def chain(repair: bool) -> texts.Repair:
    return texts.Repair(steps(repair))


def post_process(text: Column, repair: bool | Column = True) -> Column:
    """The whole chain, in a worker; ``repair`` may be a column, row by row."""
    if isinstance(repair, bool):

        def run(text: pa.Array) -> pa.Array:
            return texts.each(text, chain(repair))

        return F.arrow_udf(run, "string")(text)

    def by_row(text: pa.Array, repair: pa.Array) -> pa.Array:
        return post_processed(text, pc.fill_null(repair, False))  # null is no

    return F.arrow_udf(by_row, "string")(text, repair)


def post_processed(text: pa.Array, repair: pa.Array) -> pa.Array:
    """The chain over an array, by flags without nulls."""
    yes = texts.each(pc.if_else(repair, text, None), chain(True))
    return pc.coalesce(yes, texts.each(pc.if_else(repair, None, text), chain(False)))


def post_process_chain(text: Column, repair: bool | Column = True) -> Column:
    """The same as built-in expressions, step by step; with a column for ``repair``, the step that it switches is guarded row by row."""
    optional = set(steps(True)) - set(steps(False))
    doubled = [(m + m, m) for m in P.SINGLE_MARKS]
    for regex, to in steps(repair if isinstance(repair, bool) else True):
        if (regex, to) == doubled[0]:
            done = F.regexp_replace(text, f"([{P.SINGLE_MARKS}])\\1", "$1")  # what one pass for each mark gives
        elif (regex, to) in doubled:
            continue
        elif re.search(r"[\[\](){}\\.|?*+^$]", regex) is None:
            done = F.replace(text, F.lit(regex), F.lit(to))
        else:
            done = F.regexp_replace(text, regex, to)
        text = F.when(repair, done).otherwise(text) if (regex, to) in optional and not isinstance(repair, bool) else done
    return text


def correct_hindi_text(text: Column, font: str = "auto") -> Column:
    from .glyphs import convert

    return post_process(convert(text, font), True)


def normalize_token(token: Column) -> Column:
    """The form under which noisy tokens are looked up: four rounds of collapsing, then no nukta and no halant."""
    token = F.regexp_replace(token, "[\u200c\u200d]", "")
    for _ in range(4):
        for regex, to in ((P.DUP_HALANT, P.HALANT), (P.HALANT_DUP, P.HALANT + "$1"), (P.REPEATED_CONSONANT, "$1"), (P.DUP_MARKS, "$1"), (P.DUP_MARK_CLUSTER, "$1")):
            token = F.regexp_replace(token, regex, to)
        for a, b in P.SIGN_SEQUENCES:
            token = F.replace(token, F.lit(a), F.lit(b))
    return F.regexp_replace(token, f"[{P.NUKTA}{P.HALANT}]", "")
