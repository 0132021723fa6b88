"""Quality of cleaned text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.detect import KINDS, NOISE, garbage
from ..functions.texts import measured
from .lexicon import default_words


def measured_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"[{P.TOKEN}]{{3,}}"), F.lit(0))


def measure_quality(text: Column, words: set[str] | frozenset[str] | None = None, hits: Column | None = None) -> Column:
    """struct of token, script, lexicon and artefact measures and an index from 0 to 1.

    ``words`` are a literal set, looked up by hash; ``hits`` are given in their stead where a join counts the words.
    A null text is measured as an empty one.
    """
    text = F.coalesce(text, F.lit(""))
    words = default_words() if words is None else words
    noises = {n: r for n, r in NOISE if n != "latin_residue"}
    names = ["tokens", "hits", "length", "visible", "deva", "latin", *KINDS, *noises]
    found = measured(text, {"deva": f"[{P.DEVA}]", "latin": "[A-Za-z]"} | KINDS, noises, names, frozenset(words) if hits is None else frozenset())
    noise = F.struct(*(found["latin" if n == "latin_residue" else n].alias(n) for n, _ in NOISE))
    given = found["hits"] if hits is None else hits
    base = F.struct(found["tokens"].alias("token_count"), given.alias("hits"), found["visible"].alias("visible"), found["deva"].alias("deva"), found["latin"].alias("latin"), noise.alias("noise"), garbage(text, found).alias("garbage"))

    def whole(b: Column) -> Column:
        total = sum((b["noise"][n] for n, _ in NOISE[1:]), b["noise"][NOISE[0][0]])
        n = F.greatest(b["token_count"], F.lit(1))
        deva_share = F.round(b["deva"] / F.greatest(b["visible"], F.lit(1)), 4)
        hit_rate = F.round(b["hits"] / n, 4)
        index = b["garbage"]["score"] * F.lit(0.45) + deva_share * F.lit(0.2) + hit_rate * F.lit(0.25) + (F.lit(1.0) - F.least(total / n, F.lit(1.0))) * F.lit(0.1)
        return F.struct(
            b["token_count"].alias("token_count"), b["visible"].alias("visible_char_count"), deva_share.alias("devanagari_ratio"), b["latin"].alias("latin_char_count"),
            (b["visible"] - b["deva"] - b["latin"]).alias("other_char_count"), hit_rate.alias("lexicon_hit_rate"), b["noise"].alias("artifact_counts"), total.alias("artifact_total"),
            b["garbage"]["is_garbage"].alias("is_garbage"), F.round(b["garbage"]["score"], 4).alias("garbage_score"), b["garbage"]["reason"].alias("garbage_reason"),
            F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), index)), 4).alias("quality_index"),
        )

    return F.element_at(F.transform(F.array(base), whole), 1)
