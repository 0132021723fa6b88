"""Candidate spellings of tokens: closure over rules, scored against a lexicon, frequencies and any further column."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from .lexicon import Lexicon, without_i
from .tokens import apply_fixes, distinct_tokens

#: A rule maps a token to an array of texts.
Texts = Callable[[Column], Column]


@dataclass(frozen=True)
class Rule:
    name: str
    confidence: float
    texts: Texts


def _rewrite(*pairs: tuple[str, str]) -> Texts:
    def texts(token: Column) -> Column:
        for regex, to in pairs:
            token = F.regexp_replace(token, regex, to)
        return F.array(token)

    return texts


KEEP = Rule("keep", 0.5, lambda t: F.array(t))
RULES = (
    KEEP,
    Rule("dup_halant", 0.9, _rewrite((P.DUP_HALANT, P.HALANT))),
    Rule("halant_dup_cons", 0.85, _rewrite((P.HALANT_DUP, P.HALANT + "$1"))),
    Rule("dup_marks", 0.85, _rewrite((P.DUP_MARKS, "$1"), (P.DUP_MARK_CLUSTER, "$1"))),
    Rule("dup_consonant_collapse", 0.55, _rewrite((P.REPEATED_CONSONANT, "$1"))),
    Rule("dup_consonant_imatra", 0.45, _rewrite((P.REPEATED_CONSONANT, "$1" + P.I_SIGN))),
    Rule("drop_stray_imatra", 0.6, without_i),
)
MAX_ITERATIONS = 4


@dataclass
class Scoring:
    """What candidates are scored by; ``frequency`` has (term, cnt), ``extra`` maps the text column to a score."""

    lexicon: Lexicon | None = None
    frequency: DataFrame | None = None
    extra: Callable[[Column], Column] | None = None
    lexicon_bonus: float = 0.5
    frequency_weight: float = 0.05


def _proposals(rule: Rule, at: int, text: Column) -> Column:
    """Array of struct(t, c, r, i, k): the rule's texts with its confidence, name and place, and their own place."""
    return F.transform(rule.texts(text), lambda x, k: F.struct(x.alias("t"), F.lit(rule.confidence).alias("c"), F.lit(rule.name).alias("r"), F.lit(at).alias("i"), k.alias("k")))


def generate(tokens: DataFrame, rules: Sequence[Rule] = RULES, max_iterations: int = MAX_ITERATIONS) -> DataFrame:
    """(token, text, confidence, reason, ord): every text that up to ``max_iterations`` rules lead to, once for each token.

    A chain's confidence is the product of its rules'. A text reached again keeps its better confidence, and its place
    from the first time; ``ord`` is that place, the token itself first.
    """
    seen = tokens.select("token").distinct().select("token", F.col("token").alias("text"), F.lit(0.5).alias("confidence"), F.lit("keep").alias("reason"), F.array(F.lit(0)).alias("ord"), F.lit(0).alias("round"))
    steps = [(i, r) for i, r in enumerate(rules) if r.name != "keep"]
    for n in range(1, max_iterations + 1):
        text = F.col("text")
        made = F.flatten(F.array(*(_proposals(r, i, text) for i, r in steps)))
        first = F.col("reason") == "keep"
        grown = (
            seen.where(F.col("round") == n - 1)
            .select("token", "text", "confidence", "reason", "ord", F.explode(made).alias("m"))
            .where(F.col("m.t") != text)
            .select(
                "token",
                F.col("m.t").alias("text"),
                F.when(first, F.col("m.c")).otherwise(F.col("confidence") * F.col("m.c")).alias("confidence"),
                F.when(first, F.col("m.r")).otherwise(F.concat_ws("+", "reason", "m.r")).alias("reason"),
                F.concat(F.array(F.lit(n)), F.slice("ord", 2, 100), F.array(F.col("m.i"), F.col("m.k"))).alias("ord"),
                F.lit(n).alias("round"),
            )
        )
        both = seen.unionByName(grown)
        # the best confidence wins, the earliest among equals; its round says whether it is a new frontier
        pick = F.max_by(F.struct("confidence", "reason", "round"), F.struct("confidence", (-F.col("round")).alias("a"), F.transform("ord", lambda x: -x).alias("b")))
        seen = both.groupBy("token", "text").agg(pick.alias("p"), F.min("ord").alias("ord")).select("token", "text", "p.confidence", "p.reason", "ord", "p.round")
    return seen.drop("round")


def score(candidates: DataFrame, scoring: Scoring | None = None) -> DataFrame:
    scoring = scoring or Scoring()
    total = F.col("confidence")
    if scoring.lexicon is not None:
        candidates = scoring.lexicon.flag(candidates, "text", "_word")
        total = total + F.when(F.col("_word"), F.lit(scoring.lexicon_bonus)).otherwise(0.0)
    if scoring.frequency is not None:
        candidates = candidates.join(scoring.frequency.select(F.col("term").alias("text"), F.col("cnt").cast("double").alias("_cnt")), "text", "left")
        total = total + F.when(F.col("_cnt") > 0, F.lit(scoring.frequency_weight) * F.log1p("_cnt")).otherwise(0.0)
    if scoring.extra is not None:
        total = total + F.coalesce(scoring.extra(F.col("text")), F.lit(0.0))
    return candidates.withColumn("score", total).drop("_word", "_cnt")


def select_best(scored: DataFrame) -> DataFrame:
    """(token, text, confidence, reason, score): the best of each token, the earliest among equals."""
    best = F.max_by(F.struct("text", "confidence", "reason", "score"), F.struct("score", F.transform("ord", lambda x: -x).alias("o")))
    return scored.groupBy("token").agg(best.alias("b")).select("token", "b.*")


def correct(df: DataFrame, text: str, rules: Sequence[Rule] = RULES, scoring: Scoring | None = None, most: int = 50, out: str = "corrected", stats: str = "stats") -> DataFrame:
    """``df`` with each token replaced by its best candidate; rule counts are in the statistics."""
    best = select_best(score(generate(distinct_tokens(df, text), rules), scoring))
    fixes = best.where("text <> token").select("token", F.col("text").alias("to"), "reason")
    return apply_fixes(df, text, fixes, [], out, stats, most)
