"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage_table, word_count

NO_SOURCE = "(none)"
#: Shares of the sources are the power ALPHA of their tokens where no weights are given.
ALPHA = 0.5
ITERATIONS = 40
TOLERANCE = 1e-12
#: Above so many sources their multipliers are joined without a broadcast.
MOST_BROADCAST = 100_000


def _source() -> Column:
    return F.coalesce(F.col("source").cast("string"), F.lit(NO_SOURCE))


def _uniform(doc_id: Column) -> Column:
    """A number in [0, 1) that depends on the document alone."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


def solve(lengths: DataFrame, weights: dict[str, float] | None = None, budget: float | None = None, alpha: float = ALPHA) -> dict[str, float | None]:
    """Multipliers by source of the table lengths(source, tokens, docs); None for a source whose target is 0.

    Minimises sum(r log r - r) over the rates r under sum(r * tokens) = target for each source, through the convex
    dual: r = exp(multiplier * tokens). Each Newton iteration is one aggregation over ``lengths``, which gives every
    source's dual gradient and curvature; the driver holds one number a source. Steps are taken on the logarithm of
    the constraint, which is convex too and can't overflow from 0.
    """
    lengths = lengths.where("tokens > 0")
    total = {r["source"]: float(r["t"]) for r in lengths.groupBy("source").agg(F.sum(F.col("tokens") * F.col("docs")).alias("t")).collect()}
    if not total:
        return {}
    share = {s: max(0.0, float(weights.get(s) or 0.0)) for s in total} if weights is not None else {s: t**alpha for s, t in total.items()}
    whole = sum(share.values())
    target = {s: (budget if budget is not None else sum(total.values())) * share[s] / whole if whole else 0.0 for s in total}
    at = {s: 0.0 for s in total if target[s] > 0}
    spark = lengths.sparkSession
    for _ in range(ITERATIONS):
        if not at:
            break
        now = spark.createDataFrame(sorted(at.items()), "source string, multiplier double")
        joined = lengths.join(F.broadcast(now) if len(at) <= MOST_BROADCAST else now, "source")
        mass = F.col("docs") * F.col("tokens") * F.exp(F.col("multiplier") * F.col("tokens"))
        rows = joined.groupBy("source").agg(F.sum(mass).alias("s"), F.sum(mass * F.col("tokens")).alias("h")).collect()
        worst = 0.0
        for r in rows:
            gap = math.log(target[r["source"]]) - math.log(r["s"])
            worst = max(worst, abs(gap))
            at[r["source"]] += gap * r["s"] / r["h"]
        if worst < TOLERANCE:
            break
    return {s: at.get(s) for s in total}


def _rated(docs: DataFrame, weights: dict[str, float] | None, budget: float | None, alpha: float) -> DataFrame:
    """(row, doc_id, source, tokens, rate, copies) with the whole input row as the struct ``row``."""
    tokens = word_count(F.col("text").cast("string")).cast("bigint")
    counts = docs.select(_source().alias("source"), tokens.alias("tokens")).groupBy("source", "tokens").agg(F.count("*").alias("docs"))
    lengths = stage_table(counts, "lengths")
    found = solve(lengths, weights, budget, alpha)
    table = docs.sparkSession.createDataFrame([(s, m, m is None) for s, m in sorted(found.items())], "s string, multiplier double, none boolean")
    if len(found) <= MOST_BROADCAST:
        table = F.broadcast(table)
    base = docs.select(F.struct("*").alias("row"), "doc_id", _source().alias("source"), tokens.alias("tokens"))
    rate = F.when((F.col("tokens") > 0) & F.col("none"), F.lit(0.0)).otherwise(F.exp(F.coalesce(F.col("multiplier"), F.lit(0.0)) * F.col("tokens")))
    rated = base.join(table, F.col("source") == F.col("s"), "left").withColumn("rate", rate)
    return rated.withColumn("copies", F.floor(F.col("rate") + _uniform(F.col("doc_id"))).cast("bigint")).select("row", "doc_id", "source", "tokens", "rate", "copies")


def mixing_rates(docs: DataFrame, weights: dict[str, float] | None = None, budget: float | None = None, alpha: float = ALPHA) -> DataFrame:
    """(doc_id, source, tokens, rate, copies) for each row of ``docs``.

    ``weights`` are the sources' target shares of ``budget`` tokens (default: the tokens there are); without weights,
    shares go by the power ``alpha`` of the sources' tokens. ``copies`` is the rate, rounded up or down by a number
    that a hash of doc_id gives, so that its expectation is the rate. A null source is one source of its own; a source
    missing from ``weights``, or with a weight of 0, gets rate 0; one without documents gets nothing. Texts without a
    token (null and empty ones too) have rate 1 in any source. Repeated rows get equal copies. An empty table gives no rows.
    """
    return _rated(docs, weights, budget, alpha).select("doc_id", "source", "tokens", F.round("rate", 6).alias("rate"), "copies")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, budget: float | None = None, alpha: float = ALPHA) -> DataFrame:
    """``docs`` with each row as often as mixing_rates gives it copies. Columns are unchanged; no row is shuffled."""
    rated = _rated(docs, weights, budget, alpha).where("copies > 0")
    return rated.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("n")).select("row.*")


ORACLE_SQL = f"""
with recursive d as (select doc_id, coalesce(source, '{NO_SOURCE}') as source, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r\\f\\v]+')) as tokens from documents),
lengths as (select source, tokens::double as n, count(*)::double as c from d where tokens > 0 group by source, tokens),
total as (select source, sum(n * c) as t from lengths group by source),
target as (select source, (select sum(t) from total) * pow(t, {ALPHA}) / (select sum(pow(t, {ALPHA})) from total) as goal from total),
newton as (
  select 0 as i, source, 0.0::double as m from total
  union all
  select any_value(w.i) + 1, w.source, any_value(w.m) + (ln(any_value(g.goal)) - ln(sum(l.c * l.n * exp(w.m * l.n)))) * sum(l.c * l.n * exp(w.m * l.n)) / sum(l.c * l.n * l.n * exp(w.m * l.n))
  from newton w join lengths l on l.source = w.source join target g on g.source = w.source where w.i < {ITERATIONS} group by w.source
),
final as (select source, m from newton where i = {ITERATIONS}),
r as (select d.*, exp(coalesce(m, 0) * tokens) as rate from d left join final on final.source = d.source)
select doc_id, source, tokens, round(rate, 6) as rate, floor(rate + ('0x' || substr(md5(coalesce(doc_id::varchar, 'null')), 1, 8))::bigint / 4294967296.0)::bigint as copies from r
"""
