"""Tokens in place: distinct tokens are resolved once, each text is rebuilt within its row."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P

#: So many resolved tokens at most are sent to the scan, about 100 bytes each.
MOST_CARRIED = 500_000
STATS = "struct<tokens_seen:int,tokens_considered:int,corrected_tokens:int,corrections:array<struct<from:string,to:string,reason:string>>,rule_counts:map<string,int>>"
CORRECTION = pa.struct([("from", pa.string()), ("to", pa.string()), ("reason", pa.string())])
FIXED = pa.struct(
    [
        ("text", pa.string()),
        ("stats", pa.struct([("tokens_seen", pa.int32()), ("tokens_considered", pa.int32()), ("corrected_tokens", pa.int32()), ("corrections", pa.list_(CORRECTION)), ("rule_counts", pa.map_(pa.string(), pa.int32()))])),
    ]
)


def tokens_of(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(P.TOKENS), F.lit(0)), F.array().cast("array<string>"))


def distinct_tokens(df: DataFrame, text: str, by: list[str] = ()) -> DataFrame:
    """(*by, token): combined before the shuffle, so that what moves is the vocabulary and not the text."""
    return df.select(*by, F.explode(F.array_distinct(tokens_of(F.col(text)))).alias("token")).distinct()


def apply_fixes(df: DataFrame, text: str, fixes: DataFrame, by: list[str] = (), out: str = "corrected", stats: str = "stats", most: int = 20, most_carried: int = MOST_CARRIED) -> DataFrame:
    """``df`` with tokens replaced and what was done.

    ``fixes`` (*by, token, to, reason) lists tokens that were considered; ``to`` is null where they stay. Up to
    ``most_carried`` of them travel to the scan, where texts are rebuilt in place: no text is shuffled. Beyond that
    bound each text's own fixes are joined back to it by its digest, which does shuffle texts. Separators are kept.
    """
    some = fixes.select(*by, "token", "to", "reason").limit(most_carried + 1).collect()
    if len(some) <= most_carried:
        return _fix_in_place(df, text, some, list(by), out, stats, most)
    return _fix_by_digest(df, text, fixes, by, out, stats, most)


def _fix_in_place(df: DataFrame, text: str, fixes: list, by: list[str], out: str, stats: str, most: int) -> DataFrame:
    table: dict[tuple, tuple] = {(*(r[c] for c in by), r["token"]): (r["to"], r["reason"]) for r in fixes}
    shared = df.sparkSession.sparkContext.broadcast(table)
    pattern = re.compile(P.TOKENS)

    def fix(text: pa.Array, *keys: pa.Array) -> pa.Array:
        known, rows = shared.value, []
        for t, *key in zip(text.to_pylist(), *(k.to_pylist() for k in keys)):
            seen, considered, done, counts = 0, 0, [], {}

            def put(m: re.Match) -> str:
                nonlocal seen, considered
                seen += 1
                token = m.group()
                found = known.get((*key, token))
                if found is None:
                    return token
                considered += 1
                to, reason = found
                if to is None:
                    return token
                done.append({"from": token, "to": to, "reason": reason})
                counts[reason] = counts.get(reason, 0) + 1
                return to

            fixed = None if t is None else pattern.sub(put, t)
            rows.append({"text": fixed, "stats": {"tokens_seen": seen, "tokens_considered": considered, "corrected_tokens": len(done), "corrections": done[:most], "rule_counts": list(counts.items())}})
        return pa.array(rows, FIXED)

    run = F.arrow_udf(fix, f"struct<text:string,stats:{STATS}>")
    return df.withColumn("_in_place", run(F.col(text), *(F.col(c) for c in by))).withColumn(stats, F.col("_in_place.stats")).withColumn(out, F.col("_in_place.text")).drop("_in_place")


def _fix_by_digest(df: DataFrame, text: str, fixes: DataFrame, by: list[str], out: str, stats: str, most: int) -> DataFrame:
    own = df.select(*by, F.md5(F.col(text).cast("binary")).alias("_text"), F.explode(F.array_distinct(tokens_of(F.col(text)))).alias("token")).distinct()
    maps = (
        own.join(fixes, [*by, "token"])
        .groupBy(*by, "_text")
        .agg(F.map_from_entries(F.collect_list(F.struct("token", F.struct("to", "reason")))).alias("_fixes"))
    )
    keyed = df.withColumn("_text", F.md5(F.col(text).cast("binary")))
    # both sides come from ``df``: other names keep the join's columns apart
    maps = maps.select(F.col("_text").alias("_digest"), *(F.col(c).alias(f"_by{i}") for i, c in enumerate(by)), "_fixes")
    match = F.col("_text") == F.col("_digest")
    for i, c in enumerate(by):
        match = match & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    joined = keyed.join(maps, match, "left").drop("_text", "_digest", *(f"_by{i}" for i in range(len(by))))
    fix = lambda x: F.try_element_at("_fixes", x)
    pieces = F.regexp_extract_all(F.col(text), F.lit(P.PIECES), F.lit(0))
    rebuilt = F.array_join(F.transform(pieces, lambda x: F.coalesce(fix(x)["to"], x)), "")
    considered = F.filter(tokens_of(F.col(text)), lambda x: fix(x).isNotNull())
    changed = F.filter(considered, lambda x: fix(x)["to"].isNotNull())
    corrections = F.transform(changed, lambda x: F.struct(x.alias("from"), fix(x)["to"].alias("to"), fix(x)["reason"].alias("reason")))
    none = F.array().cast("array<struct<from:string,to:string,reason:string>>")
    has = F.col("_fixes").isNotNull()
    return (
        joined.withColumn("_done", F.when(has, corrections).otherwise(none))
        .withColumn(out, F.when(has, rebuilt).otherwise(F.col(text)))
        .withColumn(
            stats,
            F.struct(
                F.coalesce(F.regexp_count(F.col(text), F.lit(P.TOKENS)), F.lit(0)).alias("tokens_seen"),
                F.when(has, F.size(considered)).otherwise(0).alias("tokens_considered"),
                F.size("_done").alias("corrected_tokens"),
                F.slice("_done", 1, most).alias("corrections"),
                F.map_from_entries(
                    F.transform(F.array_distinct(F.transform("_done", lambda c: c["reason"])), lambda r: F.struct(r, F.size(F.filter("_done", lambda c: c["reason"] == r))))
                ).alias("rule_counts"),
            ),
        )
        .drop("_fixes", "_done")
    )
