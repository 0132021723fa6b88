"""Lexicons and the lexicon-guided corrector: token by token in a worker where the words are literal, else as joins over distinct tokens."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from importlib.resources import files

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import patterns as P
from ..functions.repair import normalize_token
from ..functions.texts import SLICE, slices
from .resolver import SPLIT, rebuilt, resolver
from .tokens import FIXED, STATS, apply_fixes, distinct_tokens, tokens_of

#: A word table of at most so many rows is broadcast; a larger one is joined by shuffling.
MOST_BROADCAST = 1_000_000
#: Up to so many words are a literal set in the expressions, looked up by hash without any join.
MOST_LITERAL = 10_000
MODES = ("none", "safe", "aggressive")
_FIX = pa.struct([("to", pa.string()), ("reason", pa.string())])
_EXACT = pa.struct([("norm", pa.string()), ("known", pa.bool_()), ("exact", pa.string())])
_GROUP = pa.struct([*FIXED, ("words", pa.int64()), ("before", pa.int64()), ("after", pa.int64())])


@cache
def default_words() -> frozenset[str]:
    return frozenset((files("aksharflow") / "data/words.txt").read_text(encoding="utf-8").split())


def words_in_file(spark: SparkSession, path: str) -> DataFrame:
    """(word): every token of a text file, whatever its layout."""
    return spark.read.text(path, wholetext=True).select(F.explode(tokens_of(F.col("value"))).alias("word")).distinct()


@dataclass
class Lexicon:
    """Words in general, and words of a context: rows (*by, word) that hold only where the ``by`` columns agree."""

    words: DataFrame
    context: DataFrame | None = None
    by: tuple[str, ...] = ()
    size: int | None = None
    literal: frozenset[str] | None = None

    @classmethod
    def of(cls, spark: SparkSession, words: set[str] | frozenset[str] | None = None, path: str | None = None) -> Lexicon:
        """The given words, or the bundled ones with those of the file at ``path``."""
        words = default_words() if words is None else words
        table = spark.createDataFrame([(w,) for w in sorted(words)], "word string")
        if path:
            table = table.unionByName(words_in_file(spark, path)).distinct()
            return cls(table, size=table.count())
        return cls(table, size=len(words), literal=frozenset(words) if len(words) <= MOST_LITERAL else None)

    def add(self, words: DataFrame) -> Lexicon:
        table = self.words.unionByName(words.select("word")).distinct()
        return Lexicon(table, self.context, self.by, table.count())

    def within(self, context: DataFrame, by: list[str] | tuple[str, ...]) -> Lexicon:
        return Lexicon(self.words, context, tuple(by), self.size)

    def _broadcast(self, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if self.size is not None and self.size <= MOST_BROADCAST else df

    def general(self, *columns: Column) -> DataFrame:
        return self._broadcast(self.words.select(F.col("word"), *columns))

    def contains(self, column: Column) -> Column:
        """Whether a text is one of the literal words."""
        return F.coalesce(column.isin(*sorted(self.literal)), F.lit(False)) if self.literal else F.lit(False)

    @property
    def closed(self) -> bool:
        """Whether the literal words are all that count."""
        return self.literal is not None and self.context is None

    def flag(self, tokens: DataFrame, column: str, out: str) -> DataFrame:
        """``tokens`` with whether ``column`` is a word here."""
        if self.closed:
            return tokens.withColumn(out, self.contains(F.col(column)))
        base = self._broadcast(self.words.select(F.col("word").alias(column), F.lit(True).alias("_general")))
        tokens = tokens.join(base, column, "left")
        hit = F.coalesce(F.col("_general"), F.lit(False))
        if self.context is not None:
            tokens = tokens.join(self.context.select(*self.by, F.col("word").alias(column), F.lit(True).alias("_special")), [*self.by, column], "left")
            hit = hit | F.coalesce(F.col("_special"), F.lit(False))
        return tokens.withColumn(out, hit).drop("_general", "_special")

    def candidates(self, tokens: DataFrame, keys: list[str], *columns: Column) -> DataFrame:
        """``tokens`` joined to every word here that agrees in ``keys``, which ``columns`` compute from ``word``."""
        found = tokens.join(self.general(*columns), keys)
        if self.context is not None:
            extra = self.context.select(*self.by, "word", *columns)
            found = found.unionByName(tokens.join(extra, [*self.by, *keys])).distinct()
        return found


def contextual_lexicon(df: DataFrame, text: str, base: Lexicon, by: list[str] = (), min_frequency: int = 2, min_token_length: int = 4) -> DataFrame:
    """(*by, word): clean tokens that recur within each group and are not in ``base``."""
    tokens = df.select(*by, F.explode(tokens_of(F.col(text))).alias("word"))
    clean = tokens.where((F.length("word") >= min_token_length) & ~F.col("word").rlike(P.SPURIOUS_NUKTA) & ~F.col("word").rlike(P.DUP_MARKS))
    counted = clean.groupBy(*by, "word").agg(F.count("*").alias("n")).where(F.col("n") >= min_frequency)
    return counted.join(base.general(), "word", "left_anti").select(*by, "word")


def swap_j(token: Column) -> Column:
    """The token with short i and ja exchanged back, null where that does not apply."""
    swapped = F.regexp_replace(F.regexp_replace(token, P.LEADING_I, "ज"), P.J_SWAP, f"$1{P.I_SIGN}")
    return F.when((token.rlike(P.LEADING_I) | token.rlike(P.J_SWAP)) & (swapped != token), swapped)


def without_i(token: Column) -> Column:
    """All distinct texts with one short i less (never the last character), empty where the token shows no sign of a stray one."""
    gate = token.rlike(P.STRAY_I[0]) | token.rlike(P.STRAY_I[1]) | token.rlike(P.STRAY_I[2])
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.length(token) - 1, F.lit(1))), lambda i: (F.substring(token, i, F.lit(1)) == P.I_SIGN) & (i < F.length(token)))
    cut = F.transform(at, lambda i: F.concat(F.substring(token, F.lit(1), i - 1), F.substring(token, i + 1, F.length(token))))
    return F.when(gate, F.array_distinct(cut)).otherwise(F.array().cast("array<string>"))


def _any(token: Column, patterns: tuple[str, ...]) -> Column:
    out = token.rlike(patterns[0])
    for p in patterns[1:]:
        out = out | token.rlike(p)
    return out


def resolve_exact(tokens: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``tokens`` with known, norm and exact: the first of the exact rules' proposals (the token itself where it is known)."""
    by = list(lexicon.by)
    if lexicon.closed:
        words = lexicon.literal

        def run(token: pa.Array) -> pa.Array:
            exact = resolver(words, 0, 0).exact
            rows = [exact(t) for t in token.to_pylist()]
            return pa.array([{"norm": n, "known": k, "exact": e} for n, k, e in rows], _EXACT)

        found = F.arrow_udf(run, "struct<norm:string,known:boolean,exact:string>")(F.col("token"))
        return tokens.withColumn("_found", found).select(*by, "token", "_found.norm", "_found.known", "_found.exact")
    t = lexicon.flag(tokens.withColumn("norm", normalize_token(F.col("token"))), "token", "known")
    t = lexicon.flag(t.withColumn("swap", swap_j(F.col("token"))), "swap", "swap_known")
    t = lexicon.flag(t.withColumn("plain", F.when(_any(F.col("token"), P.STRUCTURAL) & (F.col("norm") != F.col("token")), F.col("norm"))), "plain", "plain_known")
    dropped = lexicon.flag(tokens.select(*by, "token", F.explode(without_i(F.col("token"))).alias("shorter")), "shorter", "ok").where("ok")
    dropped = dropped.groupBy(*by, "token").agg(F.min("shorter").alias("shorter"), F.count_distinct("shorter").alias("n")).where("n = 1").drop("n")
    normal = tokens.select(*by, "token", normalize_token(F.col("token")).alias("norm")).where("norm <> ''")
    normal = lexicon.candidates(normal, ["norm"], normalize_token(F.col("word")).alias("norm"))
    normal = normal.groupBy(*by, "token").agg(F.min("word").alias("same_norm"), F.count_distinct("word").alias("n")).where("n = 1").drop("n")
    t = t.join(dropped, [*by, "token"], "left").join(normal, [*by, "token"], "left")
    exact = F.coalesce(F.when(F.col("known"), F.col("token")), F.when(F.col("swap_known"), F.col("swap")), F.col("shorter"), F.when(F.col("plain_known"), F.col("plain")), F.col("same_norm"))
    return t.select(*by, "token", "norm", "known", exact.alias("exact"))


def resolve(tokens: DataFrame, lexicon: Lexicon, max_distance: int = 2, min_token_length: int = 4) -> DataFrame:
    """(*by, token, to, reason) for tokens that are considered; ``to`` is null where no word is the one best."""
    by = list(lexicon.by)
    if lexicon.closed:
        words = lexicon.literal

        def run(token: pa.Array) -> pa.Array:
            fix = resolver(words, max_distance, min_token_length).resolve
            rows = [fix(t) for t in token.to_pylist()]
            return pa.array([None if x is None else {"to": x[0], "reason": x[1]} for x in rows], _FIX)

        found = F.arrow_udf(run, "struct<to:string,reason:string>")(F.col("token"))
        return tokens.withColumn("_found", found).where("_found is not null").select(*by, "token", "_found.to", "_found.reason")
    t = resolve_exact(tokens, lexicon)
    token, norm = F.col("token"), F.col("norm")
    t = t.withColumn("considered", (F.length(token) >= min_token_length) & ~F.col("known") & _any(token, P.CONSIDER))
    open_ = t.where("considered and exact is null")
    size = F.length(norm)
    allowed = F.when(size <= 4, F.lit(min(max_distance, 1))).when(size <= 7, F.lit(min(max_distance, 2))).otherwise(F.lit(min(max_distance, 3)))
    ask = open_.where(~_any(token, P.NO_GUESS) & (norm != "")).withColumn("allowed", allowed).withColumn("first", F.substring(norm, 1, 1))
    # equality on first character and length band makes the fuzzy join a hash join
    ask = ask.select(*by, "token", "norm", "allowed", "first", F.explode(F.sequence(F.greatest(F.lit(1), size - F.col("allowed")), size + F.col("allowed"))).alias("size"))
    word_norm = normalize_token(F.col("word"))
    near = lexicon.candidates(ask, ["first", "size"], F.substring(word_norm, 1, 1).alias("first"), F.length(word_norm).alias("size"), word_norm.alias("word_norm"))
    near = near.withColumn("distance", F.levenshtein("norm", "word_norm")).where("distance <= allowed")
    word = F.col("word")
    last = lambda c: F.substring(c, -1, 1)
    near = near.where(~token.rlike(P.NONSTANDARD_NUKTA) | (last(token) == last(word)))
    near = near.where((F.col("distance") <= 1) | (F.substring(norm, 1, 2) == F.substring("word_norm", 1, 2)) | (F.right(norm, F.lit(3)) == F.right("word_norm", F.lit(3))))
    penalty = (F.substring(token, 1, 2) != F.substring(word, 1, 2)).cast("int") + (last(token) != last(word)).cast("int")
    near = near.withColumn("score", F.struct("distance", penalty.alias("p"), F.abs(F.length(word) - F.length(token)).alias("l")))
    ranked = near.withColumn("rank", F.rank().over(Window.partitionBy(*by, "token").orderBy("score"))).where("rank = 1")
    best = ranked.groupBy(*by, "token").agg(F.min("word").alias("to"), F.count("*").alias("n")).where("n = 1").select(*by, "token", "to")
    fixed = F.col("exact").isNotNull() & (F.col("exact") != token)
    asked = t.where(fixed | F.col("considered")).join(best.withColumnRenamed("to", "guess"), [*by, "token"], "left")
    to = F.when(fixed, F.col("exact")).otherwise(F.col("guess"))
    reason = F.when(fixed, F.lit("exact")).when(F.col("guess").isNotNull(), F.lit("fuzzy"))
    return asked.select(*by, "token", to.alias("to"), reason.alias("reason"))


def correct(df: DataFrame, text: str, lexicon: Lexicon, max_distance: int = 2, min_token_length: int = 4, out: str = "corrected", stats: str = "stats") -> DataFrame:
    """``df`` with corrected text and statistics (at most 20 corrections are listed).

    A literal lexicon travels to the scan, where each distinct token is resolved; otherwise the vocabulary is joined.
    """
    by = list(lexicon.by)
    if lexicon.closed:
        words = lexicon.literal

        def run(text: pa.Array) -> pa.Array:
            fix = resolver(words, max_distance, min_token_length).resolve
            out = []
            for some in slices(text):
                parts = (None if t is None else SPLIT.split(t) for t in some.to_pylist())
                out.append(pa.array([rebuilt(p, {t: fix(t) for t in p[1::2]} if p else {}, 20) for p in parts], FIXED))
            return pa.concat_arrays(out)

        fixed = F.arrow_udf(run, f"struct<text:string,stats:{STATS}>")(F.col(text))
        return df.withColumn("_in_place", fixed).withColumn(stats, F.col("_in_place.stats")).withColumn(out, F.col("_in_place.text")).drop("_in_place")
    fixes = resolve(distinct_tokens(df, text, by), lexicon, max_distance, min_token_length)
    return apply_fixes(df, text, fixes, by, out, stats, 20)


def groups_in_place(lexicon: Lexicon, by: list[str]) -> bool:
    """Whether correct_bootstrapped() can do it: general words are literal, and there are groups."""
    return lexicon.closed and bool(by)


def correct_bootstrapped(df: DataFrame, text: str, lexicon: Lexicon, by: list[str], max_distance: int = 2, min_token_length: int = 4, out: str = "corrected", stats: str = "stats") -> DataFrame:
    """correct() within each group's own contextual_lexicon(): rows are shuffled once, by group, and a group is held at a time.

    Adds context_words, hits_before and hits_after: the number of the group's words, and how many tokens of three letters
    or more of the text and of the corrected text are words in general or of the group. Rows of no group (a null in
    ``by``) have the general words only.
    """
    words, base = lexicon.literal, df.columns

    def done(groups: list[tuple[tuple, list[pa.RecordBatch]]]) -> Iterator[pa.RecordBatch]:
        fix = resolver(words, max_distance, min_token_length).group
        for i in range(0, len(groups), SLICE):
            some = groups[i : i + SLICE]
            rows = [r for key, parts in some for r in fix([t for b in parts for t in b.column(text).to_pylist()], None not in key)]
            table = pa.Table.from_batches([b for _, parts in some for b in parts])
            yield from table.append_column("_in_place", pa.array(rows, _GROUP)).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            keys, ready, start = list(zip(*(batch.column(c).to_pylist() for c in by))), [], 0
            for i in range(1, len(keys) + 1):
                if i < len(keys) and keys[i] == keys[start]:
                    continue
                part = batch.slice(start, i - start)
                if held and keys[start] == key:
                    held.append(part)
                else:
                    if held:
                        ready.append((key, held))
                    key, held = keys[start], [part]
                start = i
            yield from done(ready)
        if held:
            yield from done([(key, held)])

    schema = StructType(df.schema.fields + StructType.fromDDL(f"_in_place struct<text:string,stats:{STATS},words:bigint,before:bigint,after:bigint>").fields)
    got = df.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, schema)
    named = {stats: "_in_place.stats", out: "_in_place.text", "context_words": "_in_place.words", "hits_before": "_in_place.before", "hits_after": "_in_place.after"}
    kept = [F.col(named.pop(c)).alias(c) if c in named else F.col(c) for c in base]
    return got.select(*kept, *(F.col(at).alias(n) for n, at in named.items()))
