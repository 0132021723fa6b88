"""Frequency-weighted spelling suggestions through an index of deletions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .lexicon import default_words
from .tokens import apply_fixes, distinct_tokens


def read_dictionary(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(term, cnt) from lines "word count"; the bundled words, each with 1000, where there is no path. A missing file raises."""
    path = path or spark.conf.get("aksharflow.frequencyDictionary", None)
    if not path:
        return spark.createDataFrame([(w, 1000) for w in sorted(default_words())], "term string, cnt bigint")
    return spark.read.csv(path, sep=" ", schema="term string, cnt bigint").where("term is not null")


def add_words(dictionary: DataFrame, words: DataFrame, count: int = 1) -> DataFrame:
    """``dictionary`` with the column ``word`` of ``words``, stripped and without blanks, counted ``count`` each."""
    more = words.select(F.trim("word").alias("term"), F.lit(count).cast("bigint").alias("cnt")).where("term <> ''")
    return dictionary.unionByName(more).groupBy("term").agg(F.sum("cnt").alias("cnt"))


def _deletions(column: str, most: int, prefix: int) -> Column:
    """All strings with up to ``most`` characters fewer than the first ``prefix`` ones, themselves included."""
    out = F.array(F.substring(column, 1, prefix))
    for _ in range(most):
        cut = lambda s: F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))
        out = F.array_distinct(F.concat(out, F.flatten(F.transform(out, cut))))
    return out


def osa(a: Column, b: Column) -> Column:
    """Edit distance where exchanging two neighbours is one step (optimal string alignment), as a fold over the rows of its matrix."""
    n = F.length(b)
    first = F.sequence(F.lit(0), n)
    same = lambda i, j: F.substring(a, i, F.lit(1)) == F.substring(b, j, F.lit(1))

    def row(state: Column, i: Column) -> Column:
        last, before = state["last"], state["before"]

        def cell(acc: Column, j: Column) -> Column:
            step = F.least(
                F.get(last, j) + 1,
                F.get(acc, j - 1) + 1,
                F.get(last, j - 1) + F.when(same(i, j), 0).otherwise(1),
                F.when((i > 1) & (j > 1) & same(i, j - 1) & same(i - 1, j), F.get(before, j - 2) + 1),
            )
            return F.concat(acc, F.array(step))

        now = F.when(n > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.array(i), cell)).otherwise(F.array(i))
        return F.struct(now.alias("last"), last.alias("before"))

    start = F.struct(first.alias("last"), first.alias("before"))
    done = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1))), start, row, lambda s: F.get(s["last"], n))
    return F.when(F.length(a) > 0, done).otherwise(n)


@dataclass
class SymSpell:
    dictionary: DataFrame
    max_distance: int = 2
    prefix: int = 7
    min_token_length: int = 3

    @classmethod
    def default(cls, spark: SparkSession, path: str | None = None) -> SymSpell:
        return cls(read_dictionary(spark, path))

    def size(self) -> int:
        return self.dictionary.count()

    def suggest(self, tokens: DataFrame) -> DataFrame:
        """(token, term, distance, cnt): of the terms within the distance the nearest, then the most frequent, then the first by name."""
        tokens = tokens.select("token").where("token is not null").distinct()
        index = self.dictionary.select("term", "cnt", F.explode(_deletions("term", self.max_distance, self.prefix)).alias("key"))
        asked = tokens.select("token", F.explode(_deletions("token", self.max_distance, self.prefix)).alias("key"))
        pairs = asked.join(index, "key").where(F.abs(F.length("token") - F.length("term")) <= self.max_distance).select("token", "term", "cnt").distinct()
        near = pairs.withColumn("distance", osa(F.col("token"), F.col("term"))).where(F.col("distance") <= self.max_distance)
        best = F.min_by(F.struct("term", "distance", "cnt"), F.struct("distance", (-F.col("cnt")).alias("c"), "term"))
        return near.groupBy("token").agg(best.alias("b")).select("token", "b.*")

    def correct(self, df: DataFrame, text: str, most: int = 20, out: str = "corrected", stats: str = "stats") -> DataFrame:
        """``df`` with unknown tokens replaced by their suggestion; a correction's reason is its distance."""
        known = self.dictionary.select(F.col("term").alias("token"))
        unknown = distinct_tokens(df, text).where(F.length("token") >= self.min_token_length).join(known, "token", "left_anti")
        found = unknown.join(self.suggest(unknown), "token", "left")
        fixes = found.select("token", F.col("term").alias("to"), F.col("distance").cast("string").alias("reason"))
        return apply_fixes(df, text, fixes, [], out, stats, most)
