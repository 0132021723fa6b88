"""Frequency lexicons, character n-grams and a character language model with backoff."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tokens import tokens_of

#: n-grams of so many characters at most are broadcast.
MOST_BROADCAST_ORDER = 3


def counted_tokens(df: DataFrame, text: str, times: str | None = None) -> DataFrame:
    """(token, n), combined before the shuffle; a text counts ``times`` over where that column is given."""
    weight = F.lit(1).cast("bigint") if times is None else F.col(times)
    return df.select(F.explode(tokens_of(F.col(text))).alias("token"), weight.alias("_n")).groupBy("token").agg(F.sum("_n").alias("n"))


def token_frequencies(df: DataFrame, text: str, min_count: int = 5, min_token_length: int = 2, times: str | None = None) -> DataFrame:
    """(term, cnt) of tokens, combined before the shuffle."""
    counted = counted_tokens(df, text, times).where((F.length("token") >= min_token_length) & (F.col("n") >= min_count))
    return counted.select(F.col("token").alias("term"), F.col("n").alias("cnt"))


def write_dictionary(frequencies: DataFrame, path: str) -> None:
    """Lines "term count", the most frequent first, equal counts by term."""
    frequencies.orderBy(F.desc("cnt"), "term").select(F.concat_ws(" ", "term", F.col("cnt").cast("string")).alias("value")).write.text(path)


def spaced_tokens(df: DataFrame, text: str) -> DataFrame:
    """(value): one token a row, its characters separated by spaces."""
    return df.select(F.explode(tokens_of(F.col(text))).alias("t")).select(F.array_join(F.split("t", ""), " ").alias("value"))


def char_ngrams(df: DataFrame, text: str, order: int = 3, times: str | None = None) -> DataFrame:
    """(n, gram, cnt): n-grams of 1 to ``order`` characters within tokens; tokens are counted before they are cut up, once for all n."""
    sizes = counted_tokens(df, text, times).select("token", F.col("n").alias("c"), F.explode(F.sequence(F.lit(1), F.lit(order))).alias("n")).where(F.length("token") >= F.col("n"))
    at = F.explode(F.sequence(F.lit(1), F.length("token") - F.col("n") + 1)).alias("i")
    return sizes.select("token", "c", "n", at).groupBy("n", F.substring("token", F.col("i"), F.col("n")).alias("gram")).agg(F.sum("c").alias("cnt"))


def train_char_lm(ngrams: DataFrame, backoff: float = 0.4) -> DataFrame:
    """(gram, logp): log of each n-gram's share among those with its beginning; shorter ones are weighed down when backed off to."""
    context = F.substring("gram", F.lit(1), F.col("n") - 1)
    total = F.sum("cnt").over(Window.partitionBy("n", context))
    return ngrams.select("n", "gram", F.log(F.col("cnt") / total).alias("logp"), F.lit(backoff).alias("backoff"))


def score_tokens(tokens: DataFrame, model: DataFrame, order: int = 3, floor: float = -12.0) -> DataFrame:
    """(token, log_prob): the mean log probability of a token's characters, by the longest known n-gram that ends at each."""
    asked = tokens.select("token").distinct().where("token <> ''").select("token", F.explode(F.sequence(F.lit(1), F.length("token"))).alias("i"))
    for n in range(1, order + 1):
        gram = F.when(F.col("i") >= n, F.substring("token", F.col("i") - (n - 1), F.lit(n)))
        part = model.where(F.col("n") == n).select(F.col("gram").alias("_gram"), (F.col("logp")).alias("_logp"), F.log("backoff").alias("_backoff"))
        # the script bounds the short n-grams, at any size of the corpus: at most 116**3
        asked = asked.join(F.broadcast(part) if n <= MOST_BROADCAST_ORDER else part, gram == F.col("_gram"), "left")
        weighed = F.col("_logp") + F.col("_backoff") * (F.least(F.col("i"), F.lit(order)) - n)
        asked = asked.withColumn(f"_{n}", weighed).drop("_gram", "_logp", "_backoff")
    best = F.coalesce(*(F.col(f"_{n}") for n in range(order, 0, -1)), F.lit(floor))
    return asked.groupBy("token").agg((F.sum(best) / F.count("*")).alias("log_prob"))


def lm_score(log_prob: Column, weight: float = 0.05) -> Column:
    return log_prob * F.lit(weight)
