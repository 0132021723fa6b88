"""Quality by a regularised quadratic discriminant over document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .textvec import chunks, splitmix, word_hashes, words

#: Labelled rows of each class to which the discriminant is fitted.
ROWS_PER_CLASS = 4000
#: Shares of the pooled covariance and of a multiple of the identity in each class covariance.
TO_POOLED = 0.1
TO_SPHERE = 0.02
THRESHOLD = 0.5
FEATURES = ("log_words", "word_length", "upper", "digits", "symbols", "punctuation", "breaks", "distinct_words", "distinct_pairs", "longest_run")
SCHEMA = "doc_id bigint, log_odds double, probability double, keep boolean"

_UPPER, _LETTER, _DIGIT, _SYMBOL, _POINT, _BREAK = (1 << i for i in range(6))
_CLASS = np.zeros(256, np.uint8)
for _b in range(256):
    _c = chr(_b)
    if _b >= 128 or _c.isalpha():
        _CLASS[_b] = _LETTER | (_UPPER if _b < 128 and _c.isupper() else 0)
    elif _c.isdigit():
        _CLASS[_b] = _DIGIT
    elif _c == "\n":
        _CLASS[_b] = _BREAK
    elif _c in ".,;:?'\"-":
        _CLASS[_b] = _POINT
    elif not _c.isspace():
        _CLASS[_b] = _SYMBOL


def _distinct(row: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
    key = np.unique((row.astype(np.uint64) << np.uint64(44)) | (value >> np.uint64(20)))
    return np.bincount((key >> np.uint64(44)).astype(np.int64), minlength=rows)


def statistics(text: pa.Array) -> np.ndarray:
    """(rows x FEATURES): logs of counts and of smoothed ratios over each whole text."""
    out = np.zeros((len(text), len(FEATURES)))
    for at, end, data, offs in chunks(text):
        n = end - at
        size = np.diff(offs)
        kind = _CLASS[data]

        def count(bit: int) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum((kind & bit) != 0, dtype=np.int64)])
            return total[offs[1:]] - total[offs[:-1]]

        row, first, stop = words(data, offs)
        have = np.bincount(row, minlength=n)
        spans = np.bincount(row, weights=stop - first, minlength=n)
        h = word_hashes(data, first, stop) if len(row) else np.zeros(0, np.uint64)
        together = row[1:] == row[:-1]
        pairs = _distinct(row[1:][together], splitmix(h[1:] ^ (h[:-1] << np.uint64(1)))[together], n) if len(row) > 1 else np.zeros(n)
        longest = np.zeros(n)
        np.maximum.at(longest, row, stop - first)
        ratio = lambda a, b: np.log((a + 0.1) / (b + 1.0))
        letters = count(_LETTER)
        out[at:end] = np.stack(
            [
                np.log1p(have),
                np.log1p(spans / np.maximum(have, 1)),
                ratio(count(_UPPER), letters),
                ratio(count(_DIGIT), size),
                ratio(count(_SYMBOL), size),
                ratio(count(_POINT), size),
                ratio(count(_BREAK), size),
                np.log((_distinct(row, h, n) + 1.0) / (have + 1.0) ** 0.7),
                np.log((pairs + 1.0) / np.maximum(have, 1)),
                np.log1p(longest),
            ],
            axis=1,
        )
    return out


@dataclass
class Discriminant:
    """Standardisation, and by class (0, 1): mean, inverse Cholesky factor, log determinant and log prior."""

    centre: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]
    logdets: list[float]
    priors: list[float]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale
        density = []
        for mean, factor, logdet, prior in zip(self.means, self.factors, self.logdets, self.priors):
            y = (z - mean) @ factor.T
            density.append(prior - 0.5 * (logdet + (y * y).sum(axis=1)))
        return density[1] - density[0]


def discriminant(x: np.ndarray, good: np.ndarray, share: float | None = None, to_pooled: float = TO_POOLED, to_sphere: float = TO_SPHERE) -> Discriminant:
    """Fitted to the rows ``x`` with the labels ``good``; ``share``: of good rows where these come from."""
    d = x.shape[1]
    centre = x.mean(axis=0) if len(x) else np.zeros(d)
    scale = np.maximum(x.std(axis=0), 1e-6) if len(x) else np.ones(d)
    z = (x - centre) / scale
    groups = [z[good == 0], z[good == 1]]
    means = [g.mean(axis=0) if len(g) else np.zeros(d) for g in groups]
    scatter = [(g - m).T @ (g - m) for g, m in zip(groups, means)]
    pooled = sum(scatter) / max(1, len(z) - 2) if len(z) else np.eye(d)
    share = min(max(share if share is not None else float(np.mean(good)) if len(good) else 0.5, 1e-3), 1 - 1e-3)
    factors, logdets = [], []
    for g, s in zip(groups, scatter):
        cov = s / max(1, len(g) - 1) if len(g) > 1 else pooled
        cov = (1 - to_pooled) * cov + to_pooled * pooled
        cov = (1 - to_sphere) * cov + to_sphere * max(np.trace(cov) / d, 1e-3) * np.eye(d)
        low = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(low))
        logdets.append(2 * float(np.log(np.diag(low)).sum()))
    return Discriminant(centre, scale, means, factors, logdets, [float(np.log(1 - share)), float(np.log(share))])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = ROWS_PER_CLASS) -> Discriminant:
    """Fitted to at most ``per_class`` labelled rows of each class, chosen by hash; the prior comes from all labels."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") > 0).cast("int").alias("good"))
    sizes = {r["good"]: r["count"] for r in known.groupBy("good").count().collect()}
    pick = lambda q: known.where(F.col("good") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
    chosen = pick(0).unionByName(pick(1))
    measure = F.arrow_udf(lambda text: pa.array(statistics(text).tolist(), pa.list_(pa.float64())), "array<double>")
    # at most 2 x per_class ids: broadcast whatever the size of the corpus
    rows = docs.select("doc_id", text_of(docs).alias("t")).join(F.broadcast(chosen), "doc_id").select("doc_id", "good", measure("t").alias("x")).orderBy("doc_id", "x").collect()
    x = np.array([r["x"] for r in rows]).reshape(-1, len(FEATURES))
    total = sum(sizes.values())
    return discriminant(x, np.array([r["good"] for r in rows]), sizes.get(1, 0) / total if total else None)


def quality(docs: DataFrame, labels: DataFrame, per_class: int = ROWS_PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, log_odds, probability, keep) for each row of ``docs``.

    ``log_odds`` is the difference of the two classes' log densities (Mahalanobis distance and determinant through
    Cholesky factors that are made once) and log priors; ``keep`` whether the probability reaches ``threshold``. Null
    texts are scored as empty ones; an empty text has the statistics of zero counts. Labels with a null are ignored, and
    a doc_id labelled both ways counts as bad. With no labels of a class that class has the other's covariance around 0.
    Each row is scored by itself; repeated rows get equal scores. An empty table gives no rows. Nothing is shuffled but
    the labels.
    """
    model = fit(docs, labels, per_class)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            odds = np.round(model.log_odds(statistics(batch.column(1))), 6)
            p = 1 / (1 + np.exp(-np.clip(odds, -700, 700)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(odds), pa.array(np.round(p, 6)), pa.array(p >= threshold)], names=["doc_id", "log_odds", "probability", "keep"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of(docs).alias("t")).mapInArrow(score, SCHEMA)
