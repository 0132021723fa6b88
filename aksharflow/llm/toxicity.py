"""Toxicity by the nearest labelled examples under exact TF-IDF cosine."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .textvec import chunks, span_hashes, words

#: Labelled rows of each class that serve as examples.
EXAMPLES_PER_CLASS = 2000
#: Every word of the examples is a term. One whose presence depends on the label, by chi-square in so many examples at least, has its whole TF-IDF weight, and others the less the lower their chi-square, down to the share LEAST.
MIN_CHI2 = 30.0
MIN_EXAMPLES = 8
LEAST = 0.05
#: Besides words, the first so many bytes of longer words are terms where they depend on the label, for stems with many endings.
STEMS = (4, 5, 6, 7)
#: Weight of a term that every text has: the fewer the telling words of a text, the more it counts in the cosine.
BACKGROUND = 4.0
NEIGHBOURS = 31
BLOCK = 64
#: Terms in more than this share of the examples have no posting list, but a dense column.
COMMON = 1 / 16
THRESHOLD = 0.5
SCHEMA = "doc_id bigint, score double, toxic boolean, votes double, words int, neighbours array<bigint>, cosines array<double>"


@dataclass
class Terms:
    """Terms of some texts: which text, which term (-1 for a word outside the vocabulary), how often."""

    row: np.ndarray
    term: np.ndarray
    times: np.ndarray


@dataclass
class Vocabulary:
    """``hashes`` of words, and after them of stems, each part sorted; ``weight`` is a term's share of its TF-IDF weight."""

    hashes: np.ndarray
    words: int
    weight: np.ndarray
    strong: np.ndarray  # whether a term depends on the label

    def find(self, data: np.ndarray, offs: np.ndarray) -> Terms:
        row, first, stop = words(data, offs)
        if not len(row):
            return Terms(row, row, row)
        size = stop - first
        hashes = span_hashes(data, first, [stop, *(np.minimum(first + k, stop) for k in STEMS)])
        stems = self.hashes[self.words :]
        parts = [self._count(row, hashes[0], self.hashes[: self.words], 0, True)]
        if len(stems):
            low = np.zeros(1 << 16, bool)
            low[stems & np.uint64(0xFFFF)] = True
            own_row, own = [], []
            for k, h in zip(STEMS, hashes[1:]):
                maybe = np.flatnonzero(low[h & np.uint64(0xFFFF)] & (size > k))
                own_row.append(row[maybe])
                own.append(h[maybe])
            parts.append(self._count(np.concatenate(own_row), np.concatenate(own), stems, self.words, False))
        return Terms(*(np.concatenate(x) for x in zip(*parts)))

    @staticmethod
    def _count(row: np.ndarray, h: np.ndarray, known: np.ndarray, base: int, strangers: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        # rows of a chunk fit 20 bits, so that the hash keeps 44
        key, at, times = np.unique((row.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20)), return_index=True, return_counts=True)
        row, h = row[at], h[at]
        place = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
        hit = known[place] == h if len(known) else np.zeros(len(h), bool)
        term = np.where(hit, place + base, -1)
        return (row, term, times) if strangers else (row[hit], term[hit], times[hit])


@dataclass
class Index:
    """Examples in order of their ids, cut into blocks, with unit vectors over all their terms.

    Terms in few examples have posting lists, the others dense columns with the largest weight in each block. ``idf``
    has one entry more than there are terms: that of words outside the vocabulary.
    """

    vocabulary: Vocabulary
    idf: np.ndarray
    ids: np.ndarray
    toxic: np.ndarray
    terms: Terms
    none: float = 0.0  # score of a document that has no term in common with any example
    slope: float = 1.0
    shift: float = 0.0

    def __post_init__(self) -> None:
        n, width = len(self.ids), len(self.vocabulary.hashes)
        self.blocks = -(-n // BLOCK)
        row, term, weight, ground = self.unit(self.terms, n)
        some = term >= 0
        row, term, weight = row[some], term[some], weight[some]
        have = np.bincount(term, minlength=width)
        common = have > max(COMMON * n, 1)
        self.column = np.where(common, np.cumsum(common) - 1, -1)
        dense = np.zeros((self.blocks * BLOCK, int(common.sum()) + 1), np.float32)
        dense[:n, -1] = ground
        own = common[term]
        dense[row[own], self.column[term[own]]] = weight[own]
        self.dense = dense.reshape(self.blocks, BLOCK, dense.shape[1])
        self.most = self.dense.max(axis=1).T if n else np.zeros((dense.shape[1], 0), np.float32)
        row, term, weight = row[~own], term[~own], weight[~own]
        order = np.argsort(term, kind="stable")
        self.example, self.posted = row[order], weight[order]
        self.start = np.searchsorted(term[order], np.arange(width + 1))

    def unit(self, t: Terms, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, weight) with each row's weights of unit length, words outside the vocabulary included, and each row's weight of the background."""
        weight = (1 + np.log(t.times)) * self.idf[t.term] * np.append(self.vocabulary.weight, LEAST)[t.term]
        norm = np.sqrt(np.bincount(t.row, weight * weight, rows) + BACKGROUND**2)
        return t.row, t.term, weight / norm[t.row], np.where(np.bincount(t.row, minlength=rows) > 0, BACKGROUND / norm, 0)

    def search(self, t: Terms, rows: int, k: int, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines), best first, -1 where there are fewer than k with a cosine above 0.

        Posting lists give what the rarer terms add to each example, and so a lower bound of the k-th cosine. A block is
        scored further only for the rows whose bound in it, the most of its examples so far and the block's largest
        weights of the common terms, reaches that: the result is that of scoring every example. Cosines are rounded to
        five digits and ties go to the earlier example. ``skip``: one example a row to leave out.
        """
        n = self.blocks * BLOCK
        best, cosine = np.full((rows, k), -1, np.int64), np.zeros((rows, k))
        if not n:
            return best, cosine
        row, term, weight, ground = self.unit(t, rows)
        some = term >= 0
        row, term, weight = row[some], term[some], weight[some]
        query = np.zeros((rows, self.most.shape[0]), np.float32)
        query[:, -1] = ground
        own = self.column[term] >= 0
        query[row[own], self.column[term[own]]] = weight[own]
        row, term, weight = row[~own], term[~own], weight[~own]
        times = self.start[term + 1] - self.start[term]
        at = np.repeat(self.start[term] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        so_far = np.bincount(np.repeat(row, times) * n + self.example[at], np.repeat(weight, times) * self.posted[at], rows * n).reshape(rows, n)
        if skip is not None:
            so_far[np.arange(rows), skip] = -2
        m = min(k, n)
        least = np.partition(so_far, n - m, axis=1)[:, n - m]
        bound = so_far.reshape(rows, self.blocks, BLOCK).max(axis=2) + query @ self.most
        reach = bound * (1 + 1e-5) + 2e-5 >= np.maximum(least, 0)[:, None]
        scored = np.full((rows, self.blocks, BLOCK), -1.0)
        for b in np.flatnonzero(reach.any(axis=0)):
            q = np.flatnonzero(reach[:, b])
            scored[q, b] = so_far[q, b * BLOCK : (b + 1) * BLOCK] + query[q] @ self.dense[b].T
        whole = np.round(scored.reshape(rows, n) * 1e5).astype(np.int64)
        key = whole * n + np.arange(n - 1, -1, -1)
        top = np.argpartition(-key, m - 1, axis=1)[:, :m]
        top = np.take_along_axis(top, np.argsort(-np.take_along_axis(key, top, 1), axis=1), 1)
        near = np.take_along_axis(whole, top, 1)
        best[:, :m], cosine[:, :m] = np.where(near > 0, top, -1), np.where(near > 0, np.minimum(near, 100_000) / 1e5, 0)
        return best, cosine

    def votes(self, best: np.ndarray, cosine: np.ndarray) -> np.ndarray:
        """The share of toxic votes, each weighing the inverse of the distance 1 - cosine."""
        if not len(self.ids):
            return np.full(len(best), np.nan)
        weight = np.where(best >= 0, 1.0 / (1.0 - cosine + 0.05), 0.0)
        toxic = np.where(best >= 0, self.toxic[np.maximum(best, 0)], 0.0)
        total = weight.sum(axis=1)
        return np.where(total > 0, (weight * toxic).sum(axis=1) / np.where(total > 0, total, 1), np.nan)

    def score(self, votes: np.ndarray) -> np.ndarray:
        return np.where(np.isnan(votes), self.none, 1 / (1 + np.exp(-np.clip(self.slope * np.nan_to_num(votes) + self.shift, -30, 30))))


def _terms(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, whether it is a stem) of each word and of each longer word's stems."""
    row, first, stop = words(data, offs)
    if not len(row):
        return row, np.zeros(0, np.uint64), np.zeros(0, bool)
    size = stop - first
    hashes = span_hashes(data, first, [stop, *(np.minimum(first + k, stop) for k in STEMS)])
    longer = [size > k for k in STEMS]
    rows = [row, *(row[at] for at in longer)]
    return np.concatenate(rows), np.concatenate([hashes[0], *(h[at] for h, at in zip(hashes[1:], longer))]), np.repeat([False, True], [len(row), sum(map(len, rows)) - len(row)])


def _term_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, whether it is a stem) of each distinct term of each text."""
    parts = [np.zeros((3, 0), np.uint64)]
    for at, _, data, offs in chunks(pa.array(texts, pa.string())):
        row, h, stem = _terms(data, offs)
        if len(row):
            parts.append(np.unique(np.stack([(row + at).astype(np.uint64), h, stem.astype(np.uint64)]), axis=1))
    both = np.concatenate(parts, axis=1)
    return both[0].astype(np.int64), both[1], both[2] > 0


def first_of_copies(texts: list[str], sketch: int = 16, share: float = 0.4) -> np.ndarray:
    """Whether no earlier text has ``share`` of a text's smallest ``sketch`` word hashes (of words in at most a tenth of the texts).

    Copies of one text would otherwise make all of its words look like signs of its label.
    """
    text, word, _ = _term_sets(texts)
    _, back, have = np.unique(word, return_inverse=True, return_counts=True)
    rare = have[back] <= max(2, len(texts) // 10)
    text, word = text[rare], word[rare]
    first = np.ones(len(texts), bool)
    holders: dict[int, list[int]] = {}
    for i in range(len(texts)):
        a, b = np.searchsorted(text, [i, i + 1])
        own = word[a:b][:sketch].tolist()  # np.unique left them in ascending order
        met: dict[int, int] = {}
        for w in own:
            for j in holders.get(w, ()):
                met[j] = met.get(j, 0) + 1
        if own and max(met.values(), default=0) >= share * len(own):
            first[i] = False
        else:
            for w in own:
                holders.setdefault(w, []).append(i)
    return first


def choose_terms(texts: list[str], toxic: np.ndarray, min_chi2: float = MIN_CHI2, min_examples: int = MIN_EXAMPLES) -> Vocabulary:
    """Every word of the texts, and the stems that depend on the label."""
    if not texts:
        return Vocabulary(np.zeros(0, np.uint64), 0, np.zeros(0), np.zeros(0, bool))
    row, term, stem = _term_sets(texts)
    n, t, parts = len(texts), float(toxic.sum()), []
    for which in (False, True):
        known, back = np.unique(term[stem == which], return_inverse=True)
        have = np.bincount(back, minlength=len(known)).astype(float)
        a = np.bincount(back, weights=toxic[row[stem == which]], minlength=len(known))
        b, c = have - a, t - a
        d = n - t - b
        chi2 = n * (a * d - b * c) ** 2 / np.maximum((a + b) * (c + d) * (a + c) * (b + d), 1e-9)
        strong = (chi2 >= min_chi2) & (have >= min_examples)
        weight = np.where(strong, 1.0, LEAST + (1 - LEAST) * np.minimum(chi2 / min_chi2, 1) * np.minimum(have / min_examples, 1))
        parts.append((known, weight, strong) if not which else (known[strong], weight[strong], strong[strong]))
    return Vocabulary(np.concatenate([p[0] for p in parts]), len(parts[0][0]), np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts]))


def _platt(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a weighted, slightly regularised logistic fit."""
    a = np.stack([x, np.ones_like(x)], axis=1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + np.diag([1e-2, 1e-3])
        step = np.linalg.solve(h, a.T @ (weight * (y - p)) - np.array([1e-2, 1e-3]) * beta)
        beta += np.clip(step, -5, 5)
        if abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = EXAMPLES_PER_CLASS) -> Index:
    """Index over at most ``per_class`` labelled examples of each class, chosen by hash; document frequencies over all of ``docs``."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    pick = lambda t: known.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
    chosen = pick(0).unionByName(pick(1))
    # at most 2 x per_class ids: broadcast whatever the size of the corpus
    rows = docs.select("doc_id", F.lower(text_of(docs)).alias("t")).join(F.broadcast(chosen), "doc_id").groupBy("t").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic")).orderBy("doc_id").collect()
    texts, ids = [r["t"] for r in rows], np.array([r["doc_id"] for r in rows], np.int64)
    toxic = np.array([r["toxic"] for r in rows], np.float64)
    if texts:
        first = first_of_copies(texts)
        texts, ids, toxic = [t for t, ok in zip(texts, first) if ok], ids[first], toxic[first]
    vocabulary = choose_terms(texts, toxic)
    width = len(vocabulary.hashes)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, np.zeros(width, np.int64)
        for batch in batches:
            for at, end, data, offs in chunks(batch.column(0)):
                n += end - at
                term = shared.value.find(data, offs).term
                df += np.bincount(term[term >= 0], minlength=width)
        have = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1], have])), pa.array(np.concatenate([[n], df[have]]))], names=["term", "n"])

    n, df = 0, np.zeros(width, np.int64)
    parts = docs.select(F.lower(text_of(docs)).alias("t")).mapInArrow(frequencies, "term bigint, n bigint")
    for r in parts.groupBy("term").agg(F.sum("n").alias("n")).collect():  # a row a term of the examples
        if r["term"] < 0:
            n = r["n"]
        else:
            df[r["term"]] = r["n"]
    idf = np.log((1 + n) / (1 + np.append(df, 0))) + 1
    index = Index(vocabulary, idf, ids, toxic, _found(vocabulary, texts))
    weight = np.where(toxic > 0, sizes.get(1, 0) / max(1, toxic.sum()), sizes.get(0, 0) / max(1, (1 - toxic).sum()))
    if texts:
        votes = []
        for lo in range(0, len(texts), 256):
            best, cosine = index.search(_found(vocabulary, texts[lo : lo + 256]), len(texts[lo : lo + 256]), NEIGHBOURS, skip=np.arange(lo, min(len(texts), lo + 256)))
            votes.append(index.votes(best, cosine))
        votes = np.concatenate(votes)
        lone = np.isnan(votes)
        index.none = float((weight * toxic)[lone].sum() / max(weight[lone].sum(), 1e-9)) if lone.any() else 0.0
        index.slope, index.shift = _platt(np.nan_to_num(votes, nan=0.5), toxic, weight)
    return index


def _found(vocabulary: Vocabulary, texts: list[str]) -> Terms:
    parts = []
    for at, _, data, offs in chunks(pa.array(texts, pa.string())):
        t = vocabulary.find(data, offs)
        parts.append((t.row + at, t.term, t.times))
    return Terms(*(np.concatenate(x) for x in zip(*parts))) if parts else Terms(*[np.zeros(0, np.int64)] * 3)


def _scorer(index: Index, k: int, threshold: float):
    def rows(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        n = len(text)
        best, cosine, hits = np.full((n, k), -1, np.int64), np.zeros((n, k)), np.zeros(n, np.int32)
        for at, end, data, offs in chunks(text, 1 << 19):
            for lo in range(at, end, 256):
                hi = min(end, lo + 256)
                a, b = offs[lo - at], offs[hi - at]
                t = index.vocabulary.find(data[a:b], offs[lo - at : hi - at + 1] - a)
                strong = np.append(index.vocabulary.strong, False)[t.term]
                hits[lo:hi] = np.bincount(t.row[strong], t.times[strong], hi - lo)
                best[lo:hi], cosine[lo:hi] = index.search(t, hi - lo, k)
        votes = index.votes(best, cosine)
        return np.round(index.score(votes), 6), votes, hits, best, cosine

    def arrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, votes, hits, best, cosine = rows(batch.column(1))
            found = best >= 0
            cuts = np.concatenate([[0], np.cumsum(found.sum(axis=1))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(score),
                    pa.array(score >= threshold),
                    pa.array(np.round(votes, 6), mask=np.isnan(votes)),
                    pa.array(hits),
                    pa.ListArray.from_arrays(cuts, pa.array(index.ids[best[found]] if len(index.ids) else np.zeros(0, np.int64))),
                    pa.ListArray.from_arrays(cuts, pa.array(cosine[found])),
                ],
                names=["doc_id", "score", "toxic", "votes", "words", "neighbours", "cosines"],
            )

    def flag(text: pa.Array) -> pa.Array:
        return pa.array(rows(text)[0] >= threshold)

    return arrow, flag


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = EXAMPLES_PER_CLASS, k: int = NEIGHBOURS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, toxic, votes, words, neighbours, cosines) for each row of ``docs``.

    The ``k`` examples nearest by exact TF-IDF cosine vote, each with the inverse of its distance; ``score`` is the
    vote calibrated on the examples themselves (each scored without itself), ``toxic`` whether it reaches
    ``threshold``. All words of a text count in its cosines; those that no example has only lengthen its vector.
    neighbours and cosines are the evidence, best first; ``words`` counts occurrences of the terms that depend on the
    label. A text that has no word in common with any example (null and empty ones too) has no neighbours, null votes
    and the toxic share of such examples as its score. Equal cosines rank by doc_id. Very long texts count whole.
    Labels: rows with a null are ignored, and a doc_id labelled both ways counts as toxic. Without usable labels every
    score is 0. Only doc_id and text are read. Each row is scored by itself; repeated rows get equal scores.
    """
    arrow, _ = _scorer(fit(docs, labels, per_class), k, threshold)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.lower(text_of(docs)).alias("t")).mapInArrow(arrow, SCHEMA)


def drop_toxic(docs: DataFrame, labels: DataFrame, per_class: int = EXAMPLES_PER_CLASS, k: int = NEIGHBOURS, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that toxicity() calls toxic. Columns are unchanged; nothing is shuffled."""
    _, flag = _scorer(fit(docs, labels, per_class), k, threshold)
    judge = F.arrow_udf(flag, "boolean")
    return docs.select(F.struct("*").alias("row"), F.lower(text_of(docs)).alias("t")).withColumn("rejected", judge("t")).where("not rejected").select("row.*")
