"""Language identification by a blended-spectrum string kernel."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of
from .textvec import chunks

#: Labelled documents of each language for the regression, and how many of these are landmarks.
ROWS_PER_LANGUAGE = 300
LANDMARKS_PER_LANGUAGE = 32
#: Of all languages together; with many of them each has fewer, one row at least.
MOST_ROWS, MOST_LANDMARKS = 12_000, 1024
RIDGE = 1e-2
UNKNOWN = "und"
#: Presence features: bytes, then hashed pairs, then hashed triples.
PAIRS, TRIPLES = 1 << 13, 1 << 14
WIDTH = 256 + PAIRS + TRIPLES
SCHEMA = "doc_id bigint, language string, margin double, scores array<double>, agrees boolean"


def presence(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """(rows x WIDTH): whether each n-gram of 1 to 3 bytes (hashed from 2 on) occurs in the text."""
    n = len(offs) - 1
    out = np.zeros((n, WIDTH), np.float32)
    if not len(data):
        return out
    flat = out.reshape(-1)
    base = np.repeat(np.arange(n, dtype=np.int64) * WIDTH, np.diff(offs))
    flat[base + data] = 1
    two = data[:-1].astype(np.uint32) << np.uint32(8) | data[1:]
    same = base[1:] == base[:-1]
    at = ((two * np.uint32(0x9E3779B1)) >> np.uint32(32 - 13)).astype(np.int64)
    flat[(base[1:] + 256 + at)[same]] = 1
    three = two[:-1] << np.uint32(8) | data[2:]
    same = base[2:] == base[:-2]
    at = ((three * np.uint32(0x85EBCA6B)) >> np.uint32(32 - 14)).astype(np.int64)
    flat[(base[2:] + 256 + PAIRS + at)[same]] = 1
    return out


def presences(text: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    for at, end, data, offs in chunks(text, 1 << 18):
        for lo in range(at, end, 64):
            hi = min(end, lo + 64)
            a, b = offs[lo - at], offs[hi - at]
            yield lo, hi, presence(data[a:b], offs[lo - at : hi - at + 1] - a)


@dataclass
class Classifier:
    """``weights`` (WIDTH x languages) folds the landmarks' presences, the Nyström map and the ridge solution together."""

    languages: list[str]
    weights: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        norm = np.sqrt(x.sum(axis=1, keepdims=True))
        return (x @ self.weights) / np.where(norm > 0, norm, 1)


def train(blocks: Callable[[], Iterator[np.ndarray]], labels: list[str], landmark: np.ndarray, ridge: float = RIDGE) -> Classifier:
    """One-versus-rest ridge regression on the Nyström features that the rows marked ``landmark`` span.

    ``blocks`` gives the rows' presences, some at a time and as often as it is asked: only the landmarks' stay.
    """
    languages = sorted(set(labels))
    if not languages:
        return Classifier([], np.zeros((WIDTH, 0), np.float32))
    unit = lambda x: x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
    at, picked = 0, []
    for x in blocks():
        picked.append(unit(x[landmark[at : at + len(x)]]))
        at += len(x)
    marks = np.concatenate(picked)
    value, vector = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    keep = value > 1e-6 * max(value.max(), 1e-12)
    root = vector[:, keep] / np.sqrt(value[keep])
    z = np.concatenate([(unit(x) @ marks.T) @ root for x in blocks()])
    y = np.where(np.array(labels)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    at, times = np.unique(np.searchsorted(languages, labels), return_inverse=True, return_counts=True)[1:]
    weight = 1.0 / times[at]
    beta = np.linalg.solve(z.T @ (z * weight[:, None]) + ridge * np.eye(z.shape[1]), z.T @ (y * weight[:, None]))
    return Classifier(languages, (marks.T @ (root @ beta)).astype(np.float32))


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The presences of a text as bits: what the driver needs of it, at any length."""
    for batch in batches:
        rows = []
        for _, _, x in presences(batch.column(2)):
            rows += [r.tobytes() for r in np.packbits(x > 0, axis=1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], names=["lang", "h", "x"])


def fit(docs: DataFrame, per_language: int = ROWS_PER_LANGUAGE, landmarks: int = LANDMARKS_PER_LANGUAGE, most_rows: int = MOST_ROWS, most_landmarks: int = MOST_LANDMARKS) -> Classifier:
    """Trained on at most ``per_language`` documents of every language that occurs, chosen by hash."""
    some = "lang is not null and doc_id is not null and text is not null and text <> ''"
    known = docs.where(some).select(F.col("lang").cast("string").alias("lang"), "doc_id", F.xxhash64("doc_id").alias("h"))
    n = known.select("lang").distinct().count()
    each, marks = max(1, min(per_language, most_rows // max(1, n))), max(1, min(landmarks, most_landmarks // max(1, n)))
    # each map task passes on its first rows of each language only
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    chosen = known.withColumn("place", place).where(F.col("place") <= each).select("lang", "doc_id").distinct()
    texts = docs.where(some).select(F.col("lang").cast("string").alias("lang"), "doc_id", F.lower(text_of(docs)).alias("t"))
    # the chosen ids are bounded by the parameters: broadcast whatever the size of the corpus
    rows = texts.join(F.broadcast(chosen), ["lang", "doc_id"]).select("lang", F.xxhash64("doc_id", "t").alias("h"), "t")
    rows = sorted(rows.mapInArrow(_bits, "lang string, h bigint, x binary").collect(), key=lambda r: (r["lang"], r["h"]))
    labels, landmark, seen = [r["lang"] for r in rows], np.zeros(len(rows), bool), {}
    for i, lang in enumerate(labels):
        seen[lang] = seen.get(lang, 0) + 1
        landmark[i] = seen[lang] <= marks and landmark.sum() < max(most_landmarks, 1)

    def blocks() -> Iterator[np.ndarray]:
        for lo in range(0, len(rows), 256):
            packed = np.frombuffer(b"".join(r["x"] for r in rows[lo : lo + 256]), np.uint8).reshape(-1, -(-WIDTH // 8))
            yield np.unpackbits(packed, axis=1, count=WIDTH).astype(np.float32)

    return train(blocks, labels, landmark)


def identify(docs: DataFrame, per_language: int = ROWS_PER_LANGUAGE, landmarks: int = LANDMARKS_PER_LANGUAGE) -> DataFrame:
    """(doc_id, language, margin, scores, agrees) for each row of ``docs``.

    The kernel counts the n-grams of 1 to 3 bytes of the lower-case text that both texts have, and is normalised;
    ``scores`` are the one-versus-rest outputs in order of the languages' names, ``margin`` the best less the second.
    ``agrees`` says whether the language is that of the column lang (null where it is null). Null and empty texts, and
    all where nothing is labelled, are "und" with margin 0. Equal scores go to the first name. Repeated rows get equal
    results; an empty table gives no rows. Columns other than doc_id, text and lang are not read. Texts count whole, at
    any length. Every language that the column has gets a classifier, whatever their number.
    """
    model = fit(docs, per_language, landmarks)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, k = batch.num_rows, len(model.languages)
            out, some = np.zeros((n, k)), np.zeros(n, bool)
            for lo, hi, x in presences(batch.column(1)):
                out[lo:hi] = model.scores(x)
                some[lo:hi] = x[:, :256].any(axis=1)
            out = np.round(out, 5)
            names = [model.languages[i] if ok else UNKNOWN for i, ok in zip(out.argmax(axis=1), some)] if k else [UNKNOWN] * n
            top = np.sort(out, axis=1)
            margin = np.where(some, top[:, -1] - top[:, -2] if k > 1 else 0.0, 0.0)
            given = batch.column(2).to_pylist()
            agrees = [None if g is None else g == v for g, v in zip(given, names)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(np.round(margin, 5)), pa.array(out.tolist(), pa.list_(pa.float64())), pa.array(agrees, pa.bool_())],
                names=["doc_id", "language", "margin", "scores", "agrees"],
            )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.lower(text_of(docs)).alias("t"), F.col("lang").cast("string")).mapInArrow(score, SCHEMA)
