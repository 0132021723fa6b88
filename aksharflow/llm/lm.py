"""Language-model scoring by online logistic mixing of hashed-context bit predictors."""

from __future__ import annotations

import fcntl
import heapq
import math
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, text_of
from .textvec import chunks

#: Bytes of context that each predictor with a table hashes. Two more have none: one of a single byte, whose counts are in the code, and one that learns from the text itself as it goes on, of LOCAL bytes.
ORDERS = (4,)
LOCAL = 3
#: Documents are halved by a hash of their ids, and each half is predicted by the tables of the other.
HALVES = 2
#: A table has 2**bits entries: about one for 128 bytes of the corpus, without an upper bound.
MIN_BITS, BYTES_PER_ENTRY_BITS = 16, 7
#: A task counts tables of up to so many bits in arrays of their size, and larger ones by sorting RUN decisions at a time into at most HELD entries a table.
DENSE_BITS, RUN, HELD = 22, 1 << 22, 1 << 22
#: Hashes of 32 bits serve tables of up to so many; beyond, they have 64.
NARROW_BITS = 32
#: Added to both counts of an entry.
PRIOR = 0.2
#: Bytes that a document is predicted with the same weights before these are refined: STEP at first, GROWTH times as many after each REPEATS refinements, up to LONGEST_STEP.
STEP, GROWTH, REPEATS, LONGEST_STEP = 8, 2, 4, 256
#: How far a refinement goes along the mean slope of a gate's decisions, which counts as WARM of them more.
RATE, WARM = 1.5, 8
#: Weights of the predictors at a document's start, by gate: how often the longest context was met before.
GATE_EDGES = np.array([0.5, 4.0, 32.0], np.float32)
START = np.array([[0.3, 0.3, 0.2], [0.2, 0.4, 0.2], [0.1, 0.7, 0.2], [0.05, 0.9, 0.2]], np.float32)
#: Bits by which slots of one document are told apart.
SLOT_BITS = 24
#: Tables are cut into at least SHARDS ranges of slots, none longer than MOST_SPAN.
SHARDS, MOST_SPAN = 64, 1 << 16
SCHEMA = "doc_id bigint, bytes bigint, bits double, bits_per_byte double"
_MIX = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], np.uint32)


@dataclass
class Code:
    """A binary code for the next byte given the last: each step of a byte's path is one bit prediction.

    ``start`` and ``size`` (65,536 entries) give a byte pair's path within ``step``, whose entries hold the hash of the
    decision's node in the upper bits and the bit itself in the lowest. ``odds`` are the log odds of a 1 at each step by
    how often the corpus has it after the last byte.
    """

    start: np.ndarray
    size: np.ndarray
    step: np.ndarray
    odds: np.ndarray


def _paths(weight: list[int]) -> list[list[tuple[int, int, float]]]:
    """For each of 256 symbols its path (node, bit, log odds of a 1) in the Huffman tree of these weights."""
    heap = [(w, i, i) for i, w in enumerate(weight)]
    heapq.heapify(heap)
    parent: dict[int, tuple[int, int, float]] = {}
    node = 256
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        odds = math.log(b[0] / a[0])
        parent[a[2]], parent[b[2]] = (node, 0, odds), (node, 1, odds)
        heapq.heappush(heap, (a[0] + b[0], node, node))
        node += 1
    out = []
    for s in range(256):
        path, at = [], s
        while at in parent:
            path.append(parent[at])
            at = parent[at][0]
        out.append(path[::-1])
    return out


def table_bits(size: int) -> int:
    """The bits of a table for a corpus of ``size`` bytes."""
    return int(max(MIN_BITS, np.ceil(np.log2(max(1, size))) - BYTES_PER_ENTRY_BITS))


def _hash_type(bits: int) -> type:
    return np.uint32 if bits <= NARROW_BITS else np.uint64


def make_code(pairs: np.ndarray, kind: type = np.uint32) -> Code:
    """From the counts (256 x 256) of each byte after each byte; no pair is without a path. ``kind`` is the type of hashes."""
    start, size, step, odds = np.zeros(65536, np.int64), np.zeros(65536, np.int64), [], []
    at = 0
    for last in range(256):
        for byte, path in enumerate(_paths((pairs[last].astype(int) * 256 + 1).tolist())):
            start[last << 8 | byte], size[last << 8 | byte] = at, len(path)
            step += [(last * 512 + node) << 1 | bit for node, bit, _ in path]
            odds += [o for _, _, o in path]
            at += len(path)
    flat = np.array(step, np.uint64)
    h = (flat >> np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h = h >> np.uint64(31) if kind is np.uint32 else h ^ (h >> np.uint64(31))
    return Code(start, size, ((h.astype(kind) & ~kind(1)) | (flat & np.uint64(1)).astype(kind)), np.array(odds, np.float32))


def _before(data: np.ndarray, offs: np.ndarray, order: int) -> list[np.ndarray]:
    """The 1st to ``order``-th byte before each byte; 0 before a document's start."""
    at = np.arange(len(data), dtype=np.int64) - np.repeat(offs[:-1], np.diff(offs))
    out = []
    for k in range(1, order + 1):
        b = np.zeros_like(data)
        b[k:] = data[:-k] if k < len(data) else data[:0]
        b[at < k] = 0
        out.append(b)
    return out


def contexts(data: np.ndarray, offs: np.ndarray, kind: type = np.uint32, orders: tuple[int, ...] = ORDERS) -> tuple[np.ndarray, list[np.ndarray]]:
    """(pair of last and this byte, for each of ``orders`` the hash of so many bytes before; its lowest bit is 0)."""
    before = _before(data, offs, max(orders))
    hashes = []
    for order in orders:
        h = np.full(len(data), order, kind)
        for b in before[:order]:
            h = (h ^ b) * _MIX[0]
            h ^= h >> kind(15)
        hashes.append((h * _MIX[1]) & ~kind(1))
    return before[0].astype(np.int64) << 8 | data, hashes


def decisions(code: Code, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(decisions of each byte, byte of each decision, its place in the code)."""
    size = code.size.take(pair)
    shift = code.start.take(pair) - (np.cumsum(size) - size)
    byte = np.repeat(np.arange(len(pair)), size)
    place = shift.take(byte)
    place += np.arange(len(place))
    return size, byte, place


def _slots(context: np.ndarray, size: np.ndarray, step: np.ndarray, bits: int) -> np.ndarray:
    """Table entries; those of a decision's two outcomes are neighbours."""
    return (np.repeat(context, size) ^ step) & context.dtype.type((1 << bits) - 1)


def met_before(owner: np.ndarray, slots: np.ndarray, bit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, 0s, 1s) of decisions in some order: how often the same document had each outcome in the same slot before.

    Slots are told apart by SLOT_BITS bits.
    """
    n = len(slots)
    slot = (slots >> slots.dtype.type(1)).astype(np.uint64) & np.uint64((1 << SLOT_BITS) - 1)
    width = max(1, n - 1).bit_length()
    if SLOT_BITS + width + 1 + max(1, int(owner[-1])).bit_length() <= 64:
        key = owner.astype(np.uint64) << np.uint64(SLOT_BITS) | slot
        key <<= np.uint64(width + 1)
        key |= np.arange(n, dtype=np.uint64) << np.uint64(1) | bit
        key.sort()
        at = (key >> np.uint64(1) & np.uint64((1 << width) - 1)).astype(np.int64)
        b = (key & np.uint64(1)).astype(np.int32)
        key >>= np.uint64(width + 1)
    else:  # more than fits a number: by order instead
        at = np.lexsort((slot, owner))
        b, key = bit[at].astype(np.int32), owner[at].astype(np.uint64) << np.uint64(SLOT_BITS) | slot[at]
    first = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1]).astype(np.int32)
    size = np.diff(first, append=np.int32(n))
    ones = np.cumsum(b, dtype=np.int32) - b
    past1 = ones - np.repeat(ones[first], size)
    past = np.arange(n, dtype=np.int32) - np.repeat(first, size)
    return at, past - past1, past1


def _steps(longest: int) -> Iterator[tuple[int, int]]:
    """(from, to) of the bytes that are predicted between refinements, the same for every document."""
    at, step, times = 0, STEP, 0
    while at < longest:
        yield at, at + step
        at, times = at + step, times + 1
        if times == REPEATS:
            step, times = min(step * GROWTH, LONGEST_STEP), 0


def _add_runs(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The sum of two (sorted slots, counts)."""
    slot, n = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
    order = np.argsort(slot, kind="stable")
    slot, n = slot[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]])) if len(slot) else np.zeros(0, np.int64)
    return slot[first], np.add.reduceat(n, first) if len(first) else n


class Counter:
    """Counts of one table's slots, in an array of its size or, beyond DENSE_BITS, as sorted entries of bounded number."""

    def __init__(self, bits: int) -> None:
        self.bits, self.kind = bits, _hash_type(bits)
        self.dense = np.zeros(1 << bits, np.int64) if bits <= DENSE_BITS else None
        self.raw: list[np.ndarray] = []
        self.held = np.zeros(0, self.kind), np.zeros(0, np.int64)

    def add(self, slots: np.ndarray) -> None:
        if self.dense is not None:
            self.dense += np.bincount(slots, minlength=1 << self.bits)
            return
        self.raw.append(slots)
        if sum(map(len, self.raw)) >= RUN:
            self._sort()

    def _sort(self) -> None:
        if self.raw:
            run = np.unique(np.concatenate(self.raw), return_counts=True)
            self.held, self.raw = _add_runs(self.held, run), []

    def full(self) -> bool:
        return len(self.held[0]) >= HELD

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        """(sorted slots, counts) so far, which are forgotten."""
        if self.dense is not None:
            at = np.flatnonzero(self.dense)
            return at, self.dense[at]
        self._sort()
        out, self.held = self.held, (np.zeros(0, self.kind), np.zeros(0, np.int64))
        return out


def _open_tables(at: str, bits: int, span: int) -> list[np.ndarray]:
    """The tables as mapped files, one for all processes that see the same folder: built by the first that asks."""
    url = urlparse(at)
    folder = url.path if url.scheme in ("", "file") else SparkFiles.get(os.path.basename(url.path))
    whole, size = folder + ".counts", len(ORDERS) * HALVES << bits
    with open(folder + ".lock", "w") as lock:
        fcntl.flock(lock, fcntl.LOCK_EX)
        if not os.path.exists(whole):
            flat = np.memmap(whole + ".part", np.float32, "w+", shape=(size,))
            for batch in pyarrow.dataset.dataset(folder, format="parquet").to_batches(batch_size=64, batch_readahead=1, fragment_readahead=1):
                for shard, counts in zip(batch.column("shard").to_pylist(), batch.column("counts").to_pylist()):
                    flat[shard * span : (shard + 1) * span] = np.frombuffer(counts, np.float32)
            flat.flush()
            del flat
            os.replace(whole + ".part", whole)
    return list(np.memmap(whole, np.float32, "r", shape=(size,)).reshape(len(ORDERS) * HALVES, 1 << bits))


@dataclass
class Model:
    """``at``: the shared folder of the tables' ranges, each of ``span`` slots. They are not sent with the model, but mapped where it is used."""

    code: Code
    bits: int
    at: str
    span: int
    mapped: list[np.ndarray] | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"mapped": None}

    @property
    def tables(self) -> list[np.ndarray]:
        if self.mapped is None:
            self.mapped = _open_tables(self.at, self.bits, self.span)
        return self.mapped

    def predictions(self, data: np.ndarray, offs: np.ndarray, half: int, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(decisions of each byte, byte of each decision, log odds of its outcome by each predictor, its gate) of the bytes in
        ``order``, which keeps those of a document as they are.

        Nothing that these depend on lies ahead in the document: tables are those of the other half, and the local
        predictor has the document's own decisions so far.
        """
        kind, prior = _hash_type(self.bits), np.float32(PRIOR)
        pair, (*hashes, local) = contexts(data, offs, kind, (*ORDERS, LOCAL))
        size, byte, place = decisions(self.code, pair[order])
        step = self.code.step.take(place)
        bit = step & kind(1)
        odds = np.empty((2 + len(ORDERS), len(step)), np.float32)
        np.take(self.code.odds, place, out=odds[0])
        for i, h in enumerate(hashes):
            both = np.take(self.tables[i * HALVES + 1 - half].view(np.complex64), _slots(h[order], size, step, self.bits) >> kind(1))
            n0, n1 = both.real, both.imag
            met = n0 + n1
            np.log((n1 + prior) / (n0 + prior), out=odds[i + 1])
        gate = (met >= GATE_EDGES[0]).view(np.int8) + (met >= GATE_EDGES[1]) + (met >= GATE_EDGES[2])
        owner = np.repeat(np.arange(len(offs) - 1, dtype=np.int32), np.diff(offs))[order].take(byte)
        at, n0, n1 = met_before(owner, local[order].take(byte) ^ step, bit)
        odds[-1, at] = np.log((n1.astype(np.float32) + prior) / (n0.astype(np.float32) + prior))
        odds *= 2 * bit.astype(np.float32) - 1
        return size, byte, odds, gate

    def score(self, text: pa.Array, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, bits) of each text, which belongs to ``half``."""
        size, bits = np.zeros(len(text), np.int64), np.zeros(len(text))
        length = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)
        for h in range(HALVES):
            own = np.flatnonzero(half == h)
            own = own[np.argsort(length[own], kind="stable")]  # texts of like length share a chunk, whose steps go by its longest
            size[own], bits[own] = self._score(text.take(pa.array(own)), h)
        return size, bits

    def _score(self, text: pa.Array, half: int) -> tuple[np.ndarray, np.ndarray]:
        """Weights start anew in each text and are refined as it goes on."""
        n = len(text)
        size_of, total = np.zeros(n, np.int64), np.zeros(n)
        for at, end, data, offs in chunks(text, 1 << 16):
            size_of[at:end] = np.diff(offs)
            if not len(data):
                continue
            rows, gates, length = end - at, len(START), np.diff(offs)
            steps = list(_steps(int(length.max())))
            within = np.arange(len(data)) - np.repeat(offs[:-1], length)
            step_of = np.repeat(np.arange(len(steps), dtype=np.int32), [hi - lo for lo, hi in steps])[within]
            order = np.argsort(step_of, kind="stable")  # bytes by steps, so that a step's decisions lie together
            size, byte, odds, gate = self.predictions(data, offs, half, order)
            owner = np.repeat(np.arange(rows), length)[order]
            cells = (owner * gates).take(byte) + gate
            ends = np.append(0, np.cumsum(size))
            bounds = ends[np.searchsorted(step_of[order], np.arange(len(steps) + 1))].tolist()
            weights, lost = np.tile(START.T, (1, rows)), np.empty(len(cells), np.float32)
            for (lo, hi), a, b in zip(steps, bounds, bounds[1:]):
                cell, x, part = cells[a:b], odds[:, a:b], lost[a:b]
                np.multiply(x[0], weights[0].take(cell), out=part)
                for k in range(1, len(x)):
                    part += x[k] * weights[k].take(cell)
                np.clip(part, -14, 14, out=part)
                np.negative(part, out=part)
                np.exp(part, out=part)
                part += 1
                if hi <= length.max():
                    slope = 1 - 1 / part
                    rate = RATE / (np.maximum(np.bincount(cell, minlength=rows * gates), 1) + WARM)
                    for k in range(len(x)):
                        weights[k] += rate * np.bincount(cell, slope * x[k], rows * gates)
            np.log(lost, out=lost)
            total[at:end] = np.bincount(owner, np.add.reduceat(lost, ends[:-1], dtype=np.float64), rows)
        return size_of, total / np.log(2)


def _half(docs: DataFrame) -> Column:
    return F.pmod(F.xxhash64(docs["doc_id"].cast("bigint")), F.lit(HALVES)).cast("int").alias("half")


def fit(docs: DataFrame) -> Model:
    """Code and tables from all texts: one pass counts byte pairs, one the outcomes in each hashed context."""
    spark = docs.sparkSession
    texts = docs.select(text_of(docs).alias("t"), _half(docs))

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(65536, np.int64)
        for batch in batches:
            for _, _, data, offs in chunks(batch.column(0)):
                total += np.bincount(_before(data, offs, 1)[0].astype(np.int64) << 8 | data, minlength=65536)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["pair", "n"])

    pairs = np.zeros(65536, np.int64)
    for r in texts.mapInArrow(count_pairs, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        pairs[r["pair"]] = r["n"]
    bits = table_bits(int(pairs.sum()))
    code = make_code(pairs.reshape(256, 256), _hash_type(bits))
    shared = spark.sparkContext.broadcast(code)
    span = min(MOST_SPAN, (1 << bits) // SHARDS)
    shards = (1 << bits) // span

    def rows(table: int, counter: Counter) -> Iterator[pa.RecordBatch]:
        slot, n = counter.take()
        shard = (slot // slot.dtype.type(span)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(shard, prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(slot)]):
            wide = n[a:b]
            yield pa.RecordBatch.from_arrays(
                [pa.array([table * shards + shard[a]], pa.int64()), pa.array([(slot[a:b] % slot.dtype.type(span)).astype(np.uint16).tobytes()]), pa.array([wide.astype(np.uint32 if wide.max() < 1 << 32 else np.uint64).tobytes()])],
                names=["shard", "entry", "n"],
            )

    def count_outcomes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, kind = shared.value, _hash_type(bits)
        counters = [Counter(bits) for _ in range(len(ORDERS) * HALVES)]
        for batch in batches:
            halves = batch.column(1).to_numpy(zero_copy_only=False)
            for half in range(HALVES):
                for _, _, data, offs in chunks(batch.column(0).take(pa.array(np.flatnonzero(halves == half)))):
                    pair, hashes = contexts(data, offs, kind)
                    size, _, place = decisions(code, pair)
                    step = code.step.take(place)
                    for i, h in enumerate(hashes):
                        c = counters[i * HALVES + half]
                        c.add(_slots(h, size, step, bits))
                        if c.full():
                            yield from rows(i * HALVES + half, c)
        for table, c in enumerate(counters):
            yield from rows(table, c)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Over a partition sorted by shard: one of them is held at a time."""

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([total.astype(np.float32).tobytes()])], names=["shard", "counts"])

        now, total = -1, np.zeros(span, np.int64)
        for batch in batches:
            for shard, entry, n in zip(*batch.columns):
                if shard.as_py() != now:
                    if now >= 0:
                        yield done()
                    now, total = shard.as_py(), np.zeros(span, np.int64)
                at, n = np.frombuffer(entry.as_py(), np.uint16), n.as_py()
                total[at] += np.frombuffer(n, np.uint32 if len(n) == 4 * len(at) else np.uint64).astype(np.int64)
        if now >= 0:
            yield done()

    counted = texts.mapInArrow(count_outcomes, "shard bigint, entry binary, n binary")
    gathered = counted.repartition("shard").sortWithinPartitions("shard").mapInArrow(add_up, "shard bigint, counts binary")
    at = f"{shared_dir(spark).rstrip('/')}/counts-{uuid.uuid4().hex}"
    gathered.write.parquet(at)
    if urlparse(at).scheme not in ("", "file"):
        spark.sparkContext.addFile(at, recursive=True)
    return Model(code, bits, at, span)


def perplexity(docs: DataFrame) -> DataFrame:
    """(doc_id, bytes, bits, bits_per_byte) for each row of ``docs``: what each whole text costs under a model of all texts.

    A byte is coded by the decisions on its path in a Huffman tree that the byte before it selects. Each decision is
    predicted from hashed contexts of ORDERS bytes, by counts over the half of the corpus to which the document doesn't
    belong, from the last byte alone, and by what the text itself had after the same LOCAL bytes so far: the outcomes'
    probabilities sum to one, and nothing ahead in the text is used. The predictions' log odds are mixed with weights
    that are gated by how often the longest context was met, and refined by gradient steps as the document goes on,
    short ones included. A document's result does not depend on what shares its batch or partition. Halves go by a hash
    of doc_id. Very long texts are scored whole; a text takes about 200 bytes of a worker's memory a byte.
    Null and empty texts have 0 bytes, 0 bits and null bits_per_byte. Repeated rows count as often as they occur and
    get equal results. An empty table gives no rows. Only doc_id and text are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            size, bits = model.score(batch.column(1), batch.column(2).to_numpy(zero_copy_only=False))
            per = np.round(bits / np.maximum(size, 1), 4)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(np.round(bits, 3)), pa.array(per, mask=size == 0)], names=["doc_id", "bytes", "bits", "bits_per_byte"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of(docs).alias("t"), _half(docs)).mapInArrow(score, SCHEMA)
