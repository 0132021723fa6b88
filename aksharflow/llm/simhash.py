"""Near duplicates by SimHash over an inverted index of four-bit positions and samples of bits."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Links, components, maybe_member, membership, stage_table, text_of
from .textvec import chunks, splitmix, word_hashes, words

#: Bits of 128 by which near duplicates may differ: on sf0.1 all pairs of up to 18 bits share words in sequence (most of
#: those at 14 to 18 are edited copies), and the first unrelated ones come at 20.
MAX_DISTANCE = 18
#: Of a quarter's eight four-bit positions, those whose values are posted two by two: any two of (0, 1, 2), of (3, 4, 5) and of (6, 7).
_SETS = ((0, 1, 2), (3, 4, 5), (6, 7))
_PAIRS = [pair for positions in _SETS for pair in combinations(positions, 2)]
#: The fingerprint in three parts, quarter i with set i of the last quarter, and how many bits may differ within each: all
#: three can't differ by more in MAX_DISTANCE bits. A part has four sets and at least five positions more than it has
#: differences, so that two equal positions are of one set.
BOUNDS = (6, 5, 5)
PART = 4096
#: Postings that a task gathers before it searches their lists.
HELD = 1 << 17
#: Pairs that are compared at a time, few enough for the cache.
CACHED = 1 << 13
_SALT = np.uint64(0xD6E8FEB86659FD93)
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
POSTINGS = "key int, id bigint, hi bigint, lo bigint"
LINKS = "id bigint, first bigint, links bigint, nearest double"


def fingerprints(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """((rows x 2) 64-bit halves, number of words): each distinct word votes with the root of its count on 128 bits."""
    halves, count = np.zeros((len(text), 2), np.uint64), np.zeros(len(text), np.int32)
    for at, end, data, offs in chunks(text):
        row, first, stop = words(data, offs)
        if not len(row):
            continue
        count[at:end] = np.bincount(row, minlength=end - at)
        # rows of a chunk fit 20 bits: the hash keeps 44
        key, times = np.unique((row.astype(np.uint64) << np.uint64(44)) | (word_hashes(data, first, stop) >> np.uint64(20)), return_counts=True)
        owner = (key >> np.uint64(44)).astype(np.int64)
        word = key & np.uint64((1 << 44) - 1)
        both = np.stack([splitmix(word), splitmix(word ^ _SALT)], axis=1)
        weight = np.round(16 * np.sqrt(times)).astype(np.int32)
        have = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        total = np.add.reduceat(weight, have)
        ends, lo = np.append(have[1:], len(owner)), 0
        while lo < len(have):  # whole documents of about PART words at a time stay in the cache
            hi = max(lo + 1, int(np.searchsorted(ends, have[lo] + PART, side="right")))
            a, b = have[lo], ends[hi - 1]
            bits = np.unpackbits(both[a:b].view(np.uint8), axis=1, bitorder="little")
            sums = np.add.reduceat(bits * weight[a:b, None], have[lo:hi] - a, axis=0)
            ones = np.packbits(2 * sums > total[lo:hi, None], axis=1, bitorder="little")
            halves[at + owner[have[lo:hi]]] = ones.view(np.uint64)
            lo = hi
    return halves, count


def _fingerprint_udf(text: pa.Array) -> pa.Array:
    halves, count = fingerprints(text)
    signed = halves.view(np.int64)
    return pa.StructArray.from_arrays([pa.array(signed[:, 0]), pa.array(signed[:, 1]), pa.array(count)], names=["hi", "lo", "words"])


def with_fingerprint(docs: DataFrame) -> DataFrame:
    """(id, hi, lo) of the documents that have an id; hi and lo are null where there is no word."""
    fp = F.arrow_udf(_fingerprint_udf, "hi bigint, lo bigint, words int")
    return (
        docs.where("doc_id is not null")
        .select(F.col("doc_id").cast("bigint").alias("id"), fp(F.lower(text_of(docs))).alias("f"))
        .select("id", *(F.when(F.col("f.words") > 0, F.col(f"f.{half}")).alias(half) for half in ("hi", "lo")))
    )


def _keys() -> Column:
    """Postings keys: quarter and pair of positions, then the four bits at each."""
    out = []
    for quarter in range(4):
        at = [F.shiftrightunsigned(F.col(("hi", "lo")[quarter // 2]), 32 * (quarter % 2) + 4 * i).bitwiseAND(F.lit(15)) for i in range(8)]
        out += [(F.lit((quarter * len(_PAIRS) + c) << 8) + F.shiftleft(at[i], 4) + at[j]).cast("int") for c, (i, j) in enumerate(_PAIRS)]
    return F.array(*out)


def _position(quarter: int, i: int) -> tuple[int, int]:
    """Masks on the halves of a four-bit position."""
    mask = 15 << 32 * (quarter % 2) + 4 * i
    return (0, mask) if quarter // 2 else (mask, 0)


def _masks(pairs: list[tuple[int, int]]) -> np.ndarray:
    return np.array(pairs, np.uint64).reshape(-1, 2)


@dataclass
class Part:
    """``bits``: masks of the part on the halves; ``lists``: for each group of postings lists of the part, of its two positions; ``samples``: of bits.

    Each bit has a vector of bound + 1 bits, and a sample, which also is one, has the bits whose vectors' product with it
    is odd. The vectors of up to ``bound`` different bits leave a sample that has none of these: two fingerprints with so
    few differences in the part agree in all bits of some sample.
    """

    bound: int
    bits: np.ndarray
    groups: np.ndarray
    lists: np.ndarray
    samples: np.ndarray


def _part(at: int, bound: int) -> Part:
    positions = [(at, i) for i in range(8)] + [(3, i) for i in _SETS[at]]
    bits, vector = [], 1
    for half, mask in ((half, mask) for q, i in positions for half, mask in enumerate(_position(q, i))):
        for b in range(64):
            if mask >> b & 1:
                bits.append((half, b, vector))
                vector <<= 1  # powers of a root of x^n + x + 1, primitive for 6 and 7: each sample has about half of the bits
                vector ^= (vector >> bound + 1) * ((1 << bound + 1) | 3)
    samples = [[sum(1 << b for half, b, v in bits if half == h and (v & s).bit_count() % 2) for h in range(2)] for s in range(1, 1 << bound + 1)]
    own = [(q, c) for q in (at, 3) for c, pair in enumerate(_PAIRS) if q == at or set(pair) <= set(_SETS[at])]
    pairs = [[_position(q, i) for i in _PAIRS[c]] for q, c in own]
    return Part(
        bound,
        _masks([tuple(sum(1 << b for half, b, _ in bits if half == h) for h in range(2))]),
        np.array([q * len(_PAIRS) + c for q, c in own]),
        _masks([tuple(a | b for a, b in zip(*two)) for two in pairs]),
        _masks(samples),
    )


_PARTS = [_part(i, bound) for i, bound in enumerate(BOUNDS)]


def _differ(x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Of differences between halves, how many bits lie in a mask."""
    return np.bitwise_count(x & mask[0]) + np.bitwise_count(y & mask[1])


def _is_first(part: int, group: np.ndarray, sample: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places of the differences that have their first part within its bound, first list and first sample here."""
    own = _PARTS[part]
    at = np.flatnonzero(_differ(x, y, own.bits[0]) <= own.bound)
    for other in _PARTS[:part]:
        at = at[_differ(x[at], y[at], other.bits[0]) > other.bound]
    for g, mask in zip(own.groups.tolist(), own.lists):
        at = at[(group[at] <= g) | (_differ(x[at], y[at], mask) > 0)]
    for mask in own.samples[:sample]:
        if not len(at):
            break
        at = at[((x[at] & mask[0]) | (y[at] & mask[1])) != 0]
    return at


def _run_pairs(run: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places with equal values (sorted), about CACHED at a time."""
    same = run[1:] == run[:-1]
    if not same.any():
        return
    edge = np.flatnonzero(np.diff(same, prepend=False, append=False))
    begin, size = edge[::2], edge[1::2] - edge[::2]  # places that have an equal one after them, by runs
    ends = np.cumsum(size)
    within = np.arange(ends[-1]) - np.repeat(ends - size, size)
    at, times = np.repeat(begin, size) + within, np.repeat(size, size) - within
    total, lo = np.cumsum(times), 0
    while lo < len(at):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] - times[lo] + CACHED, side="right")))
        n = times[lo:hi]
        one = np.repeat(at[lo:hi], n)
        yield one, one + 1 + np.arange(len(one)) - np.repeat(total[lo:hi] - n - (total[lo] - times[lo]), n)
        lo = hi


def _matches(key: np.ndarray, ids: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(one, other, Hamming distance) of pairs within runs of equal keys (sorted).

    For each sample of the lists' part, those that agree in its bits are verified by the Hamming distance. Each pair
    comes at its first part, list and sample only.
    """
    for p, part in enumerate(_PARTS):
        own = np.flatnonzero(np.isin(key >> 8, part.groups))
        if len(own) < 2:
            continue
        keys, x, y = key[own], hi[own], lo[own]
        width = np.uint64(len(own).bit_length())
        place = np.arange(len(own), dtype=np.uint64)
        low = (np.uint64(1) << width) - np.uint64(1)
        salt = splitmix(keys.astype(np.uint64))
        for sample, (mx, my) in enumerate(part.samples):
            value = (x & mx) * _MIX[0]
            value += (y & my) * _MIX[1]
            value ^= salt
            value &= ~low
            value |= place
            value.sort()
            order = (value & low).astype(np.int64)
            value >>= width
            # the half that holds less of the part rules out more
            halves = (x, y) if p == 2 else (y, x)
            for a, b in _run_pairs(value):
                a, b = order[a], order[b]
                near = np.flatnonzero(np.bitwise_count(halves[0][a] ^ halves[0][b]) <= MAX_DISTANCE)
                a, b = a[near], b[near]
                dx, dy = x[a] ^ x[b], y[a] ^ y[b]
                distance = np.bitwise_count(dx) + np.bitwise_count(dy)
                near = np.flatnonzero((distance <= MAX_DISTANCE) & (keys[a] == keys[b]))
                near = near[_is_first(p, keys[a[near]] >> 8, sample, dx[near], dy[near])]
                if len(near):
                    yield ids[own[a[near]]], ids[own[b[near]]], distance[near]


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over a partition sorted by key: whole runs of equal keys at a time, the last run carried on."""
    links = Links()

    def emit(parts: list[np.ndarray], last: bool = False) -> Iterator[pa.RecordBatch]:
        for found in _matches(*parts):
            for rows in links.add(*found):
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in rows], names=["id", "first", "links", "nearest"])
        for rows in links.end() if last else []:
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in rows], names=["id", "first", "links", "nearest"])

    held: list[list[np.ndarray]] = [[np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)]]
    rows = 0
    for batch in batches:
        now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        now[2], now[3] = now[2].astype(np.int64).view(np.uint64), now[3].astype(np.int64).view(np.uint64)
        held.append(now)
        rows += batch.num_rows
        if rows >= HELD:
            whole = [np.concatenate(v) for v in zip(*held)]
            cut = int(np.searchsorted(whole[0], whole[0][-1]))
            yield from emit([v[:cut] for v in whole])
            held, rows = [[v[cut:].copy() for v in whole]], 0
    yield from emit([np.concatenate(v) for v in zip(*held)], last=True)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, copies, links, distance): a row for each doc_id, also of documents without near duplicates.

    Documents whose 128-bit SimHashes differ in at most MAX_DISTANCE bits are linked, and the connected ones are a
    class; ``class_id`` is its smallest doc_id. ``copies`` counts the rows with the document's fingerprint, itself
    included, ``links`` the other fingerprints to which it is linked, and ``distance`` is the least number of bits to
    another row (null where there is none).

    The search is exact: of three parts of the fingerprint, one differs in at most its bound of bits, and so agrees in two
    positions of one of its sets, and in one of its samples of bits. Fingerprints are posted under each pair of positions
    of a set, with the bits there; within a posting list those that agree in a sample are verified by the Hamming
    distance. A list and a sample fix 20 to 30 bits together, so that few others are compared. Links are counted where
    they are found, so that a class of many different fingerprints isn't written pair by pair.

    The fingerprint is that of the lower-case words of the whole text, however long, so that case, order, punctuation
    and white space don't count. Documents without a word (null, empty or punctuation only) have no fingerprint: each is
    a class of its own, with 1 copy and no link. Rows without an id are left out; repeated rows with one id are one
    document with so many copies, and an id with several texts has the smallest class of them. An empty table gives no
    rows. Only doc_id and text are read.
    """
    prints = stage_table(with_fingerprint(docs), "fingerprints")
    groups = stage_table(prints.where("hi is not null").groupBy("hi", "lo").agg(F.min("id").alias("first"), F.count("*").alias("copies")), "groups")
    postings = groups.select(F.explode(_keys()).alias("key"), F.col("first").alias("id"), "hi", "lo")
    found = stage_table(postings.repartition("key").sortWithinPartitions("key").mapInArrow(_tally, LINKS), "links")
    classes = components(found.select(F.col("first").alias("a"), F.col("id").alias("b")))
    counts = found.groupBy(F.col("id").alias("first")).agg(F.sum("links").alias("links"), F.min("nearest").cast("int").alias("nearest"))
    linked = counts.join(classes.select(F.col("id").alias("first"), F.col("first").alias("class_id")), "first", "left")
    nodes = groups.join(linked, "first", "left").select(
        "hi", "lo", "copies", F.coalesce("class_id", "first").alias("class_id"), F.coalesce("links", F.lit(0).cast("bigint")).alias("links"), F.when(F.col("copies") > 1, 0).otherwise(F.col("nearest")).alias("distance")
    )
    rows = prints.where("hi is not null").join(nodes, ["hi", "lo"]).select(F.col("id").alias("doc_id"), "class_id", "copies", "links", "distance")
    bare = prints.where("hi is null").selectExpr("id as doc_id", "id as class_id", "1l as copies", "0l as links", "cast(null as int) as distance")
    rows = rows.unionByName(bare)
    return rows.groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.max("copies").alias("copies"), F.max("links").alias("links"), F.min("distance").alias("distance"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of near duplicates: that of the smallest doc_id. Columns are unchanged.

    Groups are the classes of near_duplicates(). Rows without an id or a word all stay. Of the texts, only
    those that a bitmap of the dropped ids does not rule out are shuffled.
    """
    dropped = stage_table(near_duplicates(docs).where("class_id <> doc_id").select(F.col("doc_id").alias("id"), F.xxhash64("doc_id").alias("k")), "dropped")
    rows = docs.select(F.struct("*").alias("row")).withColumn("k", F.xxhash64(F.col("row.doc_id").cast("bigint")))
    marked = maybe_member(rows, "k", membership(dropped, "k"))
    doubtful = marked.where("maybe_member and row.doc_id is not null").join(dropped.select("id"), F.col("row.doc_id") == F.col("id"), "left_anti")
    return marked.where("not maybe_member or row.doc_id is null").select("row.*").unionByName(doubtful.select("row.*"))
