"""Packing documents into fixed windows by minimum bin slack."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage_table, word_count

CAPACITY = 2048
#: Pieces that one task packs; shards grow in number with the input, not in size.
SHARD_PIECES = 20_000
SCHEMA = "window_id bigint, slot int, doc_id bigint, start bigint, length bigint, offset bigint, slack bigint"


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths from ``counts`` that holds the largest one and comes closest to ``capacity``.

    Bit s of an integer says whether s can be reached; a length that occurs c times is shifted in by runs of 1, 2, 4
    ... of it, and the integers before each shift lead back to how many of each length were taken. Ties go to the
    choice with the longer pieces. Stops at the first exact fill.
    """
    anchor = max(counts)
    room = capacity - anchor
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted(counts, reverse=True):
        if length > room:
            continue
        left = min(counts[length] - (length == anchor), room // length)
        run = 1
        while left > 0:
            n = min(run, left)
            steps.append((length, n, reach))
            reach |= (reach << (length * n)) & mask
            left, run = left - n, run * 2
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    taken = {anchor: 1}
    for length, n, before in reversed(steps):
        if not before >> at & 1:
            at -= length * n
            taken[length] = taken.get(length, 0) + n
    return taken


def windows(counts: dict[int, int], capacity: int) -> Iterator[tuple[dict[int, int], int]]:
    """(multiset, how many windows take it in a row) until ``counts``, which is used up, is empty.

    While the supply lasts, the choice made for one window stays the best for the next, as the supply only shrinks.
    """
    while counts:
        taken = fill(counts, capacity)
        times = min(counts[k] // n for k, n in taken.items())
        for k, n in taken.items():
            counts[k] -= n * times
            if not counts[k]:
                del counts[k]
        yield taken, times


def _pack(capacity: int):
    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        base = int(key[0]) << 32
        out: list[tuple] = []
        window = 0
        ids: dict[int, list] = {}
        pdf = pdf.sort_values(["doc_id", "tokens"], kind="stable", na_position="last")
        for doc, n in zip(pdf["doc_id"].astype(object).where(pdf["doc_id"].notna(), None).tolist(), pdf["tokens"].tolist()):
            for i in range(n // capacity):
                out.append((base + window, 0, doc, i * capacity, capacity, 0, 0))
                window += 1
            if n % capacity:
                ids.setdefault(n % capacity, []).append((doc, n - n % capacity))
        for pieces in ids.values():
            pieces.reverse()
        for taken, times in windows({k: len(v) for k, v in ids.items()}, capacity):
            slack = capacity - sum(k * n for k, n in taken.items())
            for _ in range(times):
                slot = offset = 0
                for k in sorted(taken, reverse=True):
                    for _ in range(taken[k]):
                        doc, start = ids[k].pop()
                        out.append((base + window, slot, doc, start, k, offset, slack))
                        slot, offset = slot + 1, offset + k
                window += 1
        pdf = pd.DataFrame(out, columns=["window_id", "slot", "doc_id", "start", "length", "offset", "slack"])
        pdf["doc_id"] = pdf["doc_id"].astype("Int64")
        return pdf

    return pack


def pack(docs: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """(window_id, slot, doc_id, start, length, offset, slack): which tokens of which document fill each window.

    A document of n tokens gives n // capacity full windows and one piece of the rest; pieces are packed by minimum
    bin slack within shards of about ``shard_pieces`` documents, to which a hash of id and length assigns them. Only
    ids and lengths are shuffled. ``start`` is the piece's first token in its document, ``offset`` its place in the
    window, ``slack`` the window's unused tokens. Texts without a token (null and empty ones too) take no room and are
    left out; rows with null ids and repeated rows are packed as any others. An empty table gives no rows.
    """
    lengths = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), word_count(F.col("text").cast("string")).cast("bigint").alias("tokens")).where("tokens > 0")
    lengths = stage_table(lengths, "lengths")
    shards = max(1, -(-lengths.count() // shard_pieces))
    shard = F.pmod(F.xxhash64("doc_id", "tokens"), F.lit(shards))
    return lengths.withColumn("shard", shard).groupBy("shard").applyInPandas(_pack(capacity), SCHEMA)
