"""Vectorised passes over the UTF-8 bytes of Arrow string arrays: word bounds and word hashes without a loop over rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
_R = 0x9E3779B97F4A7C15
_RINV = pow(_R, -1, 1 << 64)
#: Letters, digits and every byte beyond ASCII belong to a word.
WORD = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK + 1)
        have = np.empty(size, np.uint64)
        have[0] = 1
        have[1:] = base
        _powers[base] = have = np.multiply.accumulate(have)
    return have[:n]


def splitmix(x: np.ndarray) -> np.ndarray:
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def raw(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string array, sharing its memory."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, offs, data = arr.buffers()
    if len(arr) == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def chunks(arr: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows with at most ``limit`` bytes (or one longer row): (first row, end row, bytes, offsets)."""
    data, offs = raw(arr)
    n, at = len(offs) - 1, 0
    while at < n:
        end = int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1
        end = min(n, max(end, at + 1))
        yield at, end, data[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
        at = end


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first byte, end byte) of each word."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = WORD[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    bounds = offs[offs < len(data)]
    before[bounds] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = offs[offs > 0] - 1
    after[ends] = False
    stops = np.flatnonzero(inside & ~after) + 1
    return np.searchsorted(offs, starts, side="right") - 1, starts, stops


def span_hashes(data: np.ndarray, starts: np.ndarray, stops: list[np.ndarray]) -> list[np.ndarray]:
    """64-bit hashes of the bytes from ``starts`` to each of ``stops``: a polynomial over the ring of 64-bit integers, mixed."""
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_R, len(data)), out=total[1:])
    before, back = total[starts], _power(_RINV, len(data) + 1)[starts]
    return [splitmix((total[stop] - before) * back) for stop in stops]


def word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    return span_hashes(data, starts, [stops])[0]


def hash_word(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(word_hashes(data, np.array([0]), np.array([len(data)]))[0])
