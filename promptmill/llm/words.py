"""Texts of an Arrow batch as numpy arrays: words, word n-grams and their hashes.

A word is a maximal run of ``[0-9a-z]`` and bytes from 0x80 on in the UTF-8 text, after A-Z have
been lower-cased. Everything here works on whole texts; batches are cut into slices of whole
rows only to bound the memory of the numpy arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from promptmill.llm.tasks import CACHES

SLICE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_M64 = (1 << 64) - 1

_LOWER = np.zeros(256, np.uint8)
for _lo, _hi in ((0x30, 0x3A), (0x61, 0x7B), (0x80, 0x100)):
    _LOWER[_lo:_hi] = np.arange(_lo, _hi)
_LOWER[0x41:0x5B] = np.arange(0x61, 0x7B)
_BYTE_CODE = np.random.default_rng(20260101).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
CACHES.append(_powers)


def powers(n: int, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and ``base**-i`` modulo 2**64 for i < n (kept, and grown by doubling)."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length()) if n else 1
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        have = _powers[base] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return have[0][:n], have[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole rows, of about ``limit`` bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, end, data[offsets[row]: offsets[end]], offsets[row: end + 1] - offsets[row]
        row = end


def range_hashes(code: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Hash of ``code[start:end]`` for many ranges at once (a polynomial modulo 2**64, scrambled)."""
    up, down = powers(len(code) + 1, base)
    total = np.zeros(len(code) + 1, np.uint64)
    np.cumsum(code * up[: len(code)], out=total[1:])
    return mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


@dataclass
class Words:
    """Words of a slice: hash, first and end byte; ``first[r]:first[r + 1]`` are those of row r."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    low = _LOWER[data]
    inside = low != 0
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True  # a row begins or ends here
    before = np.concatenate(([False], inside[:-1])) if len(data) else inside
    after = np.concatenate((inside[1:], [False])) if len(data) else inside
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    first = np.searchsorted(start, offsets)
    return Words(range_hashes(_BYTE_CODE[low], start, end), start, end, first)


def shingles_of(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word n-grams, row by row, and the first one of each row.

    A row of fewer than ``n`` words, but at least one, has a single n-gram of all its words.
    """
    count = np.diff(words.first)
    per_row = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    first = np.concatenate(([0], np.cumsum(per_row)))
    row = np.repeat(np.arange(len(count)), per_row)
    start = np.arange(first[-1]) - first[row] + words.first[row]
    end = np.minimum(start + n, words.first[row + 1])
    return range_hashes(words.hash, start, end, 0xD6E8FEB86659FD93), first


def sequence_hashes(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that stand for the whole word sequence of each row."""
    start, end = words.first[:-1], words.first[1:]
    return tuple(range_hashes(words.hash, start, end, b).view(np.int64) for b in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB))
