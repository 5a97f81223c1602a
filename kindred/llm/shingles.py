"""Hashes of words and word shingles of whole texts, a batch at a time in numpy.

A word's hash is a polynomial in its bytes, read off prefix sums, so no Python object is made for a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 19
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 5
_tables: list[np.ndarray] = []


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, for positions in a piece."""
    if not _tables:
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(PIECE + 1, base, np.uint64)
            p[0] = 1
            _tables.append(np.cumprod(p))
    return _tables[0], _tables[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _spaces(b: np.ndarray) -> np.ndarray:
    return (b == 32) | ((b >= 9) & (b <= 13))


def _piece_hashes(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start positions and hashes of the words of at most PIECE bytes, A-Z taken as a-z."""
    power, inverse = _powers()
    word = ~_spaces(b)
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    small = np.where((b >= 65) & (b <= 90), b + 32, b).astype(np.uint8)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[small] * power[: len(b)])))
    return starts, mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def word_hashes(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As _piece_hashes, for any length: pieces are cut at white space; a longer word is hashed from its pieces."""
    if len(b) <= PIECE:
        return _piece_hashes(b)
    found_at, found, at = [], [], 0
    while at < len(b):
        end = min(len(b), at + PIECE)
        if end < len(b) and not _spaces(b[end : end + 1])[0]:
            gaps = np.flatnonzero(_spaces(b[at:end]))
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:
                value, start = np.ones(1, np.uint64), at
                while at < len(b):
                    part = b[at : at + PIECE]
                    gaps = np.flatnonzero(_spaces(part))
                    part = part[: int(gaps[0])] if len(gaps) else part
                    if len(part):
                        value = mix(value * np.uint64(3) + _piece_hashes(part)[1][:1])
                    at += len(part)
                    if len(gaps):
                        break
                found_at.append(np.array([start]))
                found.append(value)
                continue
        starts, hashes = _piece_hashes(b[at:end])
        found_at.append(starts + at)
        found.append(hashes)
        at = end
    return np.concatenate(found_at), np.concatenate(found)


def _sequence(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k words in a row, at every position that has k."""
    n = len(words) - k + 1
    out = np.full(n, k, np.uint64)
    for t in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[t : t + n]
    return mix(out)


def distinct_shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of k words in a row; of fewer words, the whole sequence as one; of none, nothing."""
    if not len(words):
        return np.zeros(0, np.uint64)
    return np.unique(_sequence(words, min(k, len(words))))


def texts_of(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows that together have at most PIECE bytes, or one longer row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and len(column) else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE, side="right")) - 1)
        end = min(end, len(column))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """distinct_shingles of each text; null is empty. Rows of a run are hashed together, with a space between them."""
    empty = np.zeros(0, np.uint64)
    nulls = column.is_null().to_numpy(zero_copy_only=False) if column.null_count else None
    for row, end, data, offsets in texts_of(column):
        n = end - row
        # A gap of one space before every text keeps words of neighbours apart.
        if n > 1:
            where = np.arange(n) + offsets[:-1]
            spaced = np.full(len(data) + n, 32, np.uint8)
            hole = np.zeros(len(data) + n, bool)
            hole[where] = True
            spaced[~hole] = data
            starts, hashes = _piece_hashes(spaced) if len(spaced) <= PIECE else word_hashes(spaced)
            cuts = np.searchsorted(starts, where)
        else:
            starts, hashes = word_hashes(data)
            cuts = np.zeros(1, np.int64)
        cuts = np.append(cuts, len(starts))
        for i in range(n):
            if nulls is not None and nulls[row + i]:
                yield empty
            else:
                yield distinct_shingles(hashes[cuts[i] : cuts[i + 1]], k)
