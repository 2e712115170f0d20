"""Vectorised hashing of the words of Arrow text columns, used inside Spark tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_R, _R_INV = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: White space of the corpus operators: [\x20\x09-\x0D].
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Letters and digits, and every byte of a non-ASCII character.
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = True
_WORD[128:] = True
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]
#: Bytes of text that are hashed at once; a longer document is a piece of its own.
PIECE = 1 << 20


def _powers_of(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n + 1:
        for k, base in enumerate((_R, _R_INV)):
            p = np.full(n + 1, base, U)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over all 64 output bits."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def utf8(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (rows + 1) of a text column; null rows are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks)
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    offsets = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, piece: int = PIECE) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``piece`` bytes; every row is in one run."""
    k, n = 0, len(offsets) - 1
    while k < n:
        end = int(np.searchsorted(offsets, offsets[k] + piece, side="right")) - 1
        end = min(n, max(end, k + 1))
        yield k, end
        k = end


def word_spans(data: np.ndarray, offsets: np.ndarray, words_only: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the first word of each row (rows + 1).

    Words are runs of anything but white space, or with ``words_only`` runs of letters and digits.
    """
    inside = _WORD[data] if words_only else ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[:-1] = inside
    starts = edge.copy()
    starts[1:] &= ~edge[:-1]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    starts[cuts] |= edge[cuts]
    s = np.flatnonzero(starts)
    ends = np.zeros(len(data) + 1, bool)
    ends[1:] = inside
    ends[1:-1] &= ~inside[1:]
    if len(data):
        ends[cuts] |= inside[cuts - 1]
    e = np.flatnonzero(ends)
    return s, e, np.searchsorted(s, offsets)


def hash_spans(data: np.ndarray, s: np.ndarray, e: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hashes of byte spans, A-Z as a-z with ``lower``; equal strings have equal hashes wherever they stand."""
    up, down = _powers_of(len(data) + 1)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(((_LOWER[data] if lower else data).astype(U) + U(1)) * down[: len(data)], out=sums[1:])
    return mix((sums[e] - sums[s]) * up[s] + (e - s).astype(U) * U(0xD6E8FEB86659FD93))


def words(col: pa.Array, words_only: bool = False, piece: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows: first row, last row (exclusive), word hashes, and the first word of each row of the run."""
    data, offsets = utf8(col)
    for a, b in pieces(offsets, piece):
        part, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        s, e, first = word_spans(part, own, words_only)
        yield a, b, hash_spans(part, s, e), first


_STEP = np.array([pow(_R, 3 * k + 1, 1 << 64) | 1 for k in range(64)], U)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words of one word sequence."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, U)
    out = np.zeros(m, U)
    for k in range(n):
        out += h[k : k + m] * _STEP[k]
    return mix(out + U(n))


def shingles(h: np.ndarray, n: int = 5) -> np.ndarray:
    """Sorted distinct ``n``-word shingles of a text; shorter texts are one shingle, no words none."""
    if not len(h):
        return h
    return np.unique(grams(h, min(n, len(h))))
