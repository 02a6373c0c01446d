"""Words and word hashes of whole Arrow string columns, by NumPy over the UTF-8 bytes.

A column is one byte array with offsets. Every function works on slices of a few MB, so
that memory stays bounded for any batch; one very long text makes a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SLICE_BYTES = 2 << 20

_BYTES = np.arange(256)
LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)
#: Separators of words: white space; and every ASCII byte but letters and digits.
SPACE = (_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D))
NOT_ALNUM = (_BYTES < 0x80) & ~(((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)))

#: Masks of the first 0 .. 8 bytes of a block.
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=U64)
#: Odd multipliers of the words of a shingle, by position.
_WORD_MULTIPLIERS = np.array([pow(0xD1342543DE82EF95, 2 * k + 1, 1 << 64) for k in range(64)], dtype=U64)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (SplitMix64); ``seed`` gives independent permutations."""
    x = x + U64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets from 0) of runs of rows of about ``size`` bytes; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(at, at[first] + size, "right")) - 1)
        last = min(last, len(column))
        yield first, whole[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def spans(raw: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each row the index of its first word (one more entry than rows)."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~separators[raw]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | edge[1:n]
    last = word.copy()
    last[:-1] &= ~word[1:] | edge[1:n]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes: blocks of 8 bytes, each mixed with its place before they are added."""
    if not len(starts):
        return np.zeros(0, U64)
    sizes = ends - starts
    blocks = np.maximum(1, (sizes + 7) >> 3)
    first = np.cumsum(blocks) - blocks
    place = np.arange(int(blocks.sum())) - np.repeat(first, blocks)
    at = np.repeat(starts, blocks) + 8 * place
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))  # the 8 bytes from each byte on
    block = eight[at] & _MASKS[np.minimum(np.repeat(ends, blocks) - at, 8)]
    total = np.add.reduceat(mix(block ^ mix(place.astype(U64), 1)), first)
    return mix(total + sizes.astype(U64) * U64(0xA24BAED4963EE407))


def two_words(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of each span, at most 16, as a row of two words; zeros follow."""
    padded = np.concatenate([raw, np.zeros(16, np.uint8)])
    eight = np.ndarray((len(raw) + 9,), "<u8", padded, strides=(1,))  # the 8 bytes from each byte on
    return np.stack([eight[starts] & _MASKS[np.minimum(sizes, 8)], eight[starts + 8] & _MASKS[np.maximum(sizes - 8, 0)]], 1)


def windows(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k consecutive words within a row, and the row's first entry among them.

    A row of fewer words, but not none, has one window: the whole sequence with its length.
    """
    counts = np.diff(first)
    have = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(have)])
    where = np.arange(begin[-1]) - np.repeat(begin[:-1] - first[:-1], have)
    lengths = np.repeat(np.minimum(counts, k), have)
    padded = np.concatenate([hashes, np.zeros(k, U64)])
    out = np.zeros(len(where), U64)
    short = lengths < k
    for j in range(k):
        part = padded[where + j] * _WORD_MULTIPLIERS[j]
        if short.any():
            part[short & (lengths <= j)] = 0
        out += part
    out += lengths.astype(U64) * U64(0xA24BAED4963EE407)
    return mix(out), begin


def sorted_sets(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values of each row, flat, and the rows' first entries."""
    v = values.copy()
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        v[a:b].sort()
    new = np.ones(len(v), bool)
    new[1:] = v[1:] != v[:-1]
    new[first[:-1][np.diff(first) > 0]] = True
    return v[new], np.concatenate([[0], np.cumsum(new)])[first]
