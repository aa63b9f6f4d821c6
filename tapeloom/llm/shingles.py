"""Sets of word shingles of many texts at once, as sorted arrays of hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A chunk holds at most so many texts and, unless one text is longer, so many bytes.
CHUNK_TEXTS, CHUNK_BYTES = 1000, 1 << 20
#: A key is the text's number in the chunk (10 bits) and the shingle's hash (54 bits).
HASH_BITS = np.uint64(54)
HASH_MASK = np.uint64((1 << 54) - 1)
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose result bits all depend on all bits of the argument."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_VALUE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)
_VALUE[65:91] = _VALUE[97:123]  # A-Z as a-z
_BASE = 0x5851F42D4C957F2D
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def _power(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(max(n, CHUNK_BYTES + 1), U(base))
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


def chunks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, offsets from 0, bytes) of consecutive runs of texts; null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if not n:
        return
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(at, at[i] + CHUNK_BYTES, "right")) - 1
        j = min(max(j, i + 1), i + CHUNK_TEXTS, n)
        yield i, at[i : j + 1] - at[i], data[at[i] : at[j]]
        i = j


def distinct_shingles(offsets: np.ndarray, data: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct keys: all ``width``-word shingles of each text; a shorter text is one shingle, one without words none."""
    m = len(data)
    if not m:
        return np.zeros(0, U)
    solid = ~_SPACE[data]
    begin, stop = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1]
    stop[:-1] &= ~solid[1:]
    edges = offsets[:-1][np.diff(offsets) > 0]  # first bytes of texts that aren't empty
    begin[edges] = solid[edges]
    stop[edges[1:] - 1] = solid[edges[1:] - 1]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop)
    if not len(start):
        return np.zeros(0, U)
    power, inverse = _power(m + 1)
    total = np.zeros(m + 1, U)
    np.cumsum(_VALUE[data] * power[:m], out=total[1:])
    word = mix((total[end + 1] - total[start]) * inverse[start] + (end - start).astype(U))
    text = np.searchsorted(offsets, start, "right") - 1
    per = np.bincount(text, minlength=len(offsets) - 1)
    n = len(word)
    keys = []
    if n >= width:
        i = np.flatnonzero(text[: n - width + 1] == text[width - 1 :])
        h = np.full(len(i), U(width))
        for k in range(width):
            h = h * U(0xD6E8FEB86659FD93) + word[i + k]
        keys.append((text[i].astype(U) << HASH_BITS) | (mix(h) >> U(10)))
    short = np.flatnonzero((per > 0) & (per < width))
    if len(short):
        first = np.cumsum(per)[short] - per[short]
        h = per[short].astype(U)
        for k in range(width - 1):
            more = per[short] > k
            h = np.where(more, h * U(0xD6E8FEB86659FD93) + word[np.minimum(first + k, n - 1)], h)
        keys.append((short.astype(U) << HASH_BITS) | (mix(h) >> U(10)))
    key = np.concatenate(keys)
    key.sort()
    return key[np.append(True, key[1:] != key[:-1])]


def bounds(keys: np.ndarray, texts: int) -> np.ndarray:
    """Where each text's keys begin, and the end."""
    return np.searchsorted(keys, np.arange(texts + 1, dtype=U) << HASH_BITS)


def set_names(keys: np.ndarray, at: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit name of each text's set, another one for each seed; 0 for an empty set."""
    x = mix((keys & HASH_MASK) + U((0x632BE59BD9B4E019 + seed * 0x9E6C63D0876A9A47) % (1 << 64)))
    total = np.zeros(len(keys) + 1, U)
    np.cumsum(x, out=total[1:])
    sums = total[at[1:]] - total[at[:-1]]
    size = np.diff(at).astype(U)
    return np.where(size > 0, mix(sums + size * U(0x9E3779B97F4A7C15)), U(0))
