"""Comparison of many sets of hashes at once: a lossless filter by parity vectors, and exact links inside a block."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa

from tapeloom.llm.shingles import HASH_MASK, U, mix

#: Groups of up to so many sets are compared all at once; so many pairs of them at a time.
SMALL, PAIRS = 32, 2_000_000
#: Numbers in a matrix of elements that many sets hold, and in a matrix of counts.
DENSE, COUNTS = 1 << 24, 1 << 22


def parities(keys: np.ndarray, at: np.ndarray) -> pa.Array:
    """A vector of bits per set: bit h is the parity of the number of elements that hash to h.

    An element that only one of two sets holds changes one bit, so two vectors differ in no more bits than the sets
    have differing elements. Lengths are powers of two near the set's size; the halves of a vector, combined by
    exclusive or, are the vector of half the length.
    """
    size = np.diff(at)
    bits = np.int64(1) << np.maximum(6, np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64))
    bits[size == 0] = 0
    base = np.cumsum(bits) - bits
    spot = (mix((keys & HASH_MASK) ^ U(0x51AB3C9D7E2F4481)) & (np.repeat(bits, size) - 1).astype(U)).astype(np.int64)
    odd = (np.bincount(spot + np.repeat(base, size), minlength=int(bits.sum())) & 1).astype(np.uint8)
    ends = np.append(np.int32(0), np.cumsum(bits // 8)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(np.packbits(odd, bitorder="little"))])


def _rows_of(vectors: list[bytes], words: int) -> np.ndarray:
    """The vectors, folded to ``words`` 64-bit words, as rows of a matrix."""
    out = np.empty((len(vectors), words), U)
    length = np.array([len(v) for v in vectors]) // 8
    for n in np.unique(length):
        which = np.flatnonzero(length == n)
        x = np.frombuffer(b"".join([vectors[i] for i in which]), U).reshape(len(which), n // words, words)
        out[which] = np.bitwise_xor.reduce(x, axis=1)
    return out


def _hook(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the classes of a and b, pair by pair; a class is named by its smallest member."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            further = label[label]
            if np.array_equal(further, label):
                break
            label[:] = further


class Filter:
    """Which pairs may be similar enough, by size and parity vectors: false only for pairs that surely aren't."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den

    def may_link(self, sa, sb, differing) -> np.ndarray:
        near = np.minimum(sa, sb) * self.den >= np.maximum(sa, sb) * self.num
        return near & (differing.astype(np.int64) * (self.den + self.num) <= (sa + sb) * (self.den - self.num))

    def classes(self, n: np.ndarray, size: np.ndarray, vectors: list[bytes]) -> np.ndarray:
        """For rows in consecutive groups of n[0], n[1], ... sets: the first row that chains of possible links reach."""
        total = len(size)
        label, begin = np.arange(total), np.cumsum(n) - n
        words = np.minimum.reduceat(np.array([len(v) for v in vectors]) // 8, begin)
        for w in np.unique(words):
            own = np.flatnonzero((words == w) & (n <= SMALL))
            if len(own):
                rows = np.repeat(begin[own] - (np.cumsum(n[own]) - n[own]), n[own]) + np.arange(n[own].sum())
                x = _rows_of([vectors[i] for i in rows], w)
                place = np.empty(total, np.int64)
                place[rows] = np.arange(len(rows))
                for k in np.unique(n[own]):
                    i, j = np.triu_indices(k, 1)
                    starts = begin[own[n[own] == k]]
                    step = max(1, PAIRS // max(1, len(i) * int(w)))
                    for s in range(0, len(starts), step):
                        a = (starts[s : s + step, None] + i).ravel()
                        b = (starts[s : s + step, None] + j).ravel()
                        differing = np.bitwise_count(x[place[a]] ^ x[place[b]]).sum(axis=1)
                        ok = self.may_link(size[a], size[b], differing)
                        _hook(label, a[ok], b[ok])
            for g in np.flatnonzero((words == w) & (n > SMALL)):
                at, end = begin[g], begin[g] + n[g]
                self._large(label[at:end], size[at:end], _rows_of(vectors[at:end], w))
        return label

    def _large(self, label: np.ndarray, size: np.ndarray, x: np.ndarray) -> None:
        """One group, set by set; pairs that are joined already aren't looked at again."""
        first, label[:] = label[0], np.arange(len(label))
        for i in range(len(label) - 1):
            rest = i + 1 + np.flatnonzero(label[i + 1 :] != label[i])
            if not len(rest):
                if not label.any():
                    break
                continue
            differing = np.bitwise_count(x[rest] ^ x[i]).sum(axis=1)
            found = rest[self.may_link(size[rest], size[i], differing)]
            if len(found):
                _hook(label, np.full(len(found), i), found)
        label += first


def refine_task(num: int, den: int):
    """Rows sorted by bucket and part -> (a, b): in each bucket stars of the sets that chains of possible links join."""
    cheap = Filter(num, den)

    def told(keys: list, names: np.ndarray, size: np.ndarray, vectors: list[bytes]) -> pa.RecordBatch | None:
        n = np.array([len(list(g)) for _, g in groupby(keys)])
        label = cheap.classes(n, size, vectors)
        other = np.flatnonzero(label != np.arange(len(label)))
        if not len(other):
            return None
        return pa.RecordBatch.from_arrays([pa.array(names[label[other]]), pa.array(names[other])], ["a", "b"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, names, size, vectors = [], [], [], []
        for batch in batches:
            keys += zip(batch.column("bucket").to_pylist(), batch.column("part").to_pylist(), strict=True)
            names += batch.column("name").to_pylist()
            size += batch.column("n_shingles").to_pylist()
            vectors += batch.column("parity").to_pylist()
            last = len(keys)
            while last and keys[last - 1] == keys[-1]:
                last -= 1
            if last:
                out = told(keys[:last], np.array(names[:last]), np.array(size[:last]), vectors[:last])
                keys, names, size, vectors = keys[last:], names[last:], size[last:], vectors[last:]
                if out is not None:
                    yield out
        if keys and (out := told(keys, np.array(names), np.array(size), vectors)) is not None:
            yield out

    return task


def shared_counts(sets: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """(first set of a block, numbers of elements that each set of the block shares with each set), exact.

    Elements that many sets hold are columns of a matrix whose product with itself counts them; the others are looked up
    in an inverted index. Elements of one set alone are shared with none.
    """
    n = len(sets)
    length = np.array([len(s) for s in sets])
    x, own = np.concatenate(sets), np.repeat(np.arange(n), length)
    order = np.argsort(x, kind="stable")
    new = np.append(True, x[order][1:] != x[order][:-1])
    begin = np.flatnonzero(new)
    holders = np.diff(np.append(begin, len(x)))
    run = np.empty(len(x), np.int64)
    run[order] = np.cumsum(new) - 1
    holder = own[order]
    most = np.sort(holders)[::-1]
    room = max(1, DENSE // n)
    many = max(16, int(most[room]) + 1 if len(most) > room else 16)
    column = np.cumsum(holders >= many) - 1
    dense = np.zeros((n, int((holders >= many).sum())), np.float32)
    heavy = holders[run] >= many
    dense[own[heavy], column[run[heavy]]] = 1
    light = (holders[run] > 1) & ~heavy
    l_own, l_run = own[light], run[light]
    ends = np.searchsorted(l_own, np.arange(n + 1))
    steps = np.append(0, np.cumsum(holders[l_run]))
    j, rows = 0, max(1, COUNTS // n)
    while j < n:
        k = min(j + rows, n)
        while k > j + 1 and steps[ends[k]] - steps[ends[j]] > 4 * COUNTS:
            k = j + (k - j) // 2
        both = dense[j:k] @ dense.T if dense.shape[1] else np.zeros((k - j, n), np.float32)
        both = np.rint(both).astype(np.int64)
        r = l_run[ends[j] : ends[k]]
        if len(r):
            h = holders[r]
            at = np.arange(h.sum()) - np.repeat(np.cumsum(h) - h, h) + np.repeat(begin[r], h)
            flat = np.repeat((l_own[ends[j] : ends[k]] - j) * n, h) + holder[at]
            both += np.bincount(flat, minlength=(k - j) * n).reshape(k - j, n)
        yield j, both
        j = k


def links_within(
    sets: list[np.ndarray], num: int, den: int, weight: np.ndarray, block: np.ndarray, home: np.ndarray
) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links that join different components of the sets, and each set's sum of the weights of the sets that it links with.

    Every pair is compared. Pairs of one block meet in several parts; their links are summed in the block's ``home`` part only.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets])
    label, found, sums = np.arange(n), [], np.zeros(n, np.int64)
    for j, both in shared_counts(sets):
        rows = np.arange(j, j + len(both))
        linked = both * den >= (size[rows][:, None] + size - both) * num
        linked[rows - j, rows] = False
        counted = linked if home.all() else linked & ((block[rows][:, None] != block) | home[rows][:, None])
        sums[rows] = counted @ weight
        for i in np.flatnonzero(linked.any(axis=1)):
            partners = np.flatnonzero(linked[i])
            apart, first = np.unique(label[partners], return_index=True)
            for c, k in zip(apart, partners[first], strict=True):
                mine = label[rows[i]]
                if label[k] != mine:
                    found.append((int(rows[i]), int(k)))
                    label[label == max(mine, label[k])] = min(mine, label[k])
    return found, sums
