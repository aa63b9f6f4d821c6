"""Packing of token sequences into windows by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import os
import unicodedata
from collections import deque
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tapeloom.llm.common import map_arrow, only

WINDOW = 2048
END_ID = 1
#: The windows of one differencing.
GROUP_WINDOWS = 32
#: Words that one Python worker remembers the ids of; texts whose new words are encoded together.
REMEMBERED, TEXTS = 1_000_000, 256
PUNCTUATION = frozenset((b".", b",", b";", b":", b"!", b"?"))

_encoders: dict[str, Encoder] = {}


class Encoder:
    """Ids as little-endian unsigned 32-bit numbers, the same as the tokenizer gives for the whole text.

    The tokenizer splits at white space and drops it, so text is cut at ASCII white space and each different word is encoded once.
    It makes letters small, so in ASCII texts A-Z become a-z; not so in others, as it composes characters first, nor
    beside names of its special tokens, which it looks for before.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        words = [(t.lower() if t.isascii() and "<|" not in t else t).encode("utf-8", "replace").split() for t in texts]
        known = self.known
        every = set().union(*words)
        if len(known) + len(every) > REMEMBERED:
            known.clear()
        unseen = every.difference(known)
        # letters and one punctuation mark behind them are two words to the tokenizer
        pairs = [w for w in unseen if w[-1:] in PUNCTUATION and stays_letters(w[:-1].decode())]
        new = list(unseen.difference(pairs).union(w[:-1] for w in pairs).union(PUNCTUATION).difference(known))
        for at in range(0, len(new), 5000):
            part = new[at : at + 5000]
            encoded = self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)
            for w, e in zip(part, encoded, strict=True):
                known[w] = np.array(e.ids, "<u4").tobytes()
        for w in pairs:
            known[w] = known[w[:-1]] + known[w[-1:]]
        return [b"".join(map(known.__getitem__, w)) for w in words]


def stays_letters(word: str) -> bool:
    """Whether the tokenizer surely sees letters alone in ``word`` after composing it and making it small.

    No mark may be left at its end, which would go with what is behind it. Beyond U+052F letters depend on Unicode's version.
    """
    if word.isascii():
        return word.isalpha()
    return word.isalpha() and max(word) < "\u0530" and unicodedata.normalize("NFC", word).lower().isalpha()


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def difference(sizes: list[int], windows: int) -> list[list[int]]:
    """Karmarkar-Karp: the items of each of ``windows`` parts with nearly equal sums.

    Each item starts as a partial partition of its own. Again and again the two partial partitions with the largest
    imbalance are merged, the largest part of one with the smallest of the other.
    """
    heap, count = [], len(sizes)
    for k, size in enumerate(sizes):
        sums = np.zeros(windows, np.int64)
        sums[0] = size
        heap.append((-size, k, sums, [[k]] + [[] for _ in range(windows - 1)]))
    heapify(heap)
    while len(heap) > 1:
        _, _, a, items_a = heappop(heap)
        _, _, b, items_b = heappop(heap)
        sums = a + b[::-1]
        order = np.argsort(-sums, kind="stable")
        items = [x + y for x, y in zip(items_a, reversed(items_b), strict=True)]
        sums = sums[order]
        count += 1
        heappush(heap, (int(sums[-1] - sums[0]), count, sums, [items[i] for i in order]))
    return heap[0][3] if heap else [[] for _ in range(windows)]


def bundled(sizes: list[int], least: int) -> list[list[int]]:
    """Items in runs: those of ``least`` tokens or more alone, smaller ones with the small ones next to them until they have as many."""
    out, run, held = [], [], 0
    for i, size in enumerate(sizes):
        if size >= least:
            out.append([i])
            continue
        run.append(i)
        held += size
        if held >= least:
            out.append(run)
            run, held = [], 0
    return [*out, run] if run else out


def windows_of(sizes: list[int], window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """(item, start, length) of the pieces in each window; items have ``window`` tokens at most.

    Differencing deals whole items to windows with nearly equal sums, and is repeated with one window more while any window has
    more than its capacity. Only then is anything cut: the emptiest windows, those beyond the number that all items need, give
    their items to fill up the others. Tiny items are dealt in runs of window / 128 tokens, so that their number is bounded.
    """
    if max(sizes, default=0) > window:
        raise ValueError("an item is larger than a window")
    runs = bundled(sizes, window // 128)
    weights = [sum(sizes[i] for i in run) for run in runs]
    load = lambda part: sum(weights[k] for k in part)
    need = n = max(1, -(-sum(sizes) // window))
    parts = difference(weights, n)
    while max(map(load, parts)) > window:
        n += 1
        parts = difference(weights, n)
    windows = [[(i, 0, sizes[i]) for k in part for i in runs[k]] for part in sorted(parts, key=load, reverse=True)]
    spare = deque(piece for held in windows[need:] for piece in held)
    for held in windows[:need]:
        room = window - sum(length for _, _, length in held)
        while room and spare:
            i, start, length = spare.popleft()
            fits = min(length, room)
            held.append((i, start, fits))
            room -= fits
            if fits < length:
                spare.appendleft((i, start + fits, length - fits))
    return [held for held in windows[:need] if held]


class _Packer:
    """Pieces of one task, in order: (doc_id, start, ids, doc_tokens) -> rows with sequence and offset.

    Whole windows of a document leave at once, the rest of it waits until GROUP_WINDOWS windows can be filled.
    """

    def __init__(self, window: int, first: int) -> None:
        self.window, self.sequence = window, first
        self.held: deque[tuple] = deque()
        self.total = 0

    def place(self, pieces: list[tuple]) -> Iterator[tuple]:
        at = 0
        for doc_id, start, ids, tokens in pieces:
            yield doc_id, start, len(ids) // 4, ids, tokens, self.sequence, at
            at += len(ids) // 4
        self.sequence += 1

    def add(self, doc_id: int | None, ids: bytes) -> Iterator[tuple]:
        tokens, step = len(ids) // 4, 4 * self.window
        for at in range(0, len(ids), step):
            part = ids[at : at + step]
            if len(part) == step:
                yield from self.place([(doc_id, at // 4, part, tokens)])
                continue
            self.held.append((doc_id, at // 4, part, tokens))
            self.total += len(part) // 4
        goal = GROUP_WINDOWS * self.window
        while self.total >= goal:
            yield from self.flush(goal)

    def flush(self, goal: int) -> Iterator[tuple]:
        """Packs held pieces of exactly ``goal`` tokens; the piece at the edge is cut."""
        group, size = [], 0
        while size < goal:
            doc_id, start, ids, tokens = self.held.popleft()
            room = 4 * (goal - size)
            if len(ids) > room:
                self.held.appendleft((doc_id, start + room // 4, ids[room:], tokens))
                ids = ids[:room]
            group.append((doc_id, start, ids, tokens))
            size += len(ids) // 4
        self.total -= size
        for pieces in windows_of([len(p[2]) // 4 for p in group], self.window):
            cut = [(group[i], at, n) for i, at, n in pieces]
            yield from self.place([(d, start + at, ids[4 * at : 4 * (at + n)], tokens) for (d, start, ids, tokens), at, n in cut])

    def close(self) -> Iterator[tuple]:
        """The rest: whole windows by differencing, then sequences of powers of two, which need no padding."""
        n = self.total // self.window
        if n:
            yield from self.flush(n * self.window)
        while self.total:
            goal = 1 << (min(self.total, self.window).bit_length() - 1)
            pieces, size = [], 0
            while size < goal:
                doc_id, start, ids, tokens = self.held.popleft()
                room = 4 * (goal - size)
                if len(ids) > room:
                    self.held.appendleft((doc_id, start + room // 4, ids[room:], tokens))
                    ids = ids[:room]
                pieces.append((doc_id, start, ids, tokens))
                size += len(ids) // 4
            self.total -= size
            yield from self.place(pieces)


SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
)


def _rows(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), _ARROW.types, strict=True)], schema=_ARROW)


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW) -> DataFrame:
    """Pieces of all documents in sequences of at most ``window`` (a power of two) tokens.

    Returns doc_id, start, length, ids (little-endian unsigned 32-bit numbers), doc_tokens, sequence_id, offset. A
    document is its ids and then id 1; null texts have that one id. Full windows of a document are sequences by
    themselves. What is left of documents is dealt whole by multiway differencing to groups of near-equal windows, as many as
    are needed for none to have too much; then the emptiest of them are cut up to fill the others, and a group's last piece
    goes on in the next one. So texts of any length are packed, in pieces of ``window`` tokens at most. Sequences that aren't full are to be padded to ``window``, except
    those at a power of two.

    Every row is packed, repeated rows too; an empty table gives no pieces. Other columns are ignored. Each input
    partition is packed by itself as it streams by, so nothing is shuffled, memory is bounded by one group and one
    text, and a lost task is simply run again with the same result.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, enc, found, size = _Packer(window, TaskContext.get().partitionId() << 33), encoder(tokenizer), [], 0
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                texts = [t or "" for t in part.column("text").to_pylist()]
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), enc.encode(texts), strict=True):
                    for row in packer.add(doc_id, ids + end):
                        found.append(row)
                        size += len(row[3])
                    if size > (4 << 20) or len(found) > 20_000:
                        yield _rows(found)
                        found, size = [], 0
        found += packer.close()
        if found:
            yield _rows(found)

    return map_arrow(only(docs, "doc_id", "text"), task, SCHEMA)
