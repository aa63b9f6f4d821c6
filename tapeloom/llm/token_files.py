"""Token ids in binary files of patched frame-of-reference blocks."""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.functions.timing import prefix_sum
from tapeloom.llm.common import map_arrow, only
from tapeloom.llm.warc_shards import Store

END_ID = 0
#: Ids of a block, and the shares of a block's ids among which the share that the width must hold is chosen.
BLOCK, SHARES = 1024, (0.9, 0.95, 0.98, 0.99, 1.0)
#: Characters of pieces that one Python worker remembers the ids of, pieces encoded as one text, and bytes of texts encoded together.
REMEMBERED, PIECES, TOGETHER = 24_000_000, 256, 4 << 20
#: minimum, width in bits, ids, exceptions
HEAD = struct.Struct("<IBHH")
#: blocks, documents, and the ids of the file
TAIL = struct.Struct("<QQQ8s")
MAGIC = b"PFOR-1\r\n"
CHUNK = 4 << 20

SPECIAL = "<|endoftext|>"
#: What begins a piece that has no space before it. Texts that hold it, or what looks like a special token, or a space beside other white
#: space or at the end (RE2's syntax), are encoded whole.
BARE = "\x01"
_ODD = r"\x01|<\||  | [\s\x0b\x1c-\x1f\x{85}\pZ]| \z"
#: Places within a text where one word surely ends: letters before an ASCII mark, and a line end alone between a mark or letter and a letter.
_LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
_MARK = rf"([{_LETTER}])([!-/:-@\[-`{{-~])"
_LINE = rf"([!-~{_LETTER}])\n([{_LETTER}])"
_encoders: dict[str, Encoder] = {}


class Encoder:
    """Ids as little-endian unsigned 32-bit numbers, the same as the byte-level tokenizer gives for the whole text.

    The tokenizer splits a text into words first, and a space before something that isn't white space always begins a new
    one, as do marks behind letters. So the text is cut there, and each different piece is encoded once.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.stop = self.tokenizer.token_to_id(SPECIAL)
        self.known: dict[str, bytes] = {}
        self.held = 0

    def _encoded(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece. Many pieces go as one text, as the tokenizer takes what stands between special tokens by itself."""
        if self.stop is None:
            return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        texts = [SPECIAL.join([*pieces[k : k + PIECES], ""]) for k in range(0, len(pieces), PIECES)]
        found = []
        for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            ids = np.array(e.ids, "<u4")
            data, ends = ids.tobytes(), (4 * np.flatnonzero(ids == self.stop)).tolist()
            found += [data[a:b] for a, b in zip([0, *[x + 4 for x in ends[:-1]]], ends, strict=True)]
        return found

    def _learn(self, pieces: list[str]) -> None:
        if self.held > REMEMBERED:
            self.known, self.held = {}, 0
        new = [p for p in pieces if p not in self.known]
        self.known.update(zip(new, self._encoded([p[1:] if p[:1] == BARE else " " + p for p in new]), strict=True))
        self.held += sum(map(len, new))

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, ``end`` behind each, one after another, and the number of each text's ids.

        Arrow cuts texts and numbers the pieces, Python sees the different ones, and NumPy puts the ids in place.
        """
        odd = pc.match_substring_regex(texts, _ODD)
        plain = pc.if_else(odd, "", texts)
        plain = pc.replace_substring_regex(plain, _LINE, f"\\1 {BARE}\n {BARE}\\2")
        plain = pc.replace_substring_regex(plain, _MARK, rf"\1 {BARE}\2")
        pieces = pc.split_pattern(pc.binary_join_element_wise(BARE, plain, ""), " ")
        begins = pieces.offsets.to_numpy()[:-1] - pieces.offsets[0].as_py()
        coded = pieces.flatten().dictionary_encode()
        different = coded.dictionary.to_pylist()
        self._learn(different)
        entries = [self.known[p] for p in different]
        number = coded.indices.to_numpy().astype(np.int64)
        for k in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            number[begins[k]] = len(entries)
            entries.append(np.array(self.tokenizer.encode(texts[k].as_py(), add_special_tokens=False).ids, "<u4").tobytes())
        number = np.insert(number, np.append(begins[1:], len(number)), len(entries))
        entries.append(np.array([end], "<u4").tobytes())
        sizes = np.fromiter(map(len, entries), np.int64, len(entries)) // 4
        starts, buffer = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(entries), "<u4")
        took = sizes[number]
        upto = np.cumsum(took)
        ids = buffer[np.repeat(starts[number] - upto + took, took) + np.arange(upto[-1])]
        return ids, np.add.reduceat(took, begins + np.arange(len(texts)))


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def bits(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bits of each value, one after another, the lowest bit first."""
    spread = np.unpackbits(values.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(spread[:, :width].ravel(), bitorder="little").tobytes()


def unbits(data: bytes, width: int, count: int) -> np.ndarray:
    spread = np.zeros((count, 32), np.uint8)
    spread[:, :width] = np.unpackbits(np.frombuffer(data, np.uint8), count=count * width, bitorder="little").reshape(count, width)
    return np.packbits(spread, axis=1, bitorder="little").view("<u4").ravel()


def packed(ids: np.ndarray) -> bytes:
    """A block of 1 to 65 535 ids: offsets from the smallest one at a width that holds a share of them, the rest patched.

    Of the widths at SHARES of the sorted offsets the one that gives the smallest block is taken. An offset that is wider is an exception:
    its low bits stand in the block, its place and high bits in the list behind.
    """
    low = ids.min()
    offsets = ids - low
    ranked = np.sort(offsets)
    widths = sorted({int(ranked[max(0, int(np.ceil(s * len(ids))) - 1)]).bit_length() for s in SHARES})
    over = [len(ids) - int(np.searchsorted(ranked, 1 << w)) for w in widths]
    width = min(zip(widths, over, strict=True), key=lambda x: (-(-len(ids) * x[0] // 8) + 6 * x[1], x[0]))[0]
    places = np.flatnonzero(offsets >> np.uint32(width)) if width < 32 else np.zeros(0, np.int64)
    high = (offsets[places] >> np.uint32(width)).astype("<u4")
    return HEAD.pack(int(low), width, len(ids), len(places)) + bits(offsets, width) + places.astype("<u2").tobytes() + high.tobytes()


def unpacked(data: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    """The ids of the block that begins at ``at``, and where it ends."""
    low, width, count, patches = HEAD.unpack_from(data, at)
    at += HEAD.size
    size = -(-count * width // 8)
    ids = unbits(data[at : at + size], width, count)
    at += size
    if patches:
        places = np.frombuffer(data, "<u2", patches, at)
        ids[places] |= np.frombuffer(data, "<u4", patches, at + 2 * patches) << np.uint32(width)
    return ids + np.uint32(low), at + 6 * patches


class Writer:
    """One file: blocks of ids regardless of documents, then where blocks begin, then the documents, then a tail."""

    def __init__(self, store: Store, name: str) -> None:
        self.store, self.name = store, name
        self.temporary = f"_{name}.{TaskContext.get().taskAttemptId()}.tmp"
        self.file = store.open(self.temporary)
        self.at, self.ids, self.crc, self.rest = 0, 0, 0, np.zeros(0, np.uint32)
        self.starts: list[int] = []
        self.docs: list[tuple[int, int, int]] = []

    def _out(self, data: bytes) -> None:
        self.file.write(data)
        self.crc = zlib.crc32(data, self.crc)
        self.at += len(data)

    def _blocks(self, ids: np.ndarray) -> None:
        for k in range(0, len(ids), BLOCK):
            self.starts.append(self.at)
            self._out(packed(ids[k : k + BLOCK]))

    def add(self, doc_ids: list[int | None], sizes: list[int], ids: np.ndarray) -> None:
        self.docs += [(0 if d is None else d, d is None, n) for d, n in zip(doc_ids, sizes, strict=True)]
        self.ids += len(ids)
        every = np.concatenate([self.rest, ids])
        whole = len(every) // BLOCK * BLOCK
        self._blocks(every[:whole])
        self.rest = every[whole:]

    def close(self) -> tuple:
        self._blocks(self.rest)
        doc_ids, nulls, sizes = (np.array(c) for c in zip(*self.docs, strict=True))
        self._out(np.array(self.starts, "<u8").tobytes())
        self._out(doc_ids.astype("<i8").tobytes() + nulls.astype(np.uint8).tobytes() + sizes.astype("<u8").tobytes())
        self._out(TAIL.pack(len(self.starts), len(self.docs), self.ids, MAGIC))
        self.file.close()
        self.store.commit(self.temporary, self.name)
        return self.name, len(self.docs), self.ids, self.at, self.crc


MANIFEST = "file string, part long, documents long, tokens long, bytes long, crc32 long"


def write_ids(docs: DataFrame, root: str, tokenizer: str) -> DataFrame:
    """Writes the ids of every text of ``docs`` (doc_id, text), each with id 0 behind it, under ``root``; returns the manifest.

    Documents stand in ascending doc_id (null first), those of one doc_id by a hash of their text and by it. Null texts are
    empty and have the one id. Rows are dealt to files by ranges of (doc_id, hash, row), so that neither many rows of one
    id nor many equal rows meet in one task, and encoded where they are written: ids are never shuffled. A file is written
    under a temporary name, as a stream, and renamed when whole, so a lost task is run again and a file is whole or absent. The manifest
    (file, part, documents, tokens, bytes, crc32), written last, names the files that count. An empty table has no files. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = only(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumns({"hash": F.xxhash64("text"), "tie": F.monotonically_increasing_id()})
    by = [F.col("doc_id").asc_nulls_first(), "hash"]
    dealt = rows.repartitionByRange(max(1, docs.rdd.getNumPartitions()), *by, "tie").sortWithinPartitions(*by, "text").select("doc_id", "text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, enc, writer = TaskContext.get().partitionId(), encoder(tokenizer), None
        for batch in batches:
            upto = np.cumsum(pc.binary_length(batch.column("text")).to_numpy())
            at = 0
            while at < batch.num_rows:
                some = max(1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + TOGETHER)) - at)
                rows = batch.slice(at, some)
                ids, sizes = enc.encode(rows.column("text"), END_ID)
                writer = writer or Writer(Store(root), f"part-{part:06d}.ids")
                writer.add(rows.column("doc_id").to_pylist(), sizes.tolist(), ids)
                at += some
        if writer:
            name, n, tokens, size, crc = writer.close()
            yield pa.RecordBatch.from_pylist([{"file": name, "part": part, "documents": n, "tokens": tokens, "bytes": size, "crc32": crc}])

    map_arrow(dealt, task, MANIFEST).write.parquet(f"{root}/_manifest")
    return spark.read.parquet(f"{root}/_manifest")


class Reader:
    """One file: its documents in turn, or the ids from any place by the index of blocks."""

    def __init__(self, store: Store, name: str) -> None:
        self.file, size = store.source(name), store.size(name)
        blocks, docs, self.ids, magic = TAIL.unpack(self._at(size - TAIL.size, TAIL.size))
        if magic != MAGIC:
            raise ValueError(f"{name} isn't a whole file of ids")
        index = self._at(size - TAIL.size - 17 * docs - 8 * blocks, 8 * blocks + 17 * docs)
        self.end = size - TAIL.size - len(index)
        self.starts = np.frombuffer(index, "<u8", blocks)
        doc_ids, nulls = np.frombuffer(index, "<i8", docs, 8 * blocks), np.frombuffer(index, np.uint8, docs, 8 * blocks + 8 * docs)
        self.doc_ids = [None if n else d for d, n in zip(doc_ids.tolist(), nulls.tolist(), strict=True)]
        self.sizes = np.frombuffer(index, "<u8", docs, 8 * blocks + 9 * docs).tolist()

    def _at(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def from_id(self, first: int = 0) -> Iterator[np.ndarray]:
        """The ids from number ``first`` on, in pieces of some blocks; what is before isn't read."""
        block, skip = divmod(first, BLOCK)
        while block < len(self.starts):
            begin = int(self.starts[block])
            last = max(block + 1, int(np.searchsorted(self.starts, begin + CHUNK)))
            data = self._at(begin, (int(self.starts[last]) if last < len(self.starts) else self.end) - begin)
            at, found = 0, []
            while at < len(data):
                ids, at = unpacked(data, at)
                found.append(ids)
            yield np.concatenate(found)[skip:]
            block, skip = last, 0

    def documents(self) -> Iterator[tuple[int | None, int, int, Iterator[bytes]]]:
        """(doc_id, ids before it in this file, its ids, its bytes in pieces); the pieces are to be read before the next document."""
        pieces, held, start = self.from_id(), np.zeros(0, np.uint32), 0
        for doc_id, size in zip(self.doc_ids, self.sizes, strict=True):

            def parts(left=size):
                nonlocal held
                while left:
                    if not len(held):
                        held = next(pieces)
                    now, held = held[:left], held[left:]
                    left -= len(now)
                    yield now.astype("<u4").tobytes()

            yield doc_id, start, size, parts()
            start += size


READ = "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"


def read_ids(spark: SparkSession, root: str, with_ids: bool = True) -> DataFrame:
    """What the files that the manifest under ``root`` names hold: doc_id, start (ids of all documents before), n_tokens, ids_crc32, ids.

    Each file is read as a stream by one task; ids are null without ``with_ids``, and memory is then bounded however long a
    document is. Starts are a file's begin, from the counts in the manifest, and the document's place in its file.
    """
    manifest = spark.read.parquet(f"{root}/_manifest").withColumn("all", F.lit(0))
    begins = prefix_sum(manifest, ["all"], "part", ["part"], "tokens", "upto", width=4096).select("file", (F.col("upto") - F.col("tokens")).alias("begin"))
    files = begins.repartition(max(1, manifest.count()), "file")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Store(root)
        for batch in batches:
            for name, begin in zip(batch.column("file").to_pylist(), batch.column("begin").to_pylist(), strict=True):
                out, size = [], 0
                for doc_id, inside, n, parts in Reader(store, name).documents():
                    crc, kept = 0, []
                    for p in parts:
                        crc = zlib.crc32(p, crc)
                        if with_ids:
                            kept.append(p)
                    out.append((doc_id, begin + inside, n, crc, b"".join(kept) if with_ids else None))
                    size += 4 * n if with_ids else 60
                    if size > CHUNK:
                        yield _rows(out)
                        out, size = [], 0
                if out:
                    yield _rows(out)

    return map_arrow(files, task, READ)


_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])


def _rows(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), _ARROW.types, strict=True)], schema=_ARROW)
