"""Exact deduplication by Grace hashing: spill files until a bucket fits an open-addressing table."""

from __future__ import annotations

import pickle
import shutil
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import cut, join_counted, map_arrow, only

#: Bytes of content that one table may hold, and the number of spill files of one level.
TABLE_BYTES = 64 << 20
FANOUT = 16


class ContentTable:
    """Open addressing with linear probing; a slot matches when the complete contents are equal."""

    def __init__(self) -> None:
        self.slots: list[int] = [-1] * 1024
        self.hashes: list[int] = []
        self.entries: list[list] = []  # content, smallest-order id (largest doc_id), rows
        self.bytes = 0

    def _grow(self) -> None:
        self.slots = [-1] * (2 * len(self.slots))
        mask = len(self.slots) - 1
        for k, h in enumerate(self.hashes):
            at = h & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = k

    def add(self, h: int, content: str, doc_id: int | None, rows: int) -> None:
        mask = len(self.slots) - 1
        at = h & mask
        while (k := self.slots[at]) >= 0:
            if self.hashes[k] == h and self.entries[k][0] == content:
                entry = self.entries[k]
                if entry[1] is None or (doc_id is not None and doc_id > entry[1]):
                    entry[1] = doc_id
                entry[2] += rows
                return
            at = (at + 1) & mask
        self.slots[at] = len(self.entries)
        self.hashes.append(h)
        self.entries.append([content, doc_id, rows])
        self.bytes += len(content) + 200
        if 2 * len(self.entries) > len(self.slots):
            self._grow()


def grace(records: Iterable[tuple[str, int | None, int]], table_bytes: int = TABLE_BYTES, depth: int = 0) -> Iterator[list]:
    """[content, largest id, rows] of each distinct content of (content, id, rows) records.

    Records go to one table while it fits. Beyond ``table_bytes`` new contents go to spill files by bits of a hash
    that each level seeds anew, and each file is a problem of its own. Contents in the table stay there, so a content
    is either in the table or in one file. Each level's table takes its share, so levels end; bytes in memory stay near
    table_bytes for each of them however long the input is.
    """
    table, files, folder = ContentTable(), None, None
    try:
        for content, doc_id, rows in records:
            h = xxhash.xxh3_64_intdigest(content, seed=depth)
            if table.bytes >= table_bytes:
                if files is None:
                    folder = tempfile.mkdtemp(prefix="grace-")
                    files = [open(f"{folder}/{k}", "w+b") for k in range(FANOUT)]
                    spilled = [0] * FANOUT
                if not _held(table, h, content):
                    pickle.dump((content, doc_id, rows), files[h >> 60], protocol=5)
                    spilled[h >> 60] += 1
                    continue
            table.add(h, content, doc_id, rows)
        yield from table.entries
        table = None
        for k, f in enumerate(files or ()):
            f.seek(0)
            yield from grace((pickle.load(f) for _ in range(spilled[k])), table_bytes, depth + 1)
            f.close()
    finally:
        if folder:
            for f in files:
                f.close()
            shutil.rmtree(folder, ignore_errors=True)


def _held(table: ContentTable, h: int, content: str) -> bool:
    mask = len(table.slots) - 1
    at = h & mask
    while (k := table.slots[at]) >= 0:
        if table.hashes[k] == h and table.entries[k][0] == content:
            return True
        at = (at + 1) & mask
    return False


def _distinct(table_bytes: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records():
            for b in batches:
                cols = b.to_pydict()
                n = cols.get("n") or [1] * b.num_rows
                yield from zip(cols["text"], cols["doc_id"], n, strict=True)

        out, size = [], 0
        for entry in grace(records(), table_bytes):
            out.append(entry)
            size += len(entry[0])
            if size > (4 << 20) or len(out) >= 5000:
                yield _batch(out)
                out, size = [], 0
        if out:
            yield _batch(out)

    return task


def _batch(entries: list[list]) -> pa.RecordBatch:
    text, ids, n = zip(*entries, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(text, pa.string()), pa.array(ids, pa.int64()), pa.array(n, pa.int64())], ["text", "doc_id", "n"]
    )


def exact_groups(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without any change; null counts as empty. Of equal texts the row with the largest
    doc_id stays (kept is true for each row with that id, so a row that is there twice under one id stays twice in
    kept; null ids come last). Other columns are ignored.

    First each input partition is reduced to its distinct contents, so a text that fills a third of the input is at most
    one record per partition in the shuffle. The shuffled records are reduced in the same way. Each row then finds its
    group by its SHA-256, a second hash and the length; groups with a large share of all rows are broadcast, the others
    joined by a shuffle.
    Two different contents under one such address end the job with an error instead of being merged.
    """
    rows = only(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    schema = "text string, doc_id long, n long"
    partial = map_arrow(rows, _distinct(table_bytes), schema)
    merged = map_arrow(partial.repartition(F.xxhash64("text", F.length("text"))), _distinct(table_bytes), schema)
    address = [F.sha2("text", 256).alias("text_sha256"), F.xxhash64("text").alias("x"), F.octet_length("text").alias("len")]
    groups = merged.select(*address, F.col("doc_id").alias("keep_id"), F.col("n").alias("group_size"))
    groups = groups.groupBy("text_sha256", "x", "len").agg(
        F.max("keep_id").alias("keep_id"),
        F.when(F.count("*") == 1, F.max("group_size")).otherwise(
            F.raise_error(F.lit("different texts share one address"))
        ).alias("group_size"),
    )
    out = join_counted(rows.select("doc_id", *address), groups, ["text_sha256", "x", "len"], "group_size")
    return out.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever these are called.

    Of several rows with one doc_id and one text, one stays: that whose other columns have the smallest hash. Null and
    empty texts are equal, so one of them stays. An empty table stays empty.
    """
    groups = exact_groups(docs).where("kept").groupBy("doc_id", "text_sha256").agg(F.count("*").alias("rows"))
    stay = cut(groups.select(F.col("doc_id").alias("id2"), F.col("text_sha256").alias("sha2"), "rows"))
    sha = F.sha2(F.coalesce(F.col("`text`"), F.lit("")), 256)
    packed = docs.select(F.col("`doc_id`").alias("id"), sha.alias("sha"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    same = F.col("id").eqNullSafe(F.col("id2")) & (F.col("sha") == F.col("sha2"))
    kept = packed.join(stay.where("rows = 1"), same, "left_semi").select("row")
    if stay.where("rows > 1").limit(1).count():
        twice = packed.join(stay.where("rows > 1"), same, "left_semi")
        kept = kept.unionByName(twice.groupBy("id", "sha").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row")).select("row"))
    return kept.select("row.*")
