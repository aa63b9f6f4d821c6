"""Deterministic sharded WARC writer and reader."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import os
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm.common import cut, join_counted, map_arrow, only

#: Compressed bytes after which a file is rolled, raw bytes that a shard should have, and the most shards, whose bounds
#: the driver and each task hold (a larger archive has larger shards, which roll to more files).
ROLL_BYTES, SHARD_BYTES, MAX_SHARDS = 64 << 20, 16 << 20, 20_000
#: Keys of a fixed sample from which shard bounds are taken, at least; 16 for each shard if that is more.
BOUNDS_SAMPLE = 4096
DATE = "2024-01-01T00:00:00Z"
LEAST = -(1 << 63)
NAMES = uuid.uuid5(uuid.NAMESPACE_URL, "urn:tapeloom:warc")


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record as a gzip member. All headers follow from the arguments, so the same page gives the same bytes."""
    kind, digest = ("revisit" if revisit else "response"), sha1_base32(payload)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(NAMES, f'{page_id}:{digest}')}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {(url or '').replace(chr(13), '%0D').replace(chr(10), '%0A')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-Id: {'' if page_id is None else page_id}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(NAMES, f'{refers_to}:{digest}')}>",
            f"X-Refers-To-Page-Id: {'' if refers_to is None else refers_to}",
        ]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = head if revisit else head + payload
    lines += [f"WARC-Block-Digest: sha1:{sha1_base32(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    raw = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    out = io.BytesIO()
    with gzip.GzipFile(fileobj=out, mode="wb", compresslevel=6, mtime=0, filename="") as f:
        f.write(raw)
    return out.getvalue()


class Store:
    """Files under a URI that every executor reaches: a shared folder, or what Arrow's file systems can open."""

    def __init__(self, root: str) -> None:
        from pyarrow import fs

        self.local = root.startswith(("/", "file:"))
        if self.local:
            self.root = "/" + root.removeprefix("file:").lstrip("/")
        else:
            self.fs, self.root = fs.FileSystem.from_uri(root)

    def open(self, name: str):
        path = posixpath.join(self.root, name)
        if self.local:
            os.makedirs(self.root, exist_ok=True)
            return open(path, "wb")
        self.fs.create_dir(self.root, recursive=True)
        return self.fs.open_output_stream(path)

    def source(self, name: str):
        """A file to read from any place."""
        path = posixpath.join(self.root, name)
        return open(path, "rb") if self.local else self.fs.open_input_file(path)

    def size(self, name: str) -> int:
        path = posixpath.join(self.root, name)
        return os.path.getsize(path) if self.local else self.fs.get_file_info(path).size

    def commit(self, temporary: str, name: str) -> None:
        """The file gets its name only when it is whole. Another attempt's file has the same bytes."""
        a, b = posixpath.join(self.root, temporary), posixpath.join(self.root, name)
        if self.local:
            os.replace(a, b)
        else:
            self.fs.move(a, b)


class _Roller:
    def __init__(self, store: Store, shard: int, roll_bytes: int) -> None:
        self.store, self.shard, self.roll = store, shard, roll_bytes
        self.part, self.file = 0, None

    def write(self, member: bytes) -> tuple | None:
        """The finished file's line of the manifest, if this record doesn't fit it any more."""
        done = self.close() if self.file and self.size + len(member) > self.roll else None
        if not self.file:
            self.name = f"shard-{self.shard:05d}-{self.part:05d}.warc.gz"
            self.temporary = f"_{self.name}.{TaskContext.get().taskAttemptId()}.tmp"
            self.file, self.size, self.records, self.sha = self.store.open(self.temporary), 0, 0, hashlib.sha256()
            self.part += 1
        self.file.write(member)
        self.sha.update(member)
        self.size += len(member)
        self.records += 1
        return done

    def close(self) -> tuple | None:
        if not self.file:
            return None
        self.file.close()
        self.file = None
        self.store.commit(self.temporary, self.name)
        return self.name, self.records, self.size, self.sha.hexdigest()


MANIFEST = "file string, records long, bytes long, sha256 string"


def _write_task(root: str, roll_bytes: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, roller, done, copy = Store(root), None, [], None
        for batch in batches:
            cols = [batch.column(c) for c in ("shard", "page_id", "digest", "mark", "refers_to", "url", "html")]
            for row in zip(*cols, strict=True):
                shard, page_id, digest, mark, refers_to, url, html = (x.as_py() for x in row)
                if mark:
                    copy = (page_id, digest, refers_to, mark)
                    continue
                key = (page_id, digest)
                revisit = bool(copy) and copy[:2] == key
                target = copy[2] if revisit else None
                if revisit and copy[3] == 2:  # equal rows of the response's own page: the first is the response
                    copy, revisit, target = (page_id, digest, copy[2], 1), False, None
                if roller is None or roller.shard != shard:
                    done += [x for x in [roller and roller.close()] if x]
                    roller = _Roller(store, shard, roll_bytes)
                done += [x for x in [roller.write(record(page_id, url, (html or "").encode(), target, revisit))] if x]
        done += [x for x in [roller and roller.close()] if x]
        if done:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)],
                ["file", "records", "bytes", "sha256"],
            )

    return task


def _bounds(keys: DataFrame, shards: int) -> list[int]:
    """shards - 1 bounds of page_id: quantiles of the keys with the smallest hashes, the same in every run."""
    if shards < 2:
        return []
    least = keys.select("page_id", F.xxhash64("page_id").alias("h")).orderBy("h", "page_id").limit(max(BOUNDS_SAMPLE, 16 * shards))
    ids = sorted(r[0] for r in least.select("page_id").collect())
    return sorted({ids[k * len(ids) // shards] for k in range(1, shards)}) if ids else []


def write_warc(
    pages: DataFrame, root: str, min_bytes: int = 0, roll_bytes: int = ROLL_BYTES, shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """Writes one WARC record for each row of ``pages`` (page_id, url, html) under ``root`` and returns the manifest.

    The payload is html in UTF-8; null is empty. Of records with equal payloads of at least ``min_bytes`` bytes, the
    one with the largest page_id is the response, the others revisit it; smaller ones are all responses. Null page_ids
    come first in order. Of equal rows of the response's page the first is the response. Other columns are ignored.

    Records are dealt to shards by ranges of page_id and sorted within them. Bounds come from a fixed sample of keys,
    their number from the bytes of all payloads, headers and digests from the record alone, so the same rows give the same
    files, whatever the session's settings are. URLs are kept in UTF-8, with line ends as %0D and %0A. A file is rolled before it would
    exceed ``roll_bytes`` compressed bytes. Each file is written under a temporary name and renamed when whole; the
    manifest (file, records, bytes, sha256) names what counts, and is written to ``root`` as _manifest.

    Payload groups are found by digest, after a map-side combine; html is shuffled once.
    """
    spark = pages.sparkSession
    rows = only(pages, "page_id", "url", "html").withColumn("order", F.coalesce("page_id", F.lit(LEAST)))
    payload = F.coalesce("html", F.lit(""))
    rows = rows.withColumn("digest", F.sha2(payload, 256))
    ids = cut(rows.select("page_id", "order", "digest", F.octet_length(payload).alias("n_bytes")))
    groups = ids.where(F.col("n_bytes") >= min_bytes).groupBy("digest").agg(F.max("order").alias("keep"), F.count("*").alias("n"))
    groups = groups.where("n > 1")
    marks = join_counted(ids.where(F.col("n_bytes") >= min_bytes), groups, ["digest"]).select(
        "page_id", "order", "digest", F.when(F.col("order") != F.col("keep"), 1).otherwise(2).alias("mark"),
        F.nullif(F.col("keep"), F.lit(LEAST)).alias("refers_to"),
    ).distinct()
    total = ids.agg(F.sum("n_bytes")).first()[0] or 0
    bounds = _bounds(ids.select(F.col("order").alias("page_id")), min(1 + total // shard_bytes, MAX_SHARDS))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            order = np.searchsorted(np.array(bounds, np.int64), b.column("order").to_numpy(), "right")
            yield b.set_column(0, "shard", pa.array(order.astype(np.int32)))

    every = rows.select("page_id", "order", "digest", F.lit(0).alias("mark"), F.lit(None).cast("long").alias("refers_to"), "url", "html")
    every = every.unionByName(marks.withColumns({"url": F.lit(None).cast("string"), "html": F.lit(None).cast("string")}))
    every = every.select(F.lit(0).alias("shard"), *every.columns)
    dealt = map_arrow(every, numbered, every.schema).repartition(len(bounds) + 1, "shard")
    dealt = dealt.sortWithinPartitions("shard", "order", "digest", F.col("mark").desc(), "url")
    dealt = dealt.select("shard", "page_id", "digest", "mark", "refers_to", "url", "html")
    manifest = map_arrow(dealt, _write_task(root, roll_bytes), MANIFEST)
    manifest.write.parquet(f"{root}/_manifest")
    return spark.read.parquet(f"{root}/_manifest")


RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def parse(data: bytes) -> Iterator[tuple]:
    """The records of one file, as in RECORDS. Digests and lengths are checked."""
    at = 0
    while at < len(data):
        d = zlib.decompressobj(31)
        raw = d.decompress(data[at:at + (1 << 16)])
        at += 1 << 16
        while not d.eof:
            if at >= len(data):
                raise ValueError("a member isn't complete")
            raw += d.decompress(data[at : at + (1 << 20)])
            at += 1 << 20
        at = min(at, len(data)) - len(d.unused_data)
        head, _, rest = raw.partition(b"\r\n\r\n")
        h = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode().split("\r\n")[1:])
        block = rest[: int(h["Content-Length"])]
        if rest[len(block) :] != b"\r\n\r\n" or f"sha1:{sha1_base32(block)}" != h["WARC-Block-Digest"]:
            raise ValueError("a record's block doesn't match its headers")
        revisit = h["WARC-Type"] == "revisit"
        payload = None if revisit else block.partition(b"\r\n\r\n")[2]
        n, digest = int(h["X-Payload-Length"]), h["WARC-Payload-Digest"].removeprefix("sha1:")
        if not revisit and (len(payload) != n or sha1_base32(payload) != digest):
            raise ValueError("a record's payload doesn't match its headers")
        to = h.get("X-Refers-To-Page-Id")
        yield int(h["X-Page-Id"]) if h["X-Page-Id"] else None, n, digest, h["WARC-Type"], int(to) if to else None, h["WARC-Target-URI"], payload


def _parse_task(with_payload: bool):
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                out, size = [], 0
                for row in parse(content.as_py()):
                    out.append(row if with_payload else (*row[:6], None))
                    size += row[1] if with_payload else 100
                    if size > (4 << 20):
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return task


def read_warc(spark: SparkSession, root: str, with_payload: bool = True) -> DataFrame:
    """The records of the files that the manifest under ``root`` names, as in RECORDS; revisits have no payload."""
    manifest = spark.read.parquet(f"{root}/_manifest")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.warc.gz").load(root)
    files = files.withColumn("file", F.element_at(F.split("path", "/"), -1)).join(manifest.select("file"), "file", "left_semi")
    if not manifest.limit(1).count():
        return spark.createDataFrame([], RECORDS)
    return map_arrow(files.select("content"), _parse_task(with_payload), RECORDS)
