"""Line-level deduplication across documents, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import SPACES, cut, join_counted, lower_ascii, only

LAST = (1 << 63) - 1


def drop_shared_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """Drops lines that occur in several documents, but keeps them in one.

    A line's key is the line without ASCII white space at its ends, A-Z in lower case. A key of at least
    ``min_chars`` code points that is found in at least ``min_docs`` documents loses its lines everywhere
    except in the document with the smallest doc_id. Returns doc_id, text (the kept lines), n_lines, n_dropped.

    Rows: one for each input row. A null or empty text is one empty line. Rows that share a doc_id count as one
    document, and so do all rows with a null doc_id, which comes after all others. Other columns are ignored.

    The lines are exploded once to 128-bit keys; documents per key are counted after a map-side combine, so
    a line in a third of all documents is one row per task in that shuffle. Only lines of shared keys that go travel
    on, as positions; keys with a large share of all lines are broadcast, the others joined by a shuffle.
    """
    rows = only(docs, "doc_id", "text").select(
        "doc_id",
        F.coalesce("doc_id", F.lit(LAST)).alias("owner"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("text_key", F.xxhash64("text", F.lit(7)))
    keys = rows.select("owner", "text_key", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keys = keys.select("owner", "text_key", "pos", lower_ascii(F.btrim("line", F.lit(SPACES))).alias("key"))
    keys = keys.where(F.length("key") >= min_chars).select(
        "owner", "text_key", "pos", F.xxhash64("key").alias("k1"), F.xxhash64(F.lit(1), "key").alias("k2")
    )
    if min_docs <= 2:  # two different documents: their smallest and largest ids differ
        shared = keys.groupBy("k1", "k2").agg(F.min("owner").alias("first"), F.max("owner").alias("last"), F.count("*").alias("n"))
        shared = shared.where("first < last" if min_docs == 2 else "true")
    else:
        shared = keys.groupBy("k1", "k2", "owner").agg(F.count("*").alias("lines"))
        shared = shared.groupBy("k1", "k2").agg(F.min("owner").alias("first"), F.count("*").alias("docs"), F.sum("lines").alias("n"))
        shared = shared.where(F.col("docs") >= min_docs)
    shared = shared.select("k1", "k2", "first", "n")
    gone = join_counted(keys, shared, ["k1", "k2"]).where("owner != first")
    gone = cut(gone.groupBy("owner", "text_key").agg(F.collect_set("pos").alias("gone")))
    lines = F.split("text", "\n", -1)
    out = rows.join(gone, ["owner", "text_key"], "left").select(
        "doc_id", lines.alias("lines"), F.coalesce("gone", F.array().cast("array<int>")).alias("gone")
    )
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    return out.select(
        "doc_id",
        F.array_join(
            F.when(F.size("gone") == 0, F.col("lines")).otherwise(F.transform(kept, lambda i: F.get("lines", i))), "\n"
        ).alias("text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size("gone").cast("long").alias("n_dropped"),
    )
