"""A corpus pipeline over documents: toxicity, exact copies, near copies, source mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tapeloom.llm import exact_dedup, jaccard_join, mixing, packing, toxicity
from tapeloom.llm.common import cut, remove, scratch_path, table
from tapeloom.llm.queries import op7_digest, tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic, with all their columns; labels come from the table beside them. An empty table stays empty."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the largest doc_id; null and empty texts are one group."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5 words, 0.8), the one with the smallest doc_id; documents without words stay."""
    return jaccard_join.drop_similar(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; those without words stay once."""
    return mixing.repeat_mixed(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens; a null text has the end token alone. Other columns are gone."""
    return op7_digest(packing.pack(docs, tokenizer_path()))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("source_mixing", mix_sources),
    ("packing", pack_windows),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage; what each stage before it returns is written and read again, and removed when it has been used."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if last:
            remove(spark, last)
        docs, last = spark.read.parquet(path), path
    out = cut(STAGES[-1][1](spark, docs, sf_dir))
    remove(spark, last)
    return out
