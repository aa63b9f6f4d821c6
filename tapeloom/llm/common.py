"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.functions.shipping import ship
from tapeloom.functions.tables import shared_folder

#: ASCII white space that separates words, and the same set inside a regular expression.
SPACES = " \t\n\x0b\x0c\r"
NOT_SPACE = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see; a temporary one only where none is set and Spark runs in one process."""
    folder = shared_folder(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """The same rows from the shared folder, without the lineage behind them."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The same rows from a table in the shared folder, and its path; for loops, as a plan read anew carries nothing along."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files of jobs that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z and nothing else. The plain lower() is the same on pure ASCII, and faster."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def words(c: Column, pattern: str = NOT_SPACE) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), F.lit(0))


def row_key(doc_id: Column, text: Column) -> Column:
    """Names a row by its doc_id (null as the largest number) and a hash of its text; equal rows share it."""
    return F.struct(F.coalesce(doc_id, F.lit((1 << 63) - 1)).alias("id"), F.xxhash64(text).alias("text"))


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns; other columns, whatever they are called, don't get in the way."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def join_counted(left: DataFrame, right: DataFrame, keys: list[str], weight: str = "n", parts: int = 1000, written: bool = False) -> DataFrame:
    """Inner join of ``left`` with one row per key, whose ``weight`` is the number of rows that ``left`` has of it.

    Keys with at least 1 / ``parts`` of all counted rows, so ``parts`` keys at most, are broadcast: their rows needn't meet in
    one task. All other keys are joined by a shuffle, in which none has more than that share. A ``right`` that is a written
    table already isn't written again.
    """
    right = right if written else cut(right)
    total = right.agg(F.sum(weight)).first()[0] or 0
    heavy = (F.col(weight) * parts >= total) & (F.col(weight) >= parts)
    if not right.where(heavy).limit(1).count():
        return left.join(right, keys)
    hot, cold = F.broadcast(right.where(heavy)), right.where(~heavy)
    return left.join(hot, keys).unionByName(left.join(hot.select(*keys), keys, "left_anti").join(cold, keys))


def map_arrow(df: DataFrame, task: Callable, schema) -> DataFrame:
    """mapInArrow(), with this package at hand in the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(task, schema)
