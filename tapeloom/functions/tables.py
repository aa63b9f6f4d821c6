"""Derived tables that several queries read: written once per session to the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

_written: dict[tuple, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where Spark runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return _written.setdefault(("folder",), tempfile.mkdtemp(prefix="tapeloom-"))


def content_of(spark: SparkSession, folder: str) -> tuple:
    """Names, sizes and times of what lies in a folder; another tuple when a table there was written again."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    listed = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in listed))


def kept(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """build(spark, sf_dir, ...) -> the same rows, read from a table that the session's first call writes.

    The table is written anew when the input folder has changed since. A lost executor loses nothing: the table is outside.
    """

    @wraps(build)
    def read(spark: SparkSession, sf_dir: str, *more) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf_dir, content_of(spark, sf_dir), build.__module__, build.__qualname__, *more)
        if key not in _written:
            path = f"{shared_folder(spark)}/table-{build.__name__}-{uuid.uuid4().hex}"
            build(spark, sf_dir, *more).write.parquet(path)
            _written[key] = path
        return spark.read.parquet(_written[key])

    return read


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows from a table in the shared folder: for rows that are used several times, so that what is before them runs once."""
    path = f"{shared_folder(df.sparkSession)}/rows-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
