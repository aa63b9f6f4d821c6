"""Results of experiments, appended once and compared ever after."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.tables import shared_folder

KEY = ["spec", "pipeline", "engine"]


def content_hash(values: list[str]) -> Column:
    """A digest of the named columns, each with its length; null differs from every text."""
    parts = [F.coalesce(F.concat(F.length(F.col(v).cast("string")).cast("string"), F.lit(":"), F.col(v).cast("string")), F.lit("-")) for v in values]
    return F.sha2(F.concat(*parts), 256)


def record(results: DataFrame, store: str, values: list[str]) -> DataFrame:
    """(spec, pipeline, engine, content, stored, verdict) of each result, whose new keys are appended to the table at ``store``.

    verdict: recorded (the key is new), reproduced (stored with the same content), diverged (stored with another content, which stays), conflicting
    (the key comes with several contents at once; none is stored). A repeated run adds no row, and nothing is ever overwritten. Each append is one
    job, whose files count when it commits, so a lost run leaves the table as it was. Stored contents are compared by key in a join; one writer at a time.
    """
    spark = results.sparkSession
    fresh = results.select(*KEY, content_hash(values).alias("content"), *values).dropDuplicates([*KEY, "content"])
    several = fresh.groupBy(*KEY).agg((F.count("*") > 1).alias("conflict"))
    fresh = fresh.join(several, KEY)
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        known = spark.read.parquet(store).select(*KEY, F.col("content").alias("stored"))
    else:
        known = spark.createDataFrame([], "spec string, pipeline string, engine string, stored string")
    judged = fresh.join(known, KEY, "left")
    verdict = F.when(F.col("stored") == F.col("content"), "reproduced").when(F.col("stored").isNotNull(), "diverged").when(F.col("conflict"), "conflicting").otherwise("recorded")
    settled = f"{shared_folder(spark)}/verdicts-{uuid.uuid4().hex}"
    judged.withColumn("verdict", verdict).write.parquet(settled)  # as it is before the append
    out = spark.read.parquet(settled)
    out.where("verdict = 'recorded'").select(*KEY, "content", *values).write.mode("append").parquet(store)
    return out.select(*KEY, "content", "stored", "verdict")
