"""The incremental features as Structured Streaming queries over the tape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.sources.tape import BUY_TYPES


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events files as a stream of trades with an event-time column ``at`` and a watermark of two seconds (M1)."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").load(f"{sf_dir}/events.parquet*", format="parquet")
    at = F.col("ts").cast("timestamp")
    t = e.where("event_type <> 'error'").select(
        (F.col("user_id") % 4).alias("instrument"), at.alias("at"), F.col("event_id").alias("trade_id"),
        F.round(F.col("value") * 100_000_000).cast("long").alias("price"), F.get_json_object("props", "$.k").cast("long").alias("qty"),
        F.when(F.col("event_type").isin(*BUY_TYPES), "buy").otherwise("sell").alias("aggressor"),
    )
    return t.where("qty > 0").withWatermark("at", "2 seconds")


def deduplicated(trades: DataFrame) -> DataFrame:
    """M3: one row per instrument and id within the watermark."""
    return trades.dropDuplicatesWithinWatermark(["instrument", "trade_id"])


def bars(trades: DataFrame, width: str) -> DataFrame:
    """M4: tumbling event-time bars."""
    return _summed(trades, F.window("at", width))


def sliding(trades: DataFrame, width: str, step: str) -> DataFrame:
    """M5: windows of ``width`` that begin each ``step``."""
    return _summed(trades, F.window("at", width, step))


def sessions(trades: DataFrame, gap: str) -> DataFrame:
    """M6: trades of one instrument that are less than ``gap`` apart."""
    return _summed(trades, F.session_window("at", gap))


def _summed(trades: DataFrame, window) -> DataFrame:
    g = trades.groupBy("instrument", window.alias("w")).agg(F.count("*").alias("n"), F.sum("qty").alias("qty"), F.max("price").alias("high"), F.min("price").alias("low"))
    return g.select("instrument", F.unix_millis(F.col("w.start")).alias("start_ms"), F.unix_millis(F.col("w.end")).alias("end_ms"), "n", "qty", "high", "low")


def run_once(df: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all files that are there, into a Parquet table under ``path``, and returns the table.

    Append mode emits only windows that the watermark has closed; the last ones wait for later events (M10).
    """
    q = df.writeStream.format("parquet").option("checkpointLocation", f"{path}/_state").outputMode(mode).trigger(availableNow=True).start(f"{path}/rows")
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/rows")
