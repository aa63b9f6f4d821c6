"""Adapts the generic ``events`` table to a tape of trades and feed gaps.

instrument = user_id mod 4, trade_id = event_id, price in units of 1e-8, qty in whole lots from props, aggressor by
event type; ``error`` events are feed gaps of five minutes. Trades without a positive quantity go to a reject table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.functions.tables import kept

BUY_TYPES = ("purchase", "click", "signup")
GAP_MS = 300_000
DAY_MS = 86_400_000
HOUR_MS = 3_600_000
MINUTE_MS = 60_000


def epoch_ms(df: DataFrame, name: str) -> Column:
    """Milliseconds since 1970, whatever the session's time zone is."""
    if dict(df.dtypes)[name] == "timestamp_ntz":
        return F.expr(f"timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', `{name}`)")
    return F.unix_millis(F.col(name))


def raw_tape(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """The tape of the events table, parsed once per session, or of ``events`` (a stream of the same columns)."""
    return parsed_tape(spark, sf_dir) if events is None else _parsed(events)


@kept
def parsed_tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark.read.parquet(f"{sf_dir}/events.parquet"))


def _parsed(e: DataFrame) -> DataFrame:
    return e.select(
        (F.col("user_id") % 4).alias("instrument"),
        epoch_ms(e, "ts").alias("ts_ms"),
        F.col("event_id").alias("trade_id"),
        F.round(F.col("value") * 100_000_000).cast("long").alias("price"),
        F.get_json_object("props", "$.k").cast("long").alias("qty"),
        F.when(F.col("event_type").isin(*BUY_TYPES), "buy").otherwise("sell").alias("aggressor"),
        "event_type",
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = raw_tape(spark, sf_dir).where("event_type <> 'error' AND qty > 0")
    return t.select("instrument", "ts_ms", "trade_id", "price", "qty", "aggressor")


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = raw_tape(spark, sf_dir).where("event_type = 'error'")
    return t.select("instrument", F.col("ts_ms").alias("start_ms"), (F.col("ts_ms") + GAP_MS).alias("end_ms"))
