"""Order flow: cumulative delta and rolling aggression windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeloom.functions.timing import bucket, prefix_sum

DAY_MS = 86_400_000


def signed(trades: DataFrame) -> DataFrame:
    return trades.withColumn("signed", F.when(F.col("aggressor") == "buy", F.col("qty")).otherwise(-F.col("qty")))


def cumulative_delta(trades: DataFrame) -> DataFrame:
    """running signed quantity per instrument, in day buckets with carried sums."""
    out = prefix_sum(signed(trades), ["instrument"], "ts_ms", ["ts_ms", "trade_id"], "signed", "cvd")
    return out.select("instrument", "trade_id", "ts_ms", "cvd")


def day_delta(trades: DataFrame) -> DataFrame:
    """running signed quantity since 00:00 UTC."""
    w = W.partitionBy("instrument", "day_ms").orderBy("ts_ms", "trade_id").rowsBetween(W.unboundedPreceding, 0)
    t = signed(trades).withColumn("day_ms", bucket(F.col("ts_ms"), DAY_MS))
    return t.select("instrument", "trade_id", "day_ms", F.sum("signed").over(w).alias("cvd_utc_day"))


def large_prints(trades: DataFrame, width_ms: int, threshold: int) -> DataFrame:
    """volume of trades whose notional is at or above the threshold, per bar."""
    big = F.col("price") * F.col("qty") >= F.lit(threshold)
    return trades.groupBy("instrument", bucket(F.col("ts_ms"), width_ms).alias("bar_ms")).agg(
        F.sum(F.when(big, F.col("qty")).otherwise(0)).alias("large_volume"), F.count_if(big).alias("n_large")
    )


def _ratio(a: Column, b: Column) -> Column:
    return a / F.when(b != 0, b)


def windows(dense: DataFrame, n: int, width_ms: int) -> DataFrame:
    """sums over the last n bars, the price before them, displacement and ratios; null on a zero divisor."""
    w = W.partitionBy("instrument").orderBy("bar_ms")
    last_n, before = w.rowsBetween(-(n - 1), 0), w.rowsBetween(W.unboundedPreceding, -n)
    sums = {c: F.sum(c).over(last_n).cast("long") for c in ("buy_volume", "sell_volume", "delta", "volume", "n_trades", "large_volume")}
    out = dense.select(
        "instrument", "bar_ms", *[v.alias(f"w_{c}") for c, v in sums.items()],
        F.max(F.col("partial_start").cast("int")).over(last_n).cast("boolean").alias("w_partial_start"),
        F.max(F.col("feed_gap").cast("int")).over(last_n).cast("boolean").alias("w_feed_gap"),
        F.last("close", ignorenulls=True).over(before).alias("reference"),
        F.last("close", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)).alias("last_close"),
        F.row_number().over(w).alias("seen"),
    ).where(F.col("seen") >= n)
    minutes = n * width_ms / 60_000
    return out.select(
        *[c for c in out.columns if c not in ("seen", "last_close")],
        (F.col("last_close") - F.col("reference")).alias("displacement"),
        _ratio(F.col("w_delta"), F.col("w_volume")).alias("imbalance"),
        (F.col("w_n_trades") / F.lit(minutes)).alias("trades_per_minute"),
        (F.col("w_volume") / F.lit(minutes)).alias("volume_per_minute"),
        _ratio(F.col("w_large_volume"), F.col("w_volume")).alias("large_share"),
        _ratio(F.col("last_close") - F.col("reference"), F.col("w_delta")).alias("price_response"),
    )
