"""Event-time bars, their coverage, and checks against klines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeloom.functions.timing import ID_WIDTH, asof, bucket, max_before, prefix_sum

PRICES = ("open", "high", "low", "close")


def time_bars(trades: DataFrame, width_ms: int) -> DataFrame:
    """B1: half-open, epoch-aligned bars: OHLC, volume, buy and sell volume, delta, trade count."""
    key = F.struct("ts_ms", "trade_id")
    buy = F.sum(F.when(F.col("aggressor") == "buy", F.col("qty")).otherwise(0))
    sell = F.sum(F.when(F.col("aggressor") == "sell", F.col("qty")).otherwise(0))
    bars = trades.groupBy("instrument", bucket(F.col("ts_ms"), width_ms).alias("bar_ms")).agg(
        F.min_by("price", key).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", key).alias("close"), F.sum("qty").alias("volume"), buy.alias("buy_volume"),
        sell.alias("sell_volume"), F.count("*").alias("n_trades"),
    )
    return bars.withColumn("delta", F.col("buy_volume") - F.col("sell_volume"))


def dense_bars(bars: DataFrame, width_ms: int) -> DataFrame:
    """B2: a bar for every elapsed interval; empty ones have null prices and no volume."""
    span = bars.groupBy("instrument").agg(F.min("bar_ms").alias("a"), F.max("bar_ms").alias("b"))
    grid = span.select("instrument", F.explode(F.sequence("a", "b", F.lit(width_ms))).alias("bar_ms"))
    out = grid.join(bars, ["instrument", "bar_ms"], "left")
    return out.fillna(0, ["volume", "buy_volume", "sell_volume", "n_trades", "delta"])


def gap_buckets(gaps: DataFrame, width_ms: int) -> DataFrame:
    """The bars that each closed gap interval touches."""
    first, last = bucket(F.col("start_ms"), width_ms), bucket(F.col("end_ms"), width_ms)
    return gaps.select("instrument", F.explode(F.sequence(first, last, F.lit(width_ms))).alias("bar_ms")).distinct()


def coverage(dense: DataFrame, gaps: DataFrame, width_ms: int) -> DataFrame:
    """The first bar is partial_start; a bar that a gap overlaps has feed_gap."""
    touched = gap_buckets(gaps, width_ms).withColumn("g", F.lit(True))
    first = dense.groupBy("instrument").agg(F.min("bar_ms").alias("first_ms"))
    out = dense.join(touched, ["instrument", "bar_ms"], "left").join(first, "instrument")
    return out.select(*dense.columns, (F.col("bar_ms") == F.col("first_ms")).alias("partial_start"), F.coalesce("g", F.lit(False)).alias("feed_gap"))


def known_at(bars: DataFrame, trades: DataFrame, width_ms: int) -> DataFrame:
    """A bar is closed by the first trade at or after its end; null while there is none."""
    ended = bars.withColumn("end_ms", F.col("bar_ms") + width_ms)
    times = trades.select("instrument", "ts_ms")
    return asof(ended, times, ["instrument"], "end_ms", "ts_ms", {"ts_ms": "known_at"}, forward=True).drop("end_ms")


def developing(trades: DataFrame, width_ms: int) -> DataFrame:
    """The bar so far, at each trade."""
    w = W.partitionBy("instrument", "bar_ms").orderBy("ts_ms", "trade_id").rowsBetween(W.unboundedPreceding, 0)
    t = trades.withColumn("bar_ms", bucket(F.col("ts_ms"), width_ms))
    return t.select(
        "instrument", "trade_id", "bar_ms", F.first("price").over(w).alias("open"), F.max("price").over(w).alias("high"),
        F.min("price").over(w).alias("low"), F.col("price").alias("close"), F.sum("qty").over(w).alias("volume"),
    )


def compare_klines(bars: DataFrame, klines: DataFrame, fields: tuple = (*PRICES, "volume")) -> DataFrame:
    """Per bar of both sides the fields that differ, comma-joined in order."""
    k = klines.select("instrument", "bar_ms", *[F.col(f).alias(f"k_{f}") for f in fields])
    differ = [F.when(~F.col(f).eqNullSafe(F.col(f"k_{f}")), F.lit(f)) for f in fields]
    return bars.join(k, ["instrument", "bar_ms"]).select("instrument", "bar_ms", F.concat_ws(",", *differ).alias("mismatches"))


def kline_verdict(compared: DataFrame, expected: int | Column) -> DataFrame:
    """Pass, fail or inconclusive from the counts of compared, matched and missing bars."""
    c = compared.agg(F.count("*").alias("compared"), F.count_if(F.col("mismatches") == "").alias("matched"))
    c = c.withColumn("missing", F.lit(expected) - F.col("compared"))
    verdict = F.when(F.col("compared") == 0, "inconclusive").when(F.col("matched") < F.col("compared"), "fail")
    return c.withColumn("verdict", verdict.when(F.col("missing") > 0, "inconclusive").otherwise("pass"))


def id_blocks(ranges: DataFrame) -> DataFrame:
    """(instrument, first_id, last_id, side, volume) of two sides -> blocks of overlapping id ranges and both volumes."""
    order = ["first_id", "last_id"]
    r = max_before(ranges, ["instrument"], "first_id", order, "last_id", "reach", ID_WIDTH)
    r = r.withColumn("new", F.coalesce((F.col("first_id") > F.col("reach")).cast("int"), F.lit(1)))
    r = prefix_sum(r, ["instrument"], "first_id", order, "new", "block", ID_WIDTH, peers=True)
    side = lambda s: F.sum(F.when(F.col("side") == s, F.col("volume")).otherwise(0))
    b = r.groupBy("instrument", "block").agg(
        F.min("first_id").alias("first_id"), F.max("last_id").alias("last_id"), side("a").alias("volume_a"), side("b").alias("volume_b")
    )
    return b.withColumn("equal", F.col("volume_a") == F.col("volume_b"))
