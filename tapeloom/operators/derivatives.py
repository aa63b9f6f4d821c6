"""Open interest, mark price, funding and liquidation features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeloom.functions.timing import asof, bucket

SLACK_MS, STALE_MS, GRID_MS = 15_000, 60_000, 300_000


def oi_steps(samples: DataFrame, slack_ms: int = SLACK_MS) -> DataFrame:
    """Change and elapsed time against the sample before, if it isn't older than the resolution and some slack; change per minute."""
    w = W.partitionBy("instrument", "resolution_ms").orderBy("ts_ms", "seq")
    s = samples.withColumns({"p_oi": F.lag("oi").over(w), "elapsed_ms": F.col("ts_ms") - F.lag("ts_ms").over(w)})
    ok = F.col("elapsed_ms") <= F.col("resolution_ms") + slack_ms
    delta = F.when(ok, F.col("oi") - F.col("p_oi"))
    return s.select("instrument", "seq", "oi", delta.alias("delta"), F.when(ok, F.col("elapsed_ms")).alias("elapsed_ms"), F.when(ok & (F.col("elapsed_ms") > 0), delta * 60_000 / F.col("elapsed_ms")).alias("per_minute"))


def oi_grid(samples: DataFrame, grid_ms: int = GRID_MS, stale_ms: int = STALE_MS) -> DataFrame:
    """D3: the last sample at or before each boundary, if not stale; change only against the adjacent boundary that is ready."""
    span = samples.groupBy("instrument").agg((bucket(F.min("ts_ms"), grid_ms) + grid_ms).alias("a"), bucket(F.max("ts_ms"), grid_ms).alias("b")).where("a <= b")
    grid = span.select("instrument", F.explode(F.sequence("a", "b", F.lit(grid_ms))).alias("grid_ms"))
    g = asof(grid, samples, ["instrument"], "grid_ms", "ts_ms", {"oi": "oi", "ts_ms": "sample_ms"}, tie="seq")
    g = g.withColumn("oi", F.when(F.col("grid_ms") - F.col("sample_ms") <= stale_ms, F.col("oi")))
    w = W.partitionBy("instrument").orderBy("grid_ms")
    return g.select("instrument", "grid_ms", "oi", (F.col("oi") - F.lag("oi").over(w)).alias("delta"))


def mark_state(marks: DataFrame, at: DataFrame) -> DataFrame:
    """Basis and time to the next funding, of the last mark at or before each moment."""
    m = asof(at, marks, ["instrument"], "at_ms", "ts_ms", {"mark": "mark", "index": "index", "next_funding_ms": "next_funding_ms"}, tie="seq")
    return m.select("instrument", "at_ms", (F.col("mark") - F.col("index")).alias("basis"), (F.col("next_funding_ms") - F.col("at_ms")).alias("to_funding_ms"))


def settled_funding(settlements: DataFrame, at: DataFrame) -> DataFrame:
    """The last settled rate at each moment."""
    return asof(at, settlements, ["instrument"], "at_ms", "ts_ms", {"rate": "rate", "ts_ms": "settled_ms"}, tie="seq")


def liquidation_windows(events: DataFrame, n: int, width_ms: int) -> DataFrame:
    """Count and quantity by side over the last n closed intervals, once n have passed since the first event."""
    per = events.groupBy("instrument", bucket(F.col("ts_ms"), width_ms).alias("bar_ms")).agg(
        *[F.count_if(F.col("aggressor") == s).alias(f"n_{s}") for s in ("buy", "sell")],
        *[F.sum(F.when(F.col("aggressor") == s, F.col("qty")).otherwise(0)).alias(f"q_{s}") for s in ("buy", "sell")],
    )
    span = per.groupBy("instrument").agg(F.min("bar_ms").alias("a"), F.max("bar_ms").alias("b"))
    grid = span.select("instrument", F.explode(F.sequence("a", "b", F.lit(width_ms))).alias("bar_ms"))
    cols = ["n_buy", "n_sell", "q_buy", "q_sell"]
    d = grid.join(per, ["instrument", "bar_ms"], "left").fillna(0, cols)
    w = W.partitionBy("instrument").orderBy("bar_ms")
    d = d.select("instrument", "bar_ms", *[F.sum(c).over(w.rowsBetween(-(n - 1), 0)).alias(c) for c in cols], F.row_number().over(w).alias("seen"))
    return d.where(F.col("seen") >= n).drop("seen")
