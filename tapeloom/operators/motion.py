"""Bar motion, true range, average true range, and volatility regimes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeloom.functions.shipping import ship

ATR_PERIOD, RANK_WINDOW = 14, 200


def with_segment(bars: DataFrame) -> DataFrame:
    """V2: an empty bar that a gap touches breaks the series; segment counts the breaks so far."""
    w = W.partitionBy("instrument").orderBy("bar_ms").rowsBetween(W.unboundedPreceding, 0)
    broken = F.col("close").isNull() & F.col("feed_gap")
    return bars.withColumn("segment", F.sum(broken.cast("long")).over(w))


def motion(bars: DataFrame, width_ms: int) -> DataFrame:
    """V1, V3: change, range, simple return, velocity per minute and true range against the last close of the segment."""
    w = W.partitionBy("instrument", "segment").orderBy("bar_ms").rowsBetween(W.unboundedPreceding, -1)
    b = bars.withColumn("prev_close", F.last("close", ignorenulls=True).over(w)).where("close IS NOT NULL")
    change = F.col("close") - F.col("prev_close")
    true_range = F.greatest(
        F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("prev_close")), F.abs(F.col("low") - F.col("prev_close"))
    )
    return b.select(
        "instrument", "bar_ms", "segment", "open", "high", "low", "close", "prev_close",
        change.alias("change"), (F.col("high") - F.col("low")).alias("range"),
        (change / F.col("prev_close")).alias("simple_return"),
        (change / F.lit(width_ms / 60_000)).alias("velocity"), true_range.alias("true_range"),
    )


def half_even(num: Column, den: int) -> Column:
    """Quotient of whole numbers (num >= 0), rounded half to even."""
    rest = F.pmod(num, F.lit(den))
    q, r = ((num - rest) / F.lit(den)).cast("long"), rest * 2
    up = (r > den) | ((r == den) & (q % 2 == 1))
    return q + F.when(up, 1).otherwise(0)


def rounded_quotient(num: int, den: int) -> int:
    """Quotient of whole numbers (num >= 0), rounded half to even."""
    q, rest = divmod(num, den)
    return q + (2 * rest > den or (2 * rest == den and q % 2 == 1))


def _wilder(period: int):
    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, seen, value = None, 0, 0
        for frame in frames:
            found = []
            for instrument, segment, true_range in zip(frame["instrument"].tolist(), frame["segment"].tolist(), frame["true_range"].tolist(), strict=True):
                if key != (instrument, segment):
                    key, seen, value = (instrument, segment), 0, 0
                seen += 1
                if seen <= period:
                    value += true_range  # the sum of the first ranges until there are enough
                    value = rounded_quotient(value, period) if seen == period else value
                else:
                    value = rounded_quotient(value * (period - 1) + true_range, period)
                found.append((seen, value if seen >= period else None))
            yield frame.assign(observed=[n for n, _ in found], atr=pd.array([v for _, v in found], "Int64"))

    return task


def atr(moved: DataFrame, period: int = ATR_PERIOD) -> DataFrame:
    """V4, V7: Wilder's average true range, each step rounded half to even; null with observed < required while warming up.

    The rounding makes it recursive. Segments pass through their task as a stream, sorted by time, and one value is carried from bar to bar,
    so time grows in proportion to the bars, and memory doesn't grow with a segment.
    """
    ship(moved.sparkSession)
    tr = moved.where("prev_close IS NOT NULL").select("instrument", "segment", "bar_ms", "true_range")
    dealt = tr.repartition("instrument", "segment").sortWithinPartitions("instrument", "segment", "bar_ms")
    types = {f.name: f.dataType.simpleString() for f in tr.schema}
    out = dealt.mapInPandas(_wilder(period), ", ".join(f"{c} {t}" for c, t in types.items()) + ", observed int, atr long")
    return out.withColumn("required", F.lit(period))


def regime(atrs: DataFrame, window: int = RANK_WINDOW) -> DataFrame:
    """V5, V6: share of the previous ``window`` values at or below, and its label by bands closed above at 25, 50, 75."""
    w = W.partitionBy("instrument", "segment").orderBy("bar_ms").rowsBetween(-window, -1)
    a = atrs.where("atr IS NOT NULL").withColumn("past", F.collect_list("atr").over(w))
    below = F.size(F.filter("past", lambda x: x <= F.col("atr")))
    a = a.withColumn("percentile", F.when(F.size("past") == window, below * 100.0 / window))
    label = F.when(F.col("percentile") <= 25, "low").when(F.col("percentile") <= 50, "normal").when(F.col("percentile") <= 75, "elevated").when(F.col("percentile").isNotNull(), "high")
    return a.select("instrument", "segment", "bar_ms", "atr", "percentile", label.alias("regime"))
