"""Volume profiles per session and what is read from them, and session VWAP."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeloom.functions.shipping import ship
from tapeloom.functions.timing import bucket

DAY_MS, MINUTE_MS = 86_400_000, 60_000
KEYS = ["instrument", "day_ms"]
#: Bins of a profile at most, share of the value area, least prominence, smoothing kernel.
MAX_BINS, AREA, PROMINENCE, KERNEL = 10_000, 0.7, 0.1, (1, 2, 3, 2, 1)


def check_parameters(bin_size: int, max_bins: int = MAX_BINS, area: float = AREA, prominence: float = PROMINENCE, kernel: Sequence[int] = KERNEL) -> None:
    """Rejects parameters that make no profile."""
    if bin_size <= 0 or max_bins <= 0 or not 0 < area <= 1 or not 0 <= prominence <= 1:
        raise ValueError("bin_size and max_bins must be positive, area in (0, 1], prominence in [0, 1]")
    if len(kernel) % 2 == 0 or any(k <= 0 for k in kernel) or list(kernel) != list(kernel)[::-1]:
        raise ValueError("the kernel must be positive, symmetric and of odd length")


def histogram(trades: DataFrame, bin_size: int) -> DataFrame:
    """Quantity per price bin and UTC day; bin is the whole number floor(price / bin_size)."""
    binned = F.col("price") - F.pmod("price", F.lit(bin_size))
    day = bucket(F.col("ts_ms"), DAY_MS).alias("day_ms")
    return trades.groupBy("instrument", day, (binned / bin_size).cast("long").alias("bin")).agg(F.sum("qty").alias("qty"))


def dense_histogram(hist: DataFrame, keys: list[str] = KEYS, max_bins: int = MAX_BINS) -> DataFrame:
    """Every bin between the lowest and the highest; sessions wider than ``max_bins`` are left out."""
    span = hist.groupBy(*keys).agg(F.min("bin").alias("lo"), F.max("bin").alias("hi")).where(F.col("hi") - F.col("lo") < max_bins)
    grid = span.select(*keys, F.explode(F.sequence("lo", "hi")).alias("bin"))
    return grid.join(hist, [*keys, "bin"], "left").fillna(0, ["qty"])


def point_of_control(hist: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """The bin of the largest quantity; ties go to the bin next to the centre of the range, then to the lower bin."""
    w = W.partitionBy(*keys)
    c = hist.withColumn("off", F.abs(2 * F.col("bin") - F.min("bin").over(w) - F.max("bin").over(w)))
    return c.groupBy(*keys).agg(
        F.max_by("bin", F.struct("qty", -F.col("off"), -F.col("bin"))).alias("poc"), F.max("qty").alias("poc_qty"),
        F.sum("qty").cast("long").alias("total"), F.min("bin").alias("low_bin"), F.max("bin").alias("high_bin"),
    )


def _fold(dense: DataFrame, keys: list[str], fold, schema: str) -> DataFrame:
    ship(dense.sparkSession)
    return dense.groupBy(*keys).applyInPandas(fold, schema)


def value_area(dense: DataFrame, keys: list[str] = KEYS, area: float = AREA) -> DataFrame:
    """The range around the point of control that holds ``area`` of the quantity.

    It grows by the larger neighbour, by both where they are equal. One group is one session of MAX_BINS bins at most.
    """
    names = list(keys)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        q, first = pdf["qty"].to_numpy(), int(pdf["bin"].iloc[0])
        n, total = len(q), int(q.sum())
        poc = max(range(n), key=lambda i: (q[i], -abs(2 * i - (n - 1)), -i))
        lo = hi = poc
        held = int(q[poc])
        while held < area * total:
            below = int(q[lo - 1]) if lo > 0 else -1
            above = int(q[hi + 1]) if hi < n - 1 else -1
            if below >= above:
                lo, held = lo - 1, held + below
            if above >= below:
                hi, held = hi + 1, held + above
        row = {k: pdf[k].iloc[0] for k in names}
        return pd.DataFrame([row | {"poc": first + poc, "val": first + lo, "vah": first + hi, "area_qty": held, "total": total}])

    schema = ", ".join(f"{k} long" for k in names) + ", poc long, val long, vah long, area_qty long, total long"
    return _fold(dense, names, fold, schema)


def smoothed(dense: DataFrame, keys: list[str] = KEYS, kernel: Sequence[int] = KERNEL) -> DataFrame:
    """P5: weighted sums of neighbouring bins; bins outside the range count as empty."""
    w, half = W.partitionBy(*keys).orderBy("bin"), len(kernel) // 2
    parts = []
    for k, weight in enumerate(kernel):
        move = k - half
        parts.append(weight * (F.lag("qty", -move, 0).over(w) if move < 0 else F.lead("qty", move, 0).over(w) if move else F.col("qty")))
    return dense.withColumn("smooth", sum(parts[1:], parts[0]))


def peaks(y: np.ndarray) -> list[tuple[int, int, float]]:
    """Plateaus above both sides: (first, last, prominence); the ends of the range count as valleys of height 0."""
    out, n, i = [], len(y), 0
    while i < n:
        j = i
        while j + 1 < n and y[j + 1] == y[i]:
            j += 1
        if (i == 0 or y[i - 1] < y[i]) and (j == n - 1 or y[j + 1] < y[i]):
            base = []
            for step, at, end in ((-1, i - 1, -1), (1, j + 1, n)):
                low = y[i]
                while at != end and y[at] <= y[i]:
                    low = min(low, y[at])
                    at += step
                base.append(low if at != end else 0)
            out.append((i, j, float(y[i] - max(base))))
        i = j + 1
    return out


def nodes(smooth: DataFrame, keys: list[str] = KEYS, prominence: float = PROMINENCE) -> DataFrame:
    """High volume nodes (peaks) and low volume nodes (valleys) whose prominence is at least a share of the maximum."""
    names = list(keys)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        y, first = pdf["smooth"].to_numpy().astype(float), int(pdf["bin"].iloc[0])
        top, rows = float(y.max()), []
        for kind, curve in (("hvn", y), ("lvn", top - y)):
            for i, j, p in peaks(curve):
                inner = kind == "hvn" or (i > 0 and j < len(y) - 1)
                if inner and top > 0 and p >= prominence * top:
                    rows.append({k: pdf[k].iloc[0] for k in names} | {"kind": kind, "low_bin": first + i, "high_bin": first + j, "bin": first + (i + j) // 2, "prominence": p})
        cols = [*names, "kind", "low_bin", "high_bin", "bin", "prominence"]
        return pd.DataFrame(rows, columns=cols)

    schema = ", ".join(f"{k} long" for k in names) + ", kind string, low_bin long, high_bin long, bin long, prominence double"
    return _fold(smooth, names, fold, schema)


def prior_day(levels: DataFrame) -> DataFrame:
    """A day's levels, seen from the next day."""
    return levels.withColumn("day_ms", F.col("day_ms") + DAY_MS)


def composite(hist: DataFrame, days: int) -> DataFrame:
    """Bin-wise sums of the last ``days`` completed days, for each day that has as many days before it."""
    targets = F.explode(F.transform(F.sequence(F.lit(1), F.lit(days)), lambda k: F.col("day_ms") + k * F.lit(DAY_MS)))
    spread = hist.withColumn("target", targets)
    span = hist.groupBy("instrument").agg(F.min("day_ms").alias("a"), F.max("day_ms").alias("b"))
    full = spread.join(span, "instrument").where((F.col("target") >= F.col("a") + days * DAY_MS) & (F.col("target") <= F.col("b") + DAY_MS))
    return full.groupBy("instrument", F.col("target").alias("day_ms"), "bin").agg(F.sum("qty").cast("long").alias("qty"))


def developing_profile(trades: DataFrame, bin_size: int, every_ms: int) -> DataFrame:
    """The point of control of the day so far, at each closed interval of ``every_ms`` that has trades."""
    step = bucket(F.col("ts_ms"), every_ms).alias("step_ms")
    binned = ((F.col("price") - F.pmod("price", F.lit(bin_size))) / bin_size).cast("long").alias("bin")
    parts = trades.groupBy("instrument", bucket(F.col("ts_ms"), DAY_MS).alias("day_ms"), step, binned).agg(F.sum("qty").alias("qty"))
    upto = W.partitionBy("instrument", "day_ms", "bin").orderBy("step_ms").rowsBetween(W.unboundedPreceding, 0)
    runs = parts.withColumn("cum", F.sum("qty").over(upto))
    # a bin keeps its sum until its next change, so the running best per day needs only the changes
    best = W.partitionBy("instrument", "day_ms").orderBy("step_ms").rangeBetween(W.unboundedPreceding, 0)
    runs = runs.withColumn("best", F.max(F.struct("cum", (-F.col("bin")).alias("low"))).over(best))
    out = runs.groupBy("instrument", "day_ms", "step_ms").agg(F.first("best").alias("best"))
    return out.select("instrument", "day_ms", "step_ms", (-F.col("best.low")).alias("poc"), F.col("best.cum").alias("poc_qty"))


def levels(areas: DataFrame, bin_size: int) -> DataFrame:
    """P10: (kind, price, low, high) rows: point of control, value area high and low; price is the bin's middle."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("bin")) for k in ("poc", "vah", "val")]))
    out = areas.select("instrument", "day_ms", each.alias("l"))
    low = F.col("l.bin") * bin_size
    return out.select("instrument", "day_ms", "l.kind", (low + bin_size // 2).alias("price"), low.alias("low"), (low + bin_size).alias("high"))


def session_vwap(trades: DataFrame, every_ms: int = MINUTE_MS) -> DataFrame:
    """floor(sum(price * qty) / sum(qty)) of the day so far, per closed interval with trades."""
    part = trades.groupBy("instrument", bucket(F.col("ts_ms"), DAY_MS).alias("day_ms"), bucket(F.col("ts_ms"), every_ms).alias("step_ms")).agg(
        F.sum(F.col("price").cast("decimal(20,0)") * F.col("qty")).cast("decimal(38,0)").alias("notional"), F.sum("qty").alias("qty")
    )
    w = W.partitionBy("instrument", "day_ms").orderBy("step_ms").rowsBetween(W.unboundedPreceding, 0)
    n, q = F.sum("notional").over(w), F.sum("qty").over(w)
    return part.withColumns({"n": n.cast("decimal(38,0)"), "q": q}).select("instrument", "day_ms", "step_ms", F.expr("CAST(n div q AS BIGINT)").alias("vwap"))
