"""Swings, level touches, sweeps and their outcomes."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeloom.functions.shipping import ship
from tapeloom.functions.timing import bucket

SIDE, BPS, CAP, RESOLVE = 3, 5, 20, 2
#: Width of the blocks of bars in which the first bar beyond a swing is looked for: 256 hours.
BLOCK_MS = 256 * 3_600_000


def swings(bars: DataFrame, side: int = SIDE) -> DataFrame:
    """Fractal highs and lows, strict on the left and not on the right; empty bars are passed over.

    A swing is known when the last bar to its right closes; known_bar_ms is that bar.
    """
    w = W.partitionBy("instrument").orderBy("bar_ms")
    left, right = w.rowsBetween(-side, -1), w.rowsBetween(1, side)
    full = (F.count("*").over(left) == side) & (F.count("*").over(right) == side)
    b = bars.where("close IS NOT NULL").select(
        "instrument", "bar_ms", "high", "low", F.lead("bar_ms", side).over(w).alias("known_bar_ms"), full.alias("full"),
        F.max("high").over(left).alias("lh"), F.max("high").over(right).alias("rh"), F.min("low").over(left).alias("ll"), F.min("low").over(right).alias("rl"),
    )
    up = b.where("full AND high > lh AND high >= rh").select("instrument", "bar_ms", F.lit("high").alias("side"), F.col("high").alias("price"), "known_bar_ms")
    down = b.where("full AND low < ll AND low <= rl").select("instrument", "bar_ms", F.lit("low").alias("side"), F.col("low").alias("price"), "known_bar_ms")
    return up.unionByName(down)


def last_swings(bars: DataFrame, found: DataFrame) -> DataFrame:
    """The last known swing price per side at each bar's close."""
    known = found.groupBy("instrument", F.col("known_bar_ms").alias("bar_ms")).agg(
        *[F.max_by(F.when(F.col("side") == s, F.col("price")), F.when(F.col("side") == s, F.col("bar_ms"))).alias(s) for s in ("high", "low")]
    )
    w = W.partitionBy("instrument").orderBy("bar_ms").rowsBetween(W.unboundedPreceding, 0)
    b = bars.select("instrument", "bar_ms").join(known, ["instrument", "bar_ms"], "left")
    return b.select("instrument", "bar_ms", F.last("high", True).over(w).alias("last_high"), F.last("low", True).over(w).alias("last_low"))


def extremes(bars: DataFrame) -> DataFrame:
    """(instrument, side, t, x): a row per bar and side, x is the high, or the low with its sign turned."""
    b = bars.where("close IS NOT NULL").select("instrument", "bar_ms", F.explode(F.create_map(F.lit("high"), "high", F.lit("low"), -F.col("low"))).alias("side", "x"))
    return b.select("instrument", "side", F.col("bar_ms").alias("t"), "x")


def sweeps(bars: DataFrame, found: DataFrame, widths: tuple[int, ...] = (BLOCK_MS,)) -> DataFrame:
    """The first bar after a swing is known that trades strictly beyond it (null while none does).

    ``widths`` are growing widths of blocks of bars, each a multiple of the one before. A swing looks among the later bars of its
    own block, then among the later blocks by their extremes, and in the first block that goes beyond it; so it meets
    the bars of two blocks and the blocks, not all bars.
    """
    key = ["instrument", "side"]
    levels = [extremes(bars)]
    for w in widths:
        levels.append(levels[-1].groupBy(*key, bucket(F.col("t"), w).alias("t")).agg(F.max("x").alias("x")))
    above = [lambda c, w=w: bucket(c, w) for w in widths] + [lambda c: F.lit(0).cast("long")]
    rows = found.select(*key, "bar_ms", F.when(F.col("side") == "high", F.col("price")).otherwise(-F.col("price")).alias("limit"), F.col("known_bar_ms").alias("pos"))
    rows = rows.withColumns({"at": F.lit(None).cast("long"), "level": F.lit(None).cast("int")})
    kept = [*key, "bar_ms", "limit", "pos", "at", "level"]
    for k, level in enumerate(levels):
        later = rows.withColumn("parent", above[k](F.col("pos"))).join(level.withColumn("parent", above[k](F.col("t"))), [*key, "parent"], "left")
        hit = later.groupBy(*kept).agg(F.min(F.when(F.col("at").isNull() & (F.col("t") > F.col("pos")) & (F.col("x") > F.col("limit")), F.col("t"))).alias("t"))
        level_no = F.coalesce("level", F.when(F.col("t").isNotNull(), F.lit(k)))
        rows = hit.select(*key, "bar_ms", "limit", above[k](F.col("pos")).alias("pos"), F.coalesce("at", "t").alias("at"), level_no.alias("level"))
    for k in range(len(widths) - 1, -1, -1):
        inner = rows.withColumn("parent", F.when(F.col("level") > k, F.col("at"))).join(levels[k].withColumn("parent", above[k](F.col("t"))), [*key, "parent"], "left")
        hit = inner.groupBy(*kept).agg(F.min(F.when(F.col("x") > F.col("limit"), F.col("t"))).alias("t"))
        rows = hit.withColumn("at", F.when(F.col("level") > k, F.col("t")).otherwise(F.col("at"))).drop("t")
    return found.join(rows.select(*key, "bar_ms", F.col("at").alias("swept_bar_ms")), [*key, "bar_ms"], "left")


def touches(bars: DataFrame, swept: DataFrame, bps: int = BPS) -> DataFrame:
    """S3: bars during a level's life whose extreme comes within ``bps`` of the price without going beyond it.

    Levels and bars meet in buckets of the price's logarithm, which are a little wider than ``bps``.
    """
    step = -math.log(1 - bps / 10_000) * 1.001
    place = lambda c: F.floor(F.log(F.greatest(c, F.lit(1))) / step)
    b = extremes(bars).withColumn("x", F.abs("x")).withColumn("place", place(F.col("x")))
    other = F.when(F.col("side") == "high", F.col("place") + 1).otherwise(F.col("place") - 1)
    b = b.withColumn("place", F.explode(F.array("place", other)))
    j = swept.withColumn("place", place(F.col("price"))).join(b, ["instrument", "side", "place"]).where("t > known_bar_ms AND (swept_bar_ms IS NULL OR t < swept_bar_ms)")
    near = F.when(F.col("side") == "high", F.col("price") - F.col("x")).otherwise(F.col("x") - F.col("price"))
    j = j.where((near >= 0) & (near * 10_000 <= F.col("price") * bps))
    n = j.groupBy("instrument", "side", "bar_ms").agg(F.count("*").alias("n_touches"))
    return swept.join(n, ["instrument", "side", "bar_ms"], "left").fillna(0, ["n_touches"])


def sweep_outcomes(bars: DataFrame, swept: DataFrame, within: int = RESOLVE) -> DataFrame:
    """A close back at or inside the level within ``within`` bars of the sweep is a swing failure, else a clean break."""
    w = W.partitionBy("instrument").orderBy("bar_ms")
    b = bars.where("close IS NOT NULL")
    closes = F.array(*[F.lead("close", k).over(w) for k in range(within + 1)])
    ext = w.rowsBetween(0, within)
    b = b.select("instrument", F.col("bar_ms").alias("swept_bar_ms"), closes.alias("closes"), F.max("high").over(ext).alias("hi"), F.min("low").over(ext).alias("lo"), F.lead("close", within).over(w).alias("end"))
    j = swept.join(b, ["instrument", "swept_bar_ms"])
    inside = F.exists("closes", lambda c: F.coalesce(F.when(F.col("side") == "high", c <= F.col("price")).otherwise(c >= F.col("price")), F.lit(False)))
    outcome = F.when(inside, "failure").when(F.col("end").isNotNull(), "break").otherwise("open")
    extreme = F.when(F.col("side") == "high", F.col("hi")).otherwise(F.col("lo"))
    return j.select("instrument", "side", "bar_ms", "price", "swept_bar_ms", outcome.alias("outcome"), extreme.alias("extreme"))


def capped_registry(swept: DataFrame, cap: int = CAP) -> DataFrame:
    """Levels per side with at most ``cap`` active ones: a new level evicts the one that has been known longest.

    Order dependent, so a fold over the swings of one instrument and side: (bar_ms, end_ms, end) with end in swept, evicted,
    active.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["known_bar_ms", "bar_ms"])
        active: list[list] = []
        rows = []
        for r in pdf.itertuples():
            keep = []
            for x in active:
                if x[1] is not None and x[1] <= r.known_bar_ms:
                    rows.append((x[0], x[1], "swept"))
                else:
                    keep.append(x)
            active = keep
            if len(active) >= cap:
                old = active.pop(0)
                rows.append((old[0], r.known_bar_ms, "evicted"))
            active.append([r.bar_ms, None if pd.isna(r.swept_bar_ms) else int(r.swept_bar_ms)])
        rows += [(b, s, "swept") if s is not None else (b, None, "active") for b, s in active]
        out = pd.DataFrame(rows, columns=["bar_ms", "end_ms", "end"])
        out["end_ms"] = out["end_ms"].astype("Int64")
        return out.assign(instrument=pdf["instrument"].iloc[0], side=pdf["side"].iloc[0])[["instrument", "side", "bar_ms", "end_ms", "end"]]

    ship(swept.sparkSession)
    return swept.groupBy("instrument", "side").applyInPandas(fold, "instrument long, side string, bar_ms long, end_ms long, end string")


def level_rows(swept: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Rows of level life: structural levels from known to swept, prior sweeps, and zones of failed sweeps."""
    known = swept.select("instrument", F.concat(F.lit("structural_"), "side").alias("kind"), F.col("price").alias("low"), F.col("price").alias("high"), F.col("known_bar_ms").alias("valid_from"), F.col("swept_bar_ms").alias("valid_to"))
    prior = outcomes.select("instrument", F.lit("prior_sweep").alias("kind"), F.col("extreme").alias("low"), F.col("extreme").alias("high"), F.col("swept_bar_ms").alias("valid_from"), F.lit(None).cast("long").alias("valid_to"))
    zone = outcomes.where("outcome = 'failure'").select("instrument", F.lit("sfp_zone").alias("kind"), F.least("price", "extreme").alias("low"), F.greatest("price", "extreme").alias("high"), F.col("swept_bar_ms").alias("valid_from"), F.lit(None).cast("long").alias("valid_to"))
    return known.unionByName(prior).unionByName(zone)
