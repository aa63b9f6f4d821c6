"""Resampling of days and weeks: circular block bootstrap, intervals, and the rotation null. Draws follow from seed and number alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DAY_MS = 86_400_000
WEEK_MS = 7 * DAY_MS
#: 1970-01-05 was a Monday.
MONDAY_MS = 4 * DAY_MS
BLOCKS, DRAWS, ROTATION_WEEKS, ROTATION_DRAWS = (28, 56), 10_000, (4, 8), 1_000_000
#: Blocks whose rotations one digest gives, four hexadecimal digits each.
PER_DIGEST = 16


def digest(seed: int, *parts: Column) -> Column:
    """A counter-based generator: 64 hexadecimal digits of seed and counters, the same in any partition and engine."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]), 256)


def whole(hexadecimal: Column) -> Column:
    return F.conv(hexadecimal, 16, 10).cast("long")


def circular_sums(days: DataFrame, count: int) -> DataFrame:
    """(j, s, n) for j from 0 to 2 * count: sums of the days before day j of the circle; days: day_no (0 to count - 1), s, n.

    One row a day twice over, so the one window here holds as many rows as the calendar.
    """
    twice = days.select("day_no", "s", "n").unionByName(days.select((F.col("day_no") + count).alias("day_no"), "s", "n"))
    w = W.orderBy("day_no").rowsBetween(W.unboundedPreceding, 0)
    upto = twice.select((F.col("day_no") + 1).cast("long").alias("j"), F.sum("s").over(w).alias("s"), F.sum("n").over(w).alias("n"))
    zero = F.lit(0)
    first = days.sparkSession.range(1).select(F.col("id").alias("j"), zero.cast(upto.schema["s"].dataType).alias("s"), zero.cast(upto.schema["n"].dataType).alias("n"))
    return upto.unionByName(first)


def block_bootstrap(days: DataFrame, block: int, draws: int = DRAWS, seed: int = 1) -> DataFrame:
    """(block, draw, mean) of resamples of whole days in circular blocks; the mean is null where no row was drawn.

    days: day_no (0 to n - 1), s, n. A resample has as many days as there are, its last block is shorter. Each block is looked up as a difference of two
    circular sums, so the work is draws x blocks, whatever the block's length and the number of rows behind a day.
    """
    count = days.count()
    if not count:
        return days.sparkSession.createDataFrame([], "block int, draw long, mean double")
    per, sums = -(-count // block), circular_sums(days, count)
    d = days.sparkSession.range(draws).select(F.col("id").alias("draw"), F.explode(F.sequence(F.lit(0), F.lit(per - 1))).alias("k"))
    start = whole(F.substring(digest(seed, F.lit(block), F.col("draw"), F.col("k")), 1, 12)) % count
    d = d.select("draw", start.alias("a"), (start + F.least(F.lit(block), F.lit(count) - F.col("k") * block)).alias("b"))
    d = d.join(sums.select(F.col("j").alias("a"), F.col("s").alias("s0"), F.col("n").alias("n0")), "a").join(sums.select(F.col("j").alias("b"), F.col("s").alias("s1"), F.col("n").alias("n1")), "b")
    out = d.groupBy("draw").agg(F.sum(F.col("s1") - F.col("s0")).alias("s"), F.sum(F.col("n1") - F.col("n0")).alias("n"))
    return out.select(F.lit(block).alias("block"), "draw", (F.col("s").cast("double") / F.nullif(F.col("n"), F.lit(0))).alias("mean"))


def interval(draws: DataFrame, units: int, n_min: int, confidence: float = 0.95) -> DataFrame:
    """Nearest-rank bounds of each block length's means, and how they read; insufficient with fewer units than ``n_min``, or if
    more means than one tail holds are undefined. A group has one value per draw."""
    tail = (1 - confidence) / 2
    q = [F.expr(f"percentile_disc({p:.6f}) WITHIN GROUP (ORDER BY mean)").alias(n) for n, p in (("lo", tail), ("hi", 1 - tail))]
    out = draws.groupBy("block").agg(*q, F.count_if(F.col("mean").isNull()).alias("undefined"), F.count("*").alias("draws"))
    enough = (F.lit(units) >= n_min) & (F.col("undefined") <= F.round(F.col("draws") * tail, 6)) & F.col("lo").isNotNull()
    read = F.when(~enough, "insufficient").when(F.col("lo") > 0, "hypothesis").when(F.col("hi") < 0, "counter").otherwise("inconclusive")
    return out.withColumn("reading", read)


def weeks_of(rows: DataFrame, time: str, first_ms: int, last_week: int, weeks: int) -> DataFrame:
    """Adds block, the week in it, and the length of the block; the last block may be shorter than ``weeks``."""
    week = F.floor((F.col(time) - first_ms) / WEEK_MS)
    block = F.floor(week / weeks)
    return rows.withColumns({"block": block, "week": week - block * weeks, "length": F.least(F.lit(weeks), F.lit(last_week + 1) - block * weeks)})


def rotation_table(members: DataFrame, races: DataFrame, weeks: int) -> DataFrame:
    """(weeks, block, rotation, length, score, n): the members of a block of weeks against the races at the same time of a later week of it.

    members: instrument, bar_end_ms, sign. races: instrument, bar_end_ms, value. Weeks begin on Monday 00:00 UTC; rotation 0 is what was observed. A member is
    copied once per week of its block, never per draw.
    """
    ends = races.agg(F.min("bar_end_ms"), F.max("bar_end_ms")).first()
    first = (ends[0] or 0) - ((ends[0] or 0) - MONDAY_MS) % WEEK_MS
    m = members.where((F.col("bar_end_ms") >= first) & (F.col("bar_end_ms") <= F.lit(ends[1])))
    m = weeks_of(m, "bar_end_ms", first, ((ends[1] or 0) - first) // WEEK_MS, weeks)
    m = m.withColumn("rotation", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1)))
    to = F.pmod(F.col("week") + F.col("rotation"), F.col("length")) - F.col("week")
    m = m.withColumn("bar_end_ms", F.col("bar_end_ms") + to * WEEK_MS)
    found = m.join(races, ["instrument", "bar_end_ms"]).groupBy("block", "rotation", "length")
    found = found.agg(F.sum(F.col("sign") * F.col("value")).cast("long").alias("score"), F.count("*").alias("n"))
    return found.select(F.lit(weeks).alias("weeks"), "block", "rotation", "length", "score", "n")


def rotation_p(table: DataFrame, draws: int = ROTATION_DRAWS, seed: int = 1) -> DataFrame:
    """(weeks, observed, above, below, draws, p): two-sided p of the mean score among draws of one rotation per block.

    p = min(1, 2 * min((1 + above) / (draws + 1), (1 + below) / (draws + 1))); a draw without members counts on both sides. A draw adds
    up one entry per block of ``table``, which has as many rows as the calendar has weeks.
    """
    spark = table.sparkSession
    blocks = table.select("weeks", "block", "length").distinct()
    d = blocks.join(spark.range(draws).withColumnRenamed("id", "draw"))  # the stated draws for each block of the calendar
    part = digest(seed, F.col("weeks"), F.col("draw"), F.floor(F.col("block") / PER_DIGEST))
    four = F.substring(part, (1 + 4 * F.pmod("block", F.lit(PER_DIGEST))).cast("int"), F.lit(4))
    d = d.withColumn("rotation", F.pmod(whole(four), F.col("length")))
    keys = ["weeks", "block", "rotation"]
    sums = d.join(table.select(*keys, "score", "n"), keys, "left").groupBy("weeks", "draw").agg(F.coalesce(F.sum("score"), F.lit(0)).alias("score"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    seen = table.where("rotation = 0").groupBy("weeks").agg((F.sum("score") / F.sum("n")).alias("observed"))
    mean = F.col("score") / F.nullif(F.col("n"), F.lit(0))
    out = sums.join(seen, "weeks").groupBy("weeks", "observed").agg(
        F.count_if(F.coalesce(mean >= F.col("observed"), F.lit(True))).alias("above"), F.count_if(F.coalesce(mean <= F.col("observed"), F.lit(True))).alias("below"), F.count("*").alias("draws")
    )
    return out.withColumn("p", F.least(F.lit(1.0), 2 * (1 + F.least("above", "below")) / (F.col("draws") + 1)))
