"""Study relations over the outcome dataset: records, effort comparisons, population members, replication coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.timing import bucket

KEY = ["instrument", "event_seq"]
HOUR_MS = 3_600_000


def excluded(records: DataFrame, ranges: DataFrame, width_ms: int = HOUR_MS) -> DataFrame:
    """Records whose decision lies in no range [from_ms, to_ms) of their instrument; ranges meet records in time buckets."""
    r = ranges.select("instrument", "from_ms", "to_ms", F.explode(F.sequence(bucket(F.col("from_ms"), width_ms), bucket(F.col("to_ms") - 1, width_ms), F.lit(width_ms))).alias("step")).withColumnRenamed("instrument", "i")
    inside = (F.col("i") == F.col("instrument")) & (F.col("step") == bucket(F.col("decision_ms"), width_ms)) & (F.col("decision_ms") >= F.col("from_ms")) & (F.col("decision_ms") < F.col("to_ms"))
    return records.join(r, inside, "left_anti")


def races(outcomes: DataFrame, horizons: list[str]) -> DataFrame:
    """Y2: the race of every record per horizon, one column each."""
    p = outcomes.groupBy(*KEY).pivot("horizon", horizons).agg(F.max("race"))
    return p.select(*KEY, *[F.col(h).alias(f"race_{h}") for h in horizons])


def baseline(records: DataFrame, raced: DataFrame) -> DataFrame:
    """The baseline stream with its races."""
    return records.where("sample = 'baseline'").join(raced, KEY)


def comparisons(effort: DataFrame) -> DataFrame:
    """One row per record and effort window: ready, covered (ready without partial start or gap) and the comparisons."""
    ready = F.col("effort_high").isNotNull()
    return effort.select(
        *KEY, "effort_window", ready.alias("ready"), (ready & ~F.col("partial_start") & ~F.col("feed_gap")).alias("covered"), "aggressor",
        (F.col("effort") >= F.col("effort_high")).alias("high_effort"), (F.col("move") <= F.col("move_median")).alias("low_progress"), (F.col("move") >= F.col("move_high")).alias("high_progress"),
    )


def mapped(race: Column, hypothesis: Column) -> Column:
    """Hypothesis where its barrier came first, counter for the other one, else the race itself."""
    return F.when(race == hypothesis, "hypothesis").when(race.isin("upper", "lower"), "counter").otherwise(race)


def members(records: DataFrame, effort: DataFrame, raced: DataFrame, horizons: list[str]) -> DataFrame:
    """Members of the populations P1 to P4 and P1-trig, each with its side, hypothesis, CVD alignment and mapped races."""
    away = lambda c, first: F.when(F.col(c) == first, "lower").otherwise("upper")
    flow = records.where("sample = 'baseline'").join(effort.where("covered AND high_effort"), KEY)
    cols = lambda pair, side, hypothesis: [*KEY, "sample", "trigger", pair.alias("pair"), "effort_window", side.alias("side"), hypothesis.alias("hypothesis"), "regime", "location", "decision_ms", "cvd_day", "cvd_partial", "cvd_gap"]
    side = F.col("aggressor")
    p1 = flow.where("low_progress").select(*cols(F.concat(F.lit("P1-"), side), side, away("aggressor", "buy")))
    p2 = flow.where("high_progress").select(*cols(F.lit("P2"), side, F.when(side == "buy", "upper").otherwise("lower")))
    probe = F.when((F.col("auction_state") == "failed_breakout") == (F.col("auction_side") == "above"), "buy").otherwise("sell")
    failing = F.col("auction_state").isin("failed_breakout", "failed_reclaim") & F.col("auction_side").isin("above", "below")
    p3 = flow.where(failing & (side == probe)).select(*cols(F.lit("P3"), side, away("aggressor", "buy")))
    trig = records.where("sample = 'trigger'")
    p4 = trig.where("trigger IN ('failed_auction', 'sfp.1h') AND failed_side IS NOT NULL").withColumn("effort_window", F.lit(None).cast("string"))
    p4 = p4.select(*cols(F.lit("P4"), F.col("failed_side"), away("failed_side", "above")))
    p1t = trig.join(effort.where("covered"), KEY).where(F.col("trigger") == F.concat(F.lit("effort_result."), F.col("effort_window")))
    p1t = p1t.select(*cols(F.lit("P1-trig"), side, away("aggressor", "buy")))
    every = reduce(DataFrame.unionByName, [p1, p2, p3, p4, p1t]).join(raced, KEY)
    unknown = F.col("cvd_day").isNull() | F.col("cvd_partial") | F.col("cvd_gap")
    cvd = F.when(unknown, "unknown").when(F.col("cvd_day") == 0, "flat").when((F.col("cvd_day") > 0) == (F.col("side") == "buy"), "with").otherwise("against")
    return every.select(
        "pair", "effort_window", "trigger", *KEY, "decision_ms", "side", "hypothesis", "regime", "location", F.when(F.col("pair").isin("P1-buy", "P1-sell", "P2"), cvd).alias("cvd"),
        *[mapped(F.col(f"race_{h}"), F.col("hypothesis")).alias(f"out_{h}") for h in horizons],
    )


def exclusions(records: DataFrame, effort: DataFrame) -> DataFrame:
    """What each universe loses before any race is read: not ready, incomplete coverage, no failed side."""
    lost = [F.count("*").alias("records"), F.count_if(~F.col("ready")).alias("not_ready"), F.count_if(F.col("ready") & ~F.col("covered")).alias("incomplete"), F.lit(0).cast("long").alias("no_side")]
    j = records.join(effort, KEY)
    a = j.where("sample = 'baseline'").groupBy("effort_window").agg(*lost).withColumns({"universe": F.lit("baseline"), "trigger": F.lit(None).cast("string")})
    b = j.where((F.col("sample") == "trigger") & (F.col("trigger") == F.concat(F.lit("effort_result."), F.col("effort_window")))).groupBy("effort_window", "trigger").agg(*lost).withColumn("universe", F.lit("P1-trig"))
    zero = F.lit(0).cast("long")
    c = records.where("sample = 'trigger' AND trigger IN ('failed_auction', 'sfp.1h')").groupBy("trigger").agg(F.count("*").alias("records"), zero.alias("not_ready"), zero.alias("incomplete"), F.count_if(F.col("failed_side").isNull()).alias("no_side"))
    c = c.withColumns({"universe": F.lit("P4"), "effort_window": F.lit(None).cast("string")})
    return a.unionByName(b).unionByName(c)


def half_width(upper: str = "upper", reference: str = "reference") -> Column:
    """Half the distance of the barriers in basis points of the reference."""
    return (F.col(upper) - F.col(reference)).cast("double") * 10_000 / F.col(reference).cast("double")


def barrier_widths(records: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The median half-width per horizon over baseline records with barriers."""
    w = records.where("sample = 'baseline'").select(*KEY).join(outcomes.where("upper IS NOT NULL"), KEY).withColumn("w", half_width())
    return w.groupBy("horizon", "horizon_ms").agg(F.count("*").alias("barriers"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY w)").alias("median_half_width_bps"))


def extreme_counts(labeled: DataFrame, found: DataFrame) -> DataFrame:
    """Extreme against opposite barrier, counted over the sweep members, per horizon."""
    m = found.where("pair = 'P4' AND trigger LIKE 'sfp.%'").select(*KEY, "trigger")
    rows = labeled.select(*KEY, "horizon", F.coalesce("extreme_vs_opposite", F.lit("none")).alias("extreme_vs_opposite")).join(m, KEY)
    return rows.groupBy("trigger", "horizon", "extreme_vs_opposite").agg(F.count("*").alias("records"))


def coverage(outcomes: DataFrame, horizons: list[str]) -> DataFrame:
    """Per record whether each race ran, and the half-widths."""
    o = outcomes.withColumns({"ran": F.col("race").isin("upper", "lower", "neither"), "half": half_width()})
    at = lambda c, h: F.when(F.col("horizon") == h, F.col(c))
    return o.groupBy(*KEY).agg(*[F.max(at("ran", h)).alias(f"ran_{h}") for h in horizons], *[F.max(at("half", h)).alias(f"half_bps_{h}") for h in horizons])


def marks(outcomes: DataFrame, last: DataFrame, horizons: list[str]) -> DataFrame:
    """The window's last trade in half-widths toward the upper barrier. last: key, horizon, last."""
    o = outcomes.join(last, [*KEY, "horizon"], "left")
    m = (F.col("last") - F.col("reference")).cast("double") / F.nullif((F.col("upper") - F.col("reference")).cast("double"), F.lit(0.0))
    return o.groupBy(*KEY).agg(*[F.max(F.when(F.col("horizon") == h, m)).alias(f"mark_{h}") for h in horizons])
