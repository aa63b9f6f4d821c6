"""Decision samples and forward labels: barriers, first touch, excursions, censoring."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeloom.functions.shipping import ship
from tapeloom.functions.tables import written
from tapeloom.functions.timing import asof, bucket

#: Barrier half-width as parts of 100 000 of the average true range.
HALF_WIDTH = 31_333


def baseline_samples(closed: DataFrame, trades: DataFrame, width_ms: int) -> DataFrame:
    """Q1: one sample per trade that closes bars (several bars closed by one trade are one sample), named by that trade."""
    c = closed.where("known_at IS NOT NULL").groupBy("instrument", F.col("known_at").alias("ts_ms")).agg((F.max("bar_ms") + width_ms).alias("bar_end_ms"))
    first = trades.groupBy("instrument", "ts_ms").agg(F.min("trade_id").alias("event_seq"))
    return c.join(first, ["instrument", "ts_ms"]).select("instrument", F.col("ts_ms").alias("decision_ms"), "event_seq", "bar_end_ms")


def numbered(samples: DataFrame, order: list[str], day: str = "decision_ms") -> DataFrame:
    """Q2: record numbers in ``order`` over the whole table, by numbers within days and the sums of the days before."""
    d = samples.withColumn("__d", bucket(F.col(day), 86_400_000))
    per = d.groupBy("__d").agg(F.count("*").alias("n"))
    before = per.select("__d", (F.sum("n").over(W.orderBy("__d").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("__n"))
    inner = F.row_number().over(W.partitionBy("__d").orderBy(*order))
    return d.withColumn("__r", inner).join(before, "__d").withColumn("record", F.col("__n") + F.col("__r") - 1).drop("__d", "__n", "__r")


def with_reference(samples: DataFrame, trades: DataFrame, atrs: DataFrame, width_ms: int) -> DataFrame:
    """Q3, Q7: price of the last trade at or before the decision, and the last average true range of a bar closed by then."""
    t = trades.select("instrument", "ts_ms", "trade_id", "price")
    s = asof(samples, t, ["instrument"], "decision_ms", "ts_ms", {"price": "reference", "ts_ms": "reference_ms"}, tie="trade_id")
    a = atrs.where("atr IS NOT NULL").withColumn("end_ms", F.col("bar_ms") + width_ms)
    return asof(s, a, ["instrument"], "decision_ms", "end_ms", {"atr": "atr"})


def barriers(samples: DataFrame, horizons: dict[str, int], width: int = HALF_WIDTH) -> DataFrame:
    """Q8: a row per sample and horizon with symmetric barriers reference +/- width * atr / 100 000, half to even."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("horizon"), F.lit(ms).cast("long").alias("horizon_ms")) for n, ms in horizons.items()]))
    num = F.col("atr") * width
    rest = F.pmod(num, F.lit(100_000))
    q = ((num - rest) / 100_000).cast("long")
    offset = q + F.when((rest > 50_000) | ((rest == 50_000) & (q % 2 == 1)), 1).otherwise(0)
    s = samples.withColumn("h", each).select(*samples.columns, "h.horizon", "h.horizon_ms", offset.alias("offset"))
    return s.select(
        *s.columns[:-1], (F.col("decision_ms") + F.col("horizon_ms")).alias("end_ms"),
        (F.col("reference") + F.col("offset")).alias("upper"), (F.col("reference") - F.col("offset")).alias("lower"),
    )


KEY = ["instrument", "event_seq", "horizon"]


#: Bars of first_touch()'s width are parted into so many finer ones.
FINER = 60


def touching(labels: DataFrame, bars: DataFrame, width_ms: int) -> DataFrame:
    """Per label the extremes of the bars (instrument, bar_ms, high, low) wholly inside its window, and the earliest of them that touches each barrier.

    labels and bars meet by step_ms, a bucket of time that holds the bars; a is the bar of the decision.
    """
    met = labels.join(bars, ["instrument", "step_ms"])
    inner = (F.col("bar_ms") > F.col("a")) & (F.col("bar_ms") + width_ms <= F.col("end_ms"))
    return met.where(inner).groupBy(*KEY).agg(
        F.max("high").alias("in_high"), F.min("low").alias("in_low"),
        F.min(F.when(F.col("high") >= F.col("upper"), F.col("bar_ms"))).alias("up_bar"), F.min(F.when(F.col("low") <= F.col("lower"), F.col("bar_ms"))).alias("down_bar"),
    )


def edges_and_touches(labels: DataFrame, per: DataFrame, width_ms: int) -> DataFrame:
    """Labels with each step_ms that must be read more closely: the bars at both edges of the window, and those that touch."""
    look = labels.join(per.select(*KEY, "up_bar", "down_bar"), KEY, "left")
    each = F.array(bucket(F.col("decision_ms"), width_ms), bucket(F.col("end_ms") - 1, width_ms), "up_bar", "down_bar")
    return look.withColumn("step_ms", F.explode(F.array_distinct(F.array_compact(each)))).drop("up_bar", "down_bar")


def trades_met(labels: DataFrame, bars: DataFrame, trades: DataFrame, width_ms: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Extremes inside of bars, then of finer bars, and the trades that labels meet: of four finer bars at most, whatever the horizon."""
    lab = labels.select(*KEY, "decision_ms", "end_ms", "upper", "lower").where("upper IS NOT NULL")
    finer_ms = width_ms // FINER if width_ms % FINER == 0 else width_ms
    begin = lambda c, w: bucket(F.col(c), w)
    steps = lab.withColumns({"a": begin("decision_ms", width_ms), "z": bucket(F.col("end_ms") - 1, width_ms)}).withColumn("step_ms", F.explode(F.sequence("a", "z", F.lit(width_ms))))
    coarse = written(touching(steps, bars.where("close IS NOT NULL").select("instrument", F.col("bar_ms").alias("step_ms"), "bar_ms", "high", "low"), width_ms), "coarse")
    finer = trades.groupBy("instrument", begin("ts_ms", finer_ms).alias("bar_ms")).agg(F.max("price").alias("high"), F.min("price").alias("low"))
    close = edges_and_touches(lab, coarse, width_ms).withColumn("a", begin("decision_ms", finer_ms))
    fine = written(touching(close, finer.withColumn("step_ms", begin("bar_ms", width_ms)), finer_ms), "fine")
    t = trades.select("instrument", begin("ts_ms", finer_ms).alias("step_ms"), "ts_ms", "trade_id", "price")
    met = edges_and_touches(lab, fine, finer_ms).join(t, ["instrument", "step_ms"])
    return coarse, fine, met.where("(ts_ms > decision_ms OR (ts_ms = decision_ms AND trade_id > event_seq)) AND ts_ms < end_ms")


def first_touch(labels: DataFrame, bars: DataFrame, trades: DataFrame, width_ms: int) -> DataFrame:
    """Q9, Q10: first touch of each barrier and the extremes after the decision and before end_ms.

    Bars inside the window tell extremes and the earliest bar that touches; of that bar and the two at the window's edges finer bars tell the same,
    and only of the finer bars that touch or lie at the edges trades are read.
    """
    coarse, fine, met = trades_met(labels, bars, trades, width_ms)
    at = F.struct("ts_ms", "trade_id")
    found = met.groupBy(*KEY).agg(
        F.min(F.when(F.col("price") >= F.col("upper"), at)).alias("up_at"), F.min(F.when(F.col("price") <= F.col("lower"), at)).alias("down_at"),
        F.max("price").alias("edge_high"), F.min("price").alias("edge_low"),
    )
    named = lambda per, n: per.select(*KEY, F.col("in_high").alias(f"{n}_high"), F.col("in_low").alias(f"{n}_low"))
    out = labels.join(named(coarse, "in"), KEY, "left").join(named(fine, "fine"), KEY, "left").join(found, KEY, "left")
    return out.select(
        *labels.columns, "up_at", "down_at", F.greatest("in_high", "fine_high", "edge_high").alias("max_price"), F.least("in_low", "fine_low", "edge_low").alias("min_price")
    )


def censors(labels: DataFrame, gaps: DataFrame, known: DataFrame, width_ms: int) -> DataFrame:
    """Q12, Q13: the first moment from which a label's window isn't known: a gap, or the end of the data.

    Gaps are joined by the time buckets that they touch. known: instrument, known_until.
    """
    lab = labels.select(*KEY, "decision_ms", "end_ms")
    first, last = bucket(F.col("decision_ms"), width_ms), bucket(F.col("end_ms") - 1, width_ms)
    steps = lab.withColumn("bar_ms", F.explode(F.sequence(first, last, F.lit(width_ms))))
    g0, g1 = bucket(F.col("start_ms"), width_ms), bucket(F.col("end_g"), width_ms)
    g = gaps.withColumnRenamed("end_ms", "end_g").withColumn("bar_ms", F.explode(F.sequence(g0, g1, F.lit(width_ms))))
    hit = steps.join(g, ["instrument", "bar_ms"]).where("start_ms < end_ms AND end_g >= decision_ms")
    hit = hit.groupBy(*KEY).agg(F.min(F.greatest("start_ms", "decision_ms")).alias("gap_at"))
    out = labels.join(hit, KEY, "left").join(known, "instrument", "left")
    ended = F.when(F.col("end_ms") > F.col("known_until"), F.col("known_until"))
    at = F.least("gap_at", ended)
    reason = F.when(at.isNull(), F.lit(None)).when(F.col("gap_at") == at, "gap").otherwise("end_of_data")
    return out.select(*labels.columns, at.alias("censor_at"), reason.alias("censor_reason"))


def race(touched: DataFrame) -> DataFrame:
    """Q9, Q12: upper, lower, neither, censored or unavailable; a touch strictly before the censor time stands."""
    up, down = F.col("up_at"), F.col("down_at")
    won = F.when(down.isNull() | (up < down), F.struct(F.lit("upper").alias("r"), up["ts_ms"].alias("at"))).otherwise(F.struct(F.lit("lower").alias("r"), down["ts_ms"].alias("at")))
    won = F.when(up.isNotNull() | down.isNotNull(), F.when(up.isNull(), F.struct(F.lit("lower").alias("r"), down["ts_ms"].alias("at"))).otherwise(won))
    t = touched.withColumn("won", won)
    stands = t["won"].isNotNull() & (t["censor_at"].isNull() | (t["won.at"] < t["censor_at"]))
    result = F.when(t["upper"].isNull(), "unavailable").when(stands, t["won.r"]).when(t["censor_at"].isNotNull(), "censored").otherwise("neither")
    t = t.withColumn("race", result)
    return t.select(
        *[c for c in touched.columns if c not in ("up_at", "down_at")], "race",
        F.when(F.col("race").isin("upper", "lower"), F.col("won.at")).alias("race_at"),
        F.coalesce(F.col("up_at.ts_ms") == F.col("down_at.ts_ms"), F.lit(False)).alias("same_ms"),
        (F.col("max_price") - F.col("reference")).alias("up"), (F.col("reference") - F.col("min_price")).alias("down"),
    )


def first_passage(labels: DataFrame, bars: DataFrame, trades: DataFrame, width_ms: int, target: str) -> DataFrame:
    """Q11: at_decision, touched, censored or not_within for one target price; its side is fixed by the reference at the decision.

    labels have censor_at (see censors()): a touch strictly before it stands, otherwise the passage is censored.
    """
    above = F.col(target) > F.col("reference")
    far, deep = F.lit(1 << 62), F.lit(-(1 << 62))
    l2 = labels.withColumns({"upper": F.when(above, F.col(target)).otherwise(far), "lower": F.when(F.col(target) < F.col("reference"), F.col(target)).otherwise(deep)})
    t = first_touch(l2, bars, trades, width_ms)
    at = F.coalesce("up_at", "down_at")["ts_ms"]
    stands = at.isNotNull() & (F.col("censor_at").isNull() | (at < F.col("censor_at")))
    what = F.when(F.col(target).isNull() | F.col("reference").isNull(), F.lit(None)).when(F.col(target) == F.col("reference"), "at_decision")
    what = what.when(stands, "touched").when(F.col("censor_at").isNotNull(), "censored").otherwise("not_within")
    t = t.select(*KEY, F.lit(target).alias("target"), F.col(target).alias("price"), what.alias("passage"), at.alias("at"), "censor_at")
    return t.select(*KEY, "target", "price", "passage", F.when(F.col("passage") == "touched", F.col("at")).alias("passage_at"), F.when(F.col("passage") == "censored", F.col("censor_at")).alias("passage_censor_at"))


def thinned(samples: DataFrame, keys: list[str], time: str = "decision_ms", span: str = "horizon_ms") -> DataFrame:
    """Q6: clear: the first sample, and then each next one that begins at least one span after the last clear one.

    Greedy, so a fold per key over decision times only.
    """
    names = [*keys, "event_seq", time, span]

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([time, "event_seq"])
        free, flags = None, []
        for t, s in zip(pdf[time], pdf[span], strict=True):
            flags.append(free is None or t >= free)
            if flags[-1]:
                free = t + s
        return pdf.assign(clear=flags)

    ship(samples.sparkSession)
    schema = samples.select(*names).schema.simpleString()[7:-1] + ",clear:boolean"
    return samples.select(*names).groupBy(*keys).applyInPandas(fold, schema)


