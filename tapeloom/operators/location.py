"""Levels around the price: zones, visits, nearest levels, confluence; divergences, effort and triggers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeloom.functions.timing import asof, bucket

DAY_MS = 86_400_000


def registry(*parts: DataFrame) -> DataFrame:
    """L1: levels (instrument, kind, low, high, valid_from, valid_to) of several sources in one table."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def active(bars: DataFrame, levels: DataFrame) -> DataFrame:
    """Levels that are valid at a bar's open, joined by day buckets of their life."""
    days = F.sequence(bucket(F.col("valid_from"), DAY_MS), bucket(F.coalesce("valid_to", F.col("last_ms")), DAY_MS), F.lit(DAY_MS))
    last = bars.groupBy("instrument").agg(F.max("bar_ms").alias("last_ms"))
    lv = levels.join(last, "instrument").where("valid_from <= last_ms AND (valid_to IS NULL OR valid_to > valid_from)").withColumn("day_ms", F.explode(days))
    b = bars.where("close IS NOT NULL").withColumn("day_ms", bucket(F.col("bar_ms"), DAY_MS)).select("instrument", "day_ms", "bar_ms", F.col("high").alias("bar_high"), F.col("low").alias("bar_low"), "close")
    return b.join(lv, ["instrument", "day_ms"]).where("bar_ms >= valid_from AND (valid_to IS NULL OR bar_ms < valid_to)").drop("day_ms", "last_ms")


def in_zone(bars: DataFrame, levels: DataFrame, pad_bps: int) -> DataFrame:
    """L2: whether the bar's range meets the level's zone, padded by ``pad_bps`` of the level's lower price."""
    pad = F.col("low") * pad_bps
    meets = ((F.col("low") - F.col("bar_high")) * 10_000 <= pad) & ((F.col("bar_low") - F.col("high")) * 10_000 <= pad)
    return active(bars, levels).withColumn("in_zone", meets)


def visits(zones: DataFrame) -> DataFrame:
    """L3: bars at which a level is entered or left, and the number of entries so far."""
    w = W.partitionBy("instrument", "kind", "valid_from", "low", "high").orderBy("bar_ms")
    z = zones.withColumn("was", F.coalesce(F.lag("in_zone").over(w), F.lit(False))).where("was != in_zone")
    touches = F.sum(F.col("in_zone").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0))
    return z.select("instrument", "kind", "low", "high", "valid_from", "bar_ms", F.when(F.col("in_zone"), "enter").otherwise("leave").alias("event"), touches.cast("long").alias("touches"))


def nearest(bars: DataFrame, levels: DataFrame, n: int) -> DataFrame:
    """L4: the n levels nearest to the close: signed distance, 0 inside, and its rank."""
    away = F.when(F.col("close") < F.col("low"), F.col("low") - F.col("close")).when(F.col("close") > F.col("high"), F.col("high") - F.col("close")).otherwise(0)
    a = active(bars, levels).withColumn("distance", away)
    w = W.partitionBy("instrument", "bar_ms").orderBy(F.abs("distance"), "kind", "valid_from", "low", "high")
    return a.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("instrument", "bar_ms", "rank", "kind", "distance")


def confluence(levels: DataFrame, width: int) -> DataFrame:
    """For each level, levels of other kinds whose lower price is within ``width``, valid at its start.

    Prices are bucketed by width, and each level looks into its own bucket and the two beside it.
    """
    one = levels.withColumn("b", F.explode(F.array(*[F.floor(F.col("low") / width) + k for k in (-1, 0, 1)])))
    two = levels.select("instrument", F.floor(F.col("low") / width).alias("b"), F.col("kind").alias("k2"), F.col("low").alias("l2"), F.col("valid_from").alias("f2"), F.col("valid_to").alias("t2"))
    hit = one.join(two, ["instrument", "b"]).where((F.col("kind") != F.col("k2")) & (F.abs(F.col("low") - F.col("l2")) <= width) & (F.col("f2") <= F.col("valid_from")) & (F.col("t2").isNull() | (F.col("t2") > F.col("valid_from"))))
    key = ["instrument", "kind", "low", "high", "valid_from"]
    n = hit.groupBy(*key).agg(F.count_distinct("k2").alias("confluence"))
    return levels.select(*key).distinct().join(n, key, "left").fillna(0, ["confluence"])


def anchors(swings: DataFrame, trades: DataFrame, cvd: DataFrame, width_ms: int) -> DataFrame:
    """The first trade at a swing's price within its bar, with the running signed quantity there."""
    t = trades.withColumn("bar_ms", bucket(F.col("ts_ms"), width_ms)).join(cvd.select("instrument", "trade_id", "cvd"), ["instrument", "trade_id"])
    j = swings.join(t.withColumnRenamed("price", "p"), ["instrument", "bar_ms"]).where("p = price")
    first = F.min_by(F.struct("ts_ms", "trade_id", "cvd"), F.struct("ts_ms", "trade_id")).alias("a")
    return j.groupBy("instrument", "side", "bar_ms", "price", "known_bar_ms").agg(first).select("instrument", "side", "bar_ms", "price", "known_bar_ms", "a.ts_ms", "a.trade_id", "a.cvd")


def divergences(anchored: DataFrame, value: str = "cvd") -> DataFrame:
    """Consecutive swings of one side with a further extreme and the opposite change of ``value``."""
    w = W.partitionBy("instrument", "side").orderBy("bar_ms")
    a = anchored.withColumns({"p_price": F.lag("price").over(w), "p_value": F.lag(value).over(w), "p_bar_ms": F.lag("bar_ms").over(w)})
    bear = (F.col("side") == "high") & (F.col("price") > F.col("p_price")) & (F.col(value) < F.col("p_value"))
    bull = (F.col("side") == "low") & (F.col("price") < F.col("p_price")) & (F.col(value) > F.col("p_value"))
    return a.where(bear | bull).select("instrument", "side", "bar_ms", "p_bar_ms", "known_bar_ms", "price", F.when(bear, "bearish").otherwise("bullish").alias("divergence"))


def open_interest_divergences(anchored: DataFrame, samples: DataFrame) -> DataFrame:
    """Consecutive swings of one side with a further extreme and less open interest, each read from the last of ``samples``
    (instrument, ts_ms, open_interest) at or before the anchor; a swing without a sample pairs with none."""
    a = asof(anchored, samples, ["instrument"], "ts_ms", "ts_ms", {"open_interest": "oi"})
    w = W.partitionBy("instrument", "side").orderBy("bar_ms")
    a = a.withColumns({"p_price": F.lag("price").over(w), "p_oi": F.lag("oi").over(w), "p_bar_ms": F.lag("bar_ms").over(w)})
    further = F.when(F.col("side") == "high", F.col("price") > F.col("p_price")).otherwise(F.col("price") < F.col("p_price"))
    return a.where(further & (F.col("oi") < F.col("p_oi"))).select("instrument", "side", "bar_ms", "p_bar_ms", "known_bar_ms", "price", (F.col("oi") - F.col("p_oi")).alias("oi_change"))


def context(anchored: DataFrame, levels: DataFrame, pad_bps: int) -> DataFrame:
    """Per anchor the levels, as they stood at its confirmation, whose zone padded by ``pad_bps`` holds its price; without the
    structural level that its own swing became. Anchors without levels have an empty list. Anchors and levels meet in days."""
    key = ["instrument", "side", "bar_ms"]
    at = anchored.select(*key, "price", F.col("known_bar_ms").alias("at_ms"))
    points = at.select("instrument", F.col("at_ms").alias("bar_ms"), F.lit(0).alias("close"), F.lit(0).alias("high"), F.lit(0).alias("low")).distinct()
    lv = active(points, levels).select("instrument", F.col("bar_ms").alias("at_ms"), "kind", "low", "high", "valid_from")
    own = (F.col("kind") == F.concat(F.lit("structural_"), F.col("side"))) & (F.col("low") == F.col("price")) & (F.col("valid_from") == F.col("at_ms"))
    pad = F.col("low") * pad_bps
    holds = ((F.col("low") - F.col("price")) * 10_000 <= pad) & ((F.col("price") - F.col("high")) * 10_000 <= pad)
    hit = at.join(lv, ["instrument", "at_ms"]).where(holds & ~own)
    hit = hit.groupBy(*key).agg(F.count("*").alias("n_levels"), F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "kind", "low", "valid_from"))), ",").alias("levels"))
    return at.join(hit, key, "left").select(*key, "price", F.coalesce("n_levels", F.lit(0)).alias("n_levels"), F.coalesce("levels", F.lit("")).alias("levels"))


def zone_alerts(visits: DataFrame, kinds: list[str], since_ms: int) -> DataFrame:
    """G1: visits to levels of ``kinds`` that begin at or after ``since_ms``; a leave is told only if the entry of its visit was."""
    v = visits.where(F.col("kind").isin(kinds))
    entry = F.min(F.when(F.col("event") == "enter", F.col("bar_ms"))).over(W.partitionBy("instrument", "kind", "low", "high", "valid_from", "touches"))
    return v.withColumn("entered_ms", entry).where(F.col("entered_ms") >= since_ms)


def effort(windows: DataFrame, past: int, high_q: float = 0.8, low_q: float = 0.5, high_move: bool = False) -> DataFrame:
    """C4: effort (volume) and result (displacement) against nearest-rank quantiles of the previous ``past`` evaluations."""
    w = W.partitionBy("instrument").orderBy("bar_ms")
    before = w.rowsBetween(-past, -1)
    e = windows.where("displacement IS NOT NULL").withColumn("move", F.abs("displacement"))
    e = e.withColumns({"efforts": F.sort_array(F.collect_list("w_volume").over(before)), "moves": F.sort_array(F.collect_list("move").over(before))})
    rank = lambda c, q: F.try_element_at(c, F.greatest(F.lit(1), F.ceil(F.lit(q) * F.size(c))).cast("int"))
    full = F.size("efforts") == past
    on = (F.col("w_volume") >= rank(F.col("efforts"), high_q)) & (F.col("move") <= rank(F.col("moves"), low_q))
    return e.select("instrument", "bar_ms", F.col("w_volume").alias("effort"), "move", F.when(full, rank(F.col("efforts"), high_q)).alias("effort_high"), F.when(full, rank(F.col("moves"), low_q)).alias("move_median"), F.when(full, on).alias("active"), *([F.when(full, rank(F.col("moves"), high_q)).alias("move_high")] if high_move else []))


def rising_edges(evaluated: DataFrame) -> DataFrame:
    """Evaluations that turn active; missing evaluations neither fire nor re-arm."""
    w = W.partitionBy("instrument").orderBy("bar_ms")
    e = evaluated.where("active IS NOT NULL").withColumn("was", F.coalesce(F.lag("active").over(w), F.lit(False)))
    return e.where("active AND NOT was").select("instrument", "bar_ms")


def exhaustion(evaluated: DataFrame, windows: DataFrame, bars: DataFrame, back_ms: int, span: int, bps: int) -> DataFrame:
    """A judged expansion ``back_ms`` earlier, weaker aggression now, and a close near the extreme of ``span`` bars."""
    w = W.partitionBy("instrument").orderBy("bar_ms").rowsBetween(-(span - 1), 0)
    b = bars.withColumns({"hi": F.max("high").over(w), "lo": F.min("low").over(w)}).where("close IS NOT NULL").select("instrument", "bar_ms", "close", "hi", "lo")
    earlier = evaluated.where("effort >= effort_high AND move > move_median").select("instrument", (F.col("bar_ms") + back_ms).alias("bar_ms"), F.col("effort").alias("before"))
    j = b.join(earlier, ["instrument", "bar_ms"]).join(windows.select("instrument", "bar_ms", "w_volume"), ["instrument", "bar_ms"])
    near = lambda c: F.abs(F.col("close") - F.col(c)) * 10_000 <= F.col(c) * bps
    return j.where((F.col("w_volume") < F.col("before")) & (near("hi") | near("lo"))).select("instrument", "bar_ms", F.when(near("hi"), "high").otherwise("low").alias("side"))


def gated(events: DataFrame, zones: DataFrame, kinds: list[str]) -> DataFrame:
    """Events at bars that lie in a zone of an admitted kind."""
    return events.join(zones.where(F.col("in_zone") & F.col("kind").isin(kinds)), ["instrument", "bar_ms"], "left_semi")


def bias(swings: DataFrame) -> DataFrame:
    """Higher, equal or lower than the swing before, per side."""
    w = W.partitionBy("instrument", "side").orderBy("bar_ms")
    s = swings.withColumn("p", F.lag("price").over(w)).where("p IS NOT NULL")
    step = F.when(F.col("price") > F.col("p"), "higher").when(F.col("price") < F.col("p"), "lower").otherwise("equal")
    return s.select("instrument", "side", "bar_ms", "known_bar_ms", step.alias("step"))


def trigger_table(parts: dict[str, tuple[str, DataFrame]]) -> DataFrame:
    """One table of (instrument, bar_ms, trigger, family) from the parts named by trigger id."""
    rows = [df.select("instrument", "bar_ms", F.lit(t).alias("trigger"), F.lit(f).alias("family")).distinct() for t, (f, df) in parts.items()]
    return registry(*rows)


def acceptance(bars: DataFrame, areas: DataFrame, closes: int) -> DataFrame:
    """Region of each close against the prior day's range, and runs of closes outside that reach acceptance.

    areas: instrument, day_ms, lo, hi. Runs end with the day, so days are independent.
    """
    b = bars.where("close IS NOT NULL").withColumn("day_ms", bucket(F.col("bar_ms"), DAY_MS)).join(areas, ["instrument", "day_ms"])
    region = F.when(F.col("close") > F.col("hi"), "above").when(F.col("close") < F.col("lo"), "below").otherwise("inside")
    w = W.partitionBy("instrument", "day_ms").orderBy("bar_ms")
    b = b.withColumn("region", region).withColumn("new", F.coalesce((F.col("region") != F.lag("region").over(w)).cast("int"), F.lit(1)))
    b = b.withColumn("run", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    n = F.row_number().over(W.partitionBy("instrument", "day_ms", "run").orderBy("bar_ms"))
    state = F.when(F.col("region") == "inside", "balance").when(F.col("n") >= closes, "accepted").otherwise("probe")
    return b.withColumn("n", n).select("instrument", "day_ms", "bar_ms", "region", state.alias("state"))


def transitions(states: DataFrame) -> DataFrame:
    """Changes of the auction state; probe to balance is a failed auction, probe to accepted a breakout."""
    w = W.partitionBy("instrument", "day_ms").orderBy("bar_ms")
    s = states.withColumn("was", F.lag("state").over(w)).where("was != state")
    fact = F.when((F.col("was") == "probe") & (F.col("state") == "balance"), "failed_auction").when(F.col("state") == "accepted", "breakout_acceptance").when((F.col("was") == "accepted") & (F.col("state") == "balance"), "failed_reclaim").otherwise("probe")
    return s.select("instrument", "bar_ms", "was", "state", fact.alias("fact"))
