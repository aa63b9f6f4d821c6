"""Event order, deduplication, gaps, and comparisons of event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeloom.functions.timing import ID_WIDTH, asof, bucket, lagged, max_before, prefix_sum

DAY_MS = 86_400_000
#: Ranks of the event kinds within one millisecond.
KINDS = ("trade", "book_update", "book_snapshot", "liquidation", "mark_price", "funding", "open_interest", "kline", "gap")


def canonical(streams: dict[str, DataFrame]) -> DataFrame:
    """EV1: one table of (instrument, ts_ms, kind, kind_rank, seq, order_no); order_no numbers each instrument's day."""
    parts = [df.select("instrument", "ts_ms", "seq").withColumns({"kind": F.lit(k), "kind_rank": F.lit(KINDS.index(k))}) for k, df in streams.items()]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    w = W.partitionBy("instrument", bucket(F.col("ts_ms"), DAY_MS)).orderBy("ts_ms", "kind_rank", "seq")
    return every.withColumn("order_no", F.row_number().over(w))


def deduplicated(events: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """EV2: the first row of each id; and, by repeats(), rows without ids that repeat the one before them."""
    w = W.partitionBy(*key).orderBy(*order)
    return events.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def without_repeats(events: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """EV2: drops a row whose values equal those of the row before it; ``order`` begins with a time."""
    e = lagged(events.withColumn("__row", F.struct(*values)), keys, order[0], order, {"__row": "__before"})
    return e.where(~F.col("__row").eqNullSafe(F.col("__before"))).drop("__row", "__before")


def sequence_breaks(trades: DataFrame, keys: list[str], step: int = 1) -> DataFrame:
    """EV3: a gap row between two trades of one session whose ids aren't consecutive."""
    t = lagged(trades.select(*keys, "trade_id", "ts_ms"), keys, "trade_id", ["trade_id"], {"trade_id": "p_id", "ts_ms": "start_ms"}, ID_WIDTH)
    t = t.where(F.col("trade_id") != F.col("p_id") + step)
    return t.select(*keys, "start_ms", F.col("ts_ms").alias("end_ms"), (F.col("trade_id") - F.col("p_id") - step).alias("missing"), F.lit("sequence_break").alias("reason"))


def session_gaps(events: DataFrame, session: str) -> DataFrame:
    """EV4: from the last event of a session to the first of the next one."""
    e = lagged(events.select("instrument", "ts_ms", "seq", session), ["instrument"], "ts_ms", ["ts_ms", "seq"], {session: "p", "ts_ms": "start_ms"})
    e = e.where(F.col("p") != F.col(session))
    return e.select("instrument", "start_ms", F.col("ts_ms").alias("end_ms"), F.lit("disconnected").alias("reason"))


def late_events(arrivals: DataFrame, hold_ms: int) -> DataFrame:
    """EV6: rows that arrive (by seq) when a row more than ``hold_ms`` later has been seen already."""
    a = max_before(arrivals, ["instrument"], "seq", ["seq"], "ts_ms", "seen", ID_WIDTH)
    return a.where(F.col("ts_ms") < F.col("seen") - hold_ms).select("instrument", "seq", "ts_ms", F.col("seen").alias("seen_ms"))


def missing_days(events: DataFrame) -> DataFrame:
    """EV7: days between an instrument's first and last one that have no events."""
    days = events.select("instrument", bucket(F.col("ts_ms"), DAY_MS).alias("day_ms")).distinct()
    span = days.groupBy("instrument").agg(F.min("day_ms").alias("a"), F.max("day_ms").alias("b"))
    every = span.select("instrument", F.explode(F.sequence("a", "b", F.lit(DAY_MS))).alias("day_ms"))
    return every.join(days, ["instrument", "day_ms"], "left_anti")


def silences(events: DataFrame, most_ms: int) -> DataFrame:
    """EV8: stretches without events that last longer than ``most_ms``."""
    e = lagged(events.select("instrument", F.col("ts_ms").alias("end_ms")), ["instrument"], "end_ms", ["end_ms"], {"end_ms": "start_ms"})
    e = e.select("instrument", "start_ms", "end_ms")
    return e.where(F.col("end_ms") - F.col("start_ms") > most_ms).withColumn("silent_ms", F.col("end_ms") - F.col("start_ms"))


def folded(aggregates: DataFrame, trades: DataFrame) -> DataFrame:
    """EV9: quantity of each aggregate with the trades restored that no id range covers.

    aggregates: agg_id, first_id, last_id, price, aggressor, qty. An uncovered trade goes to the aggregate before it if price
    and side match and all uncovered trades between did so too; the rest are counted as lost.
    """
    t = trades.select("instrument", "trade_id", "price", "aggressor", "qty")
    given = {"agg_id": "agg_id", "last_id": "last_id", "price": "agg_price", "aggressor": "agg_aggressor"}
    u = asof(t, aggregates, ["instrument"], "trade_id", "first_id", given, width=ID_WIDTH).where("agg_id IS NULL OR trade_id > last_id")
    ok = F.coalesce((F.col("price") == F.col("agg_price")) & (F.col("aggressor") == F.col("agg_aggressor")), F.lit(False))
    key = ["instrument", "agg_id"]
    ends = u.groupBy(*key).agg(F.min(F.when(~ok, F.col("trade_id"))).alias("end_id"))
    u = u.where("agg_id IS NOT NULL").join(ends, key)
    kept = F.col("end_id").isNull() | (F.col("trade_id") < F.col("end_id"))
    add = u.where(kept).groupBy(*key).agg(F.sum("qty").alias("restored"), F.count("*").alias("n_restored"))
    lost = u.where(~kept).groupBy(*key).agg(F.count("*").alias("n_lost"))
    out = aggregates.join(add, ["instrument", "agg_id"], "left").join(lost, ["instrument", "agg_id"], "left").fillna(0, ["restored", "n_restored", "n_lost"])
    return out.select("instrument", "agg_id", (F.col("qty") + F.col("restored")).alias("qty"), "n_restored", "n_lost")


def rejections(events: DataFrame) -> DataFrame:
    """EV10: (instrument, trade_id, reason) of rows that break a rule: quantity, price, order of ids."""
    e = max_before(events, ["instrument"], "ts_ms", ["ts_ms", "trade_id"], "trade_id", "p")
    reason = F.when(F.col("qty") <= 0, "quantity").when(F.col("price") <= 0, "price").when(F.col("trade_id") == F.col("p"), "duplicate").when(F.col("trade_id") < F.col("p"), "id_regression")
    return e.withColumn("reason", reason).where("reason IS NOT NULL").select("instrument", "trade_id", "reason")


def restart_segments(events: DataFrame, bound_ms: int) -> DataFrame:
    """EV11: number of jumps of more than ``bound_ms`` so far."""
    order = ["ts_ms", "trade_id"]
    e = lagged(events, ["instrument"], "ts_ms", order, {"ts_ms": "p"})
    e = e.withColumn("j", F.coalesce((F.col("ts_ms") - F.col("p") > bound_ms).cast("int"), F.lit(0)))
    return prefix_sum(e, ["instrument"], "ts_ms", order, "j", "chain", peers=True).drop("p", "j")


def stitched(archive: DataFrame, live: DataFrame, cutover_ms: int) -> DataFrame:
    """EV12: archive rows before the cutover and live rows from it on."""
    return archive.where(F.col("ts_ms") < cutover_ms).unionByName(live.where(F.col("ts_ms") >= cutover_ms))


def known_until(trades: DataFrame, gaps: DataFrame) -> DataFrame:
    """EV13: the last trade of each instrument, and whether a gap reaches beyond it."""
    t = trades.groupBy("instrument").agg(F.max("ts_ms").alias("known_until"))
    g = gaps.groupBy("instrument").agg(F.max("end_ms").alias("gap_end"))
    return t.join(g, "instrument", "left").select("instrument", "known_until", F.coalesce(F.col("gap_end") > F.col("known_until"), F.lit(False)).alias("trailing_gap"))


def fingerprint(trades: DataFrame) -> DataFrame:
    """EV14: rows and a digest per instrument, from the digests of its days in order, these from the digests of their minutes; equal loads
    have equal digests. A group holds the rows of a minute, the minutes of a day, or the days of an instrument."""
    row = F.concat_ws("|", "ts_ms", "trade_id", "price", "qty", "aggressor")
    rows = trades.select("instrument", bucket(F.col("ts_ms"), DAY_MS).alias("day_ms"), bucket(F.col("ts_ms"), 60_000).alias("minute_ms"), "ts_ms", "trade_id", F.sha2(row, 256).alias("h"), F.lit(1).alias("n"))
    for keys, order in ((["instrument", "day_ms", "minute_ms"], ["ts_ms", "trade_id"]), (["instrument", "day_ms"], ["minute_ms"]), (["instrument"], ["day_ms"])):
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "h"))), lambda r: r["h"]), "")
        rows = rows.groupBy(*keys).agg(F.sha2(joined, 256).alias("h"), F.sum("n").alias("n"))
    return rows.select("instrument", "n", F.col("h").alias("digest"))


def first_difference(a: DataFrame, b: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """EV15, EV16: per key the counts of both sides and the first position at which they differ (null if nowhere).

    Both sides have a column position.
    """
    one = a.select(*keys, "position", F.struct(*values).alias("x"))
    two = b.select(*keys, "position", F.struct(*values).alias("y"))
    j = one.join(two, [*keys, "position"], "full_outer")
    return j.groupBy(*keys).agg(
        F.count("x").alias("n_a"), F.count("y").alias("n_b"), F.min(F.when(~F.col("x").eqNullSafe(F.col("y")), F.col("position"))).alias("first_difference")
    )


