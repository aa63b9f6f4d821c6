"""Outcomes of trades on decisions, as joins on decisions and the tape: admission, entry, exit, costs, overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.tables import written
from tapeloom.functions.timing import asof
from tapeloom.operators.labels import first_touch, thinned

KEY = ["instrument", "event_seq", "trigger"]
FUNDING_MS = 28_800_000


def half_even(num: Column, den: int) -> Column:
    """num / den in whole units, half to even; num isn't negative."""
    rest = F.pmod(num, F.lit(den))
    q = ((num - rest) / den).cast("long")
    return q + F.when((rest * 2 > den) | ((rest * 2 == den) & (q % 2 == 1)), 1).otherwise(0)


def sided(decisions: DataFrame) -> DataFrame:
    """Against the aggressor of an effort trigger, away from the failed side of the others."""
    effort = F.col("trigger").startswith("effort_result")
    side = F.when(effort, F.when(F.col("aggressor") == "buy", "sell").when(F.col("aggressor") == "sell", "buy"))
    side = side.otherwise(F.when(F.col("failed_side") == "above", "sell").when(F.col("failed_side") == "below", "buy"))
    return decisions.withColumn("side", side)


def admitted(decisions: DataFrame, stop_parts: int, target_r: int, regimes: tuple[str, ...]) -> DataFrame:
    """Stop and target around the reference, and the first reason against the decision (null if admitted).

    The stop lies stop_parts / 100 000 average true ranges away, the target ``target_r`` times as far.
    """
    d = decisions.withColumn("risk", half_even(F.col("atr") * stop_parts, 100_000))
    sign = F.when(F.col("side") == "buy", 1).when(F.col("side") == "sell", -1)
    d = d.withColumns({"stop": F.col("reference") - sign * F.col("risk"), "target": F.col("reference") + sign * F.col("risk") * target_r})
    reason = F.when(~F.col("regime").isin(*regimes), "filter").when(F.col("side").isNull(), "side").when(F.col("reference").isNull(), "reference")
    reason = reason.when(F.coalesce(F.col("risk") <= 0, F.lit(True)), "risk").when((F.col("stop") <= 0) | (F.col("target") <= 0), "stop_side")
    return d.withColumn("reason", reason)


def entered(decisions: DataFrame, trades: DataFrame, latency_ms: int, wait_ms: int) -> DataFrame:
    """The first trade at or after decision + latency and before the deadline, else unfilled (null)."""
    t = trades.select("instrument", "ts_ms", "trade_id", "price")
    d = decisions.where("reason IS NULL").withColumn("from_ms", F.col("decision_ms") + latency_ms)
    d = asof(d, t, ["instrument"], "from_ms", "ts_ms", {"ts_ms": "entry_ms", "trade_id": "entry_id", "price": "entry_price"}, forward=True, tie="trade_id")
    late = F.col("entry_ms") >= F.col("decision_ms") + wait_ms
    return d.withColumns({c: F.when(~late, F.col(c)) for c in ("entry_ms", "entry_id", "entry_price")}).drop("from_ms")


def exited(entries: DataFrame, bars: DataFrame, trades: DataFrame, hold_ms: int, width_ms: int) -> DataFrame:
    """First touch of stop or target after the entry, filled by the first trade of a later millisecond; else the first trade at or after the deadline."""
    e = entries.where("entry_ms IS NOT NULL").withColumn("horizon", F.concat_ws("#", "trigger", "event_seq"))
    buy = F.col("side") == "buy"
    lab = e.select("instrument", F.col("entry_id").alias("event_seq"), "horizon", F.col("entry_ms").alias("decision_ms"), (F.col("entry_ms") + hold_ms).alias("end_ms"),
                   F.when(buy, F.col("target")).otherwise(F.col("stop")).alias("upper"), F.when(buy, F.col("stop")).otherwise(F.col("target")).alias("lower"))
    t = first_touch(lab, bars, trades, width_ms)
    up = F.col("up_at").isNotNull() & (F.col("down_at").isNull() | (F.col("up_at") < F.col("down_at")))
    touch = F.when(up, F.struct(F.lit("upper").alias("b"), F.col("up_at.ts_ms").alias("ms"))).when(F.col("down_at").isNotNull(), F.struct(F.lit("lower").alias("b"), F.col("down_at.ts_ms").alias("ms")))
    t = t.select("instrument", "horizon", "end_ms", touch.alias("touch"))
    x = e.join(t, ["instrument", "horizon"])
    x = x.withColumn("exit_by", F.when(F.col("touch").isNull(), "time").when((F.col("touch.b") == "upper") == (F.col("side") == "buy"), "target").otherwise("stop"))
    x = x.withColumn("look_ms", F.coalesce(F.col("touch.ms") + 1, "end_ms"))
    tape = trades.select("instrument", "ts_ms", "trade_id", "price")
    return asof(written(x, "touched"), tape, ["instrument"], "look_ms", "ts_ms", {"ts_ms": "exit_ms", "price": "exit_price"}, forward=True, tie="trade_id").drop("horizon", "touch", "look_ms", "end_ms")


def slipped(price: Column, side: Column, bps: int) -> Column:
    """Fixed slippage in whole units, against the trade."""
    cost = F.floor(price * bps / 10_000).cast("long")
    return F.when(side == "buy", price + cost).otherwise(price - cost)


def results(exits: DataFrame, slippage_bps: int, fee_bps: int, funding_bps: int) -> DataFrame:
    """Gross and net result in R (the risk of the decision), after fees of both sides and the settlements in the holding span."""
    buy = F.col("side") == "buy"
    x = exits.withColumns({"entry_fill": slipped(F.col("entry_price"), F.col("side"), slippage_bps), "exit_fill": slipped(F.col("exit_price"), F.when(buy, "sell").otherwise("buy"), slippage_bps)})
    sign, risk = F.when(buy, 1).otherwise(-1), F.col("risk").cast("double")
    settled = F.floor(F.col("exit_ms") / FUNDING_MS) - F.floor(F.col("entry_ms") / FUNDING_MS)
    x = x.withColumns({
        "gross_r": sign * (F.col("exit_fill") - F.col("entry_fill")) / risk, "fee_r": (F.col("entry_fill") + F.col("exit_fill")) * fee_bps / 10_000 / risk,
        "settlements": settled.cast("long"), "funding_r": sign * settled * F.col("entry_fill") * funding_bps / 10_000 / risk,
    })
    return x.withColumn("net_r", F.col("gross_r") - F.col("fee_r") - F.col("funding_r"))


def censored(exits: DataFrame, gaps: DataFrame) -> DataFrame:
    """Gap where a feed gap meets the span from decision to exit, end_of_data where no exit is known, else null.

    The first gap that begins at or after the decision, and the last one before it, decide.
    """
    g = gaps.select("instrument", "start_ms", "end_ms")
    x = written(asof(exits, g, ["instrument"], "decision_ms", "start_ms", {"end_ms": "before_end"}), "censored")
    x = asof(x, g, ["instrument"], "decision_ms", "start_ms", {"start_ms": "next_start"}, forward=True)
    reason = F.when(F.col("exit_ms").isNull(), "end_of_data").when((F.col("before_end") >= F.col("decision_ms")) | (F.col("next_start") <= F.col("exit_ms")), "gap")
    return x.withColumn("censor", reason).drop("before_end", "next_start")


def taken(exits: DataFrame, hold_ms: int) -> DataFrame:
    """One open position per trigger and instrument: a decision before the exit of the last taken one is skipped."""
    span = F.coalesce(F.col("exit_ms") - F.col("decision_ms"), F.lit(hold_ms).cast("long"))
    exits = written(exits, "censored")
    t = thinned(exits.withColumn("span_ms", span), ["instrument", "trigger"], span="span_ms").select(*KEY, F.col("clear").alias("taken"))
    return exits.join(t, KEY)


def metrics(rows: DataFrame) -> DataFrame:
    """Per trigger, for all regimes and each: count, expectancy, profit factor, win rate, share of targets, mean holding time."""
    r = rows.withColumn("bucket", F.explode(F.array(F.lit("all"), F.col("regime"))))
    win, loss = F.sum(F.when(F.col("net_r") > 0, F.col("net_r"))), -F.sum(F.when(F.col("net_r") < 0, F.col("net_r")))
    return r.groupBy("trigger", "bucket").agg(
        F.count("*").alias("n"), F.avg("net_r").alias("expectancy"), (win / loss).alias("profit_factor"), (F.count_if(F.col("net_r") > 0) / F.count("*")).alias("win_rate"),
        (F.count_if(F.col("exit_by") == "target") / F.count("*")).alias("target_rate"), F.avg(F.col("exit_ms") - F.col("entry_ms")).alias("mean_holding_ms"),
    )
