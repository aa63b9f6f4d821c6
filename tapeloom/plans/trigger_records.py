"""Registered queries: trigger records, their evidence spans and episodes, the leak guard, and report rows."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeloom.functions.timing import bucket
from tapeloom.operators import labels as B
from tapeloom.operators import location as L
from tapeloom.operators import motion as V
from tapeloom.plans import location_triggers as T
from tapeloom.plans.bars_flow import RANKED, REGIME, atrs, hour_bars
from tapeloom.plans.outcome_queries import raced
from tapeloom.plans.profile_structure import SW
from tapeloom.plans.study_relations import YR, _later, all_records, samples
from tapeloom.sources.tape import DAY_MS, HOUR_MS

H = HOUR_MS
ADMITTED = ["structural_high", "structural_low", "prior_high", "prior_low"]


def numbered(s, d):
    """Q2: baseline and trigger samples in one order, the baseline first within one event."""
    r = all_records(s, d).withColumn("ordinal", F.when(F.col("sample") == "baseline", "").otherwise(F.col("trigger")))
    return B.numbered(r, ["decision_ms", "event_seq", "instrument", "ordinal"]).select("record", "instrument", "event_seq", "sample", "trigger")


def spans(s, d):
    """Q4: the time that a trigger's evidence covers: its window's four hours, or the bar that failed."""
    r = all_records(s, d).where("sample = 'trigger'").join(samples(s, d).select("instrument", "event_seq", "bar_end_ms"), ["instrument", "event_seq"])
    first = F.col("bar_end_ms") - F.when(F.col("trigger") == "effort_result.4h", 4 * H).otherwise(H)
    return r.select("instrument", "event_seq", "trigger", first.alias("first_ms"), F.col("bar_end_ms").alias("last_ms"))


def episodes(s, d):
    """Q5: a trigger joins the open episode of its id when their spans overlap; the hull grows."""
    w = W.partitionBy("instrument", "trigger").orderBy("first_ms", "event_seq")
    r = spans(s, d).withColumn("reach", F.max("last_ms").over(w.rowsBetween(W.unboundedPreceding, -1)))
    r = r.withColumn("new", F.coalesce((F.col("first_ms") >= F.col("reach")).cast("int"), F.lit(1)))
    r = r.withColumn("episode", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return r.groupBy("instrument", "trigger", "episode").agg(F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms"), F.count("*").alias("members"))


def leaks(s, d):
    """Q14: labels whose result lies at or before their decision, per horizon; none may."""
    o = raced(s, d)
    return o.groupBy("horizon").agg(F.count("*").alias("labels"), F.count_if(F.col("race_at") < F.col("decision_ms")).alias("early_races"), F.count_if(F.col("censor_at") < F.col("decision_ms")).alias("early_censors"))


def regime_changes(s, d):
    """Changes between consecutive ready values of an instrument's regime."""
    r = V.regime(atrs(s, d), RANKED).where("regime IS NOT NULL")
    r = r.withColumn("was", F.lag("regime").over(W.partitionBy("instrument").orderBy("bar_ms")))
    return r.where("was != regime").select("instrument", "bar_ms", "was", "regime")


def daily_report(s, d):
    """One row per instrument and day with the day's prices, volumes, trades and delta."""
    b = hour_bars(s, d)
    return b.groupBy("instrument", bucket(F.col("bar_ms"), DAY_MS).alias("day_ms")).agg(
        F.min_by("open", "bar_ms").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "bar_ms").alias("close"),
        F.sum("volume").alias("volume"), F.sum("n_trades").alias("n_trades"), F.sum("delta").alias("delta"),
    )


QUERIES = {
    "q2_all_record_numbers": numbered,
    "q4_evidence_spans": spans,
    "q5_episodes": episodes,
    "q14_leak_guard": leaks,
    "c8_location_gate": lambda s, d: L.gated(L.rising_edges(T.efforts(s, d)), T.zones(s, d), ADMITTED),
    "t2_swing_failures": lambda s, d: T.table(s, d).where("family = 'sfp'"),
    "t3_divergences": lambda s, d: T.table(s, d).where("family = 'divergence'"),
    "t4_efforts_at_location": lambda s, d: T.table(s, d).where("family = 'effort'"),
    "g4_regime_changes": regime_changes,
    "g5_daily_report": daily_report,
}

TT = f"""{T.AN}{_later(T.LV.removeprefix(SW), "pd")}{_later(T.EF)},
gt AS (SELECT instrument, bar_ms FROM (SELECT *, coalesce(lag(active) OVER (PARTITION BY instrument ORDER BY bar_ms), false) AS was FROM ef WHERE active IS NOT NULL) e WHERE active AND NOT was AND EXISTS (SELECT 1 FROM zn WHERE zn.instrument = e.instrument AND zn.bar_ms = e.bar_ms AND in_zone)),
tb AS (SELECT DISTINCT instrument, swept_bar_ms AS bar_ms, 'sfp.1h' AS trigger, 'sfp' AS family FROM so WHERE outcome = 'failure' UNION ALL SELECT DISTINCT instrument, known_bar_ms, 'cvd_divergence.1h', 'divergence' FROM dv UNION ALL SELECT DISTINCT instrument, bar_ms, 'effort_result.4h', 'effort' FROM gt)"""
SP = f"{YR}, sn AS (SELECT r.instrument, r.event_seq, r.trigger, bar_end_ms - CASE WHEN trigger = 'effort_result.4h' THEN {4 * H} ELSE {H} END AS first_ms, bar_end_ms AS last_ms FROM ra r JOIN sm USING (instrument, event_seq) WHERE sample = 'trigger')"
SQL = {
    "q2_all_record_numbers": f"{YR} SELECT row_number() OVER (ORDER BY decision_ms, event_seq, instrument, CASE WHEN sample = 'baseline' THEN '' ELSE trigger END) - 1 AS record, instrument, event_seq, sample, trigger FROM ra",
    "q4_evidence_spans": f"{SP} SELECT * FROM sn",
    "q5_episodes": f"""{SP}, s1 AS (SELECT *, max(last_ms) OVER (PARTITION BY instrument, trigger ORDER BY first_ms, event_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM sn), s2 AS (SELECT *, CAST(sum(CASE WHEN first_ms < reach THEN 0 ELSE 1 END) OVER (PARTITION BY instrument, trigger ORDER BY first_ms, event_seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS episode FROM s1)
      SELECT instrument, trigger, episode, min(first_ms) AS first_ms, max(last_ms) AS last_ms, count(*) AS members FROM s2 GROUP BY 1, 2, 3""",
    "q14_leak_guard": f"{YR} SELECT horizon, count(*) AS labels, count(*) FILTER (WHERE race IN ('upper', 'lower') AND wat < decision_ms) AS early_races, count(*) FILTER (WHERE censor_at < decision_ms) AS early_censors FROM rc GROUP BY 1",
    "c8_location_gate": f"{TT} SELECT * FROM gt",
    "t7_trigger_table": f"{TT} SELECT * FROM tb",
    "t2_swing_failures": f"{TT} SELECT * FROM tb WHERE family = 'sfp'",
    "t3_divergences": f"{TT} SELECT * FROM tb WHERE family = 'divergence'",
    "t4_efforts_at_location": f"{TT} SELECT * FROM tb WHERE family = 'effort'",
    "g4_regime_changes": f"{REGIME}, r AS (SELECT instrument, bar_ms, CASE WHEN percentile <= 25 THEN 'low' WHEN percentile <= 50 THEN 'normal' WHEN percentile <= 75 THEN 'elevated' ELSE 'high' END AS regime FROM pct WHERE percentile IS NOT NULL) SELECT * FROM (SELECT instrument, bar_ms, lag(regime) OVER (PARTITION BY instrument ORDER BY bar_ms) AS was, regime FROM r) WHERE was <> regime",
    "g5_daily_report": f"{REGIME} SELECT instrument, bar_ms - bar_ms % {DAY_MS} AS day_ms, first(open ORDER BY bar_ms) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY bar_ms) AS close, CAST(sum(volume) AS BIGINT) AS volume, CAST(sum(n_trades) AS BIGINT) AS n_trades, CAST(sum(delta) AS BIGINT) AS delta FROM bars GROUP BY 1, 2",
}
