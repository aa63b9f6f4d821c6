"""Registered queries: statistics of the studies, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions.timing import bucket
from tapeloom.operators import location as L
from tapeloom.operators import study_stats as Z
from tapeloom.plans import location_triggers as T
from tapeloom.plans.bars_flow import covered
from tapeloom.plans.outcome_queries import raced, samples
from tapeloom.plans.study_relations import HS, YR, all_records, measured, members, records
from tapeloom.plans.tape_sql import TAPE
from tapeloom.sources.tape import DAY_MS, HOUR_MS, trades

H, FEE_BPS = HOUR_MS, 10.0


def net(s, d):
    return Z.net_results(measured(s, d), "4h", FEE_BPS)


def moves(s, d):
    """Hourly bars with a price: return, log range, hour, weekday and half (by the parity of the week)."""
    b = covered(s, d).where("close IS NOT NULL AND open > 0 AND low > 0 AND high > low")
    return b.select(
        "instrument", "bar_ms", (F.col("close") / F.col("open") - 1).alias("r"), F.log(F.col("high") / F.col("low")).alias("lr"), (F.pmod("bar_ms", F.lit(DAY_MS)) / H).cast("int").alias("hour"),
        F.pmod((F.col("bar_ms") - F.pmod("bar_ms", F.lit(DAY_MS))) / DAY_MS + 3, F.lit(7)).cast("int").alias("weekday"), F.pmod((F.col("bar_ms") - F.pmod("bar_ms", F.lit(7 * DAY_MS))) / (7 * DAY_MS), F.lit(2)).cast("int").alias("half"),
    )


def by_session(s, d):
    hour = (F.pmod("decision_ms", F.lit(DAY_MS)) / H).cast("int")
    session = F.when(hour < 8, "asia").when(hour < 14, "europe").otherwise("america")
    r = records(s, d).groupBy(hour.alias("hour"), session.alias("session")).agg(F.count_if(F.col("sample") == "baseline").alias("baseline"), F.count_if(F.col("sample") == "trigger").alias("triggers"))
    return r.withColumn("ratio", F.col("triggers") / F.nullif(F.col("baseline"), F.lit(0)))


def daily_upper(s, d):
    """Share of races per day that the upper barrier won."""
    o = raced(s, d).where("horizon = '4h' AND race IN ('upper', 'lower', 'neither')")
    return o.groupBy(bucket(F.col("decision_ms"), DAY_MS).alias("day_ms")).agg((F.count_if(F.col("race") == "upper") / F.count("*")).alias("share"))


def half(c: str):
    return F.pmod((F.col(c) - F.pmod(c, F.lit(7 * DAY_MS))) / (7 * DAY_MS), F.lit(2)).cast("int").alias("half")


def move_bands(s, d):
    bps = F.abs(F.col("r")) * 10_000
    ranks = [F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY abs(r) * 10000)").alias(f"p{int(q * 100)}") for q in (0.5, 0.9, 0.99)]
    return moves(s, d).groupBy("instrument").agg(F.count("*").alias("n"), *ranks, (F.count_if(bps <= 500) / F.count("*")).alias("within_500"))


QUERIES = {
    "z3_independent_units": lambda s, d: Z.units(members(s, d), "out_4h", 4 * H, 4 * H),
    "z4_cells": lambda s, d: Z.cells(members(s, d), HS),
    "z9_sample_needed": lambda s, d: Z.sample_needed(Z.cells(members(s, d), HS)),
    "z10_net_results": net,
    "z16_breakout_survival": lambda s, d: Z.survival(L.acceptance(covered(s, d), T.ranges(s, d), T.CLOSES)),
    "z17_hour_homogeneity": lambda s, d: Z.homogeneity(trades(s, d).withColumn("hour", (F.pmod("ts_ms", F.lit(DAY_MS)) / H).cast("int")), "hour", F.col("aggressor") == "buy"),
    "z19_seasonal_hours": lambda s, d: Z.seasonal(moves(s, d), "hour"),
    "z19_seasonal_weekdays": lambda s, d: Z.seasonal(moves(s, d), "weekday"),
    "z20_variance_shares": lambda s, d: Z.variance_shares(moves(s, d), ["hour", "weekday", "instrument"], "lr"),
    "z21_half_stability": lambda s, d: Z.stability(moves(s, d), "hour", "half", "lr"),
    "z22_alert_volume": lambda s, d: Z.alert_volume(records(s, d).where("sample = 'trigger'"), "decision_ms"),
    "z25_trigger_rates": lambda s, d: all_records(s, d).where("sample = 'trigger'").groupBy("trigger", half("decision_ms"), "regime").agg(F.count("*").alias("n")),
    "z26_samples_by_session": by_session,
    "z27_neither_shares": lambda s, d: raced(s, d).groupBy("horizon").agg((F.count_if(F.col("race") == "neither") / F.nullif(F.count_if(F.col("race").isin("upper", "lower", "neither")), F.lit(0))).alias("neither"), (F.count_if(F.col("race") == "censored") / F.count("*")).alias("censored")),
    "z28_daily_noise": lambda s, d: Z.ar1(daily_upper(s, d), "share"),
    "z30_move_bands": move_bands,
    "z31_effort_rates": lambda s, d: T.efforts(s, d).where("active IS NOT NULL").groupBy("instrument", half("bar_ms")).agg(F.count("*").alias("n"), F.count_if("active").alias("n_active"), (F.count_if("active") / F.count("*")).alias("rate")),
}

RANS = "count(*) FILTER (WHERE out = 'hypothesis') AS n_hypothesis, count(*) FILTER (WHERE out = 'counter') AS n_counter, count(*) FILTER (WHERE out = 'neither') AS n_neither"
CE = f"""{YR}, c0 AS (SELECT pair, regime, location, unnest(['4h', '12h', '1d']) AS horizon, unnest([out_4h, out_12h, out_1d]) AS out FROM ym),
c1 AS (SELECT pair, 'all' AS split, 'all' AS value, horizon, out FROM c0 UNION ALL SELECT pair, 'regime', regime, horizon, out FROM c0 UNION ALL SELECT pair, 'location', location, horizon, out FROM c0),
ce AS (SELECT pair, split, value, horizon, count(*) AS members, {RANS} FROM c1 GROUP BY 1, 2, 3, 4)"""
NT = f"""{YR}, n0 AS (SELECT cm.pair, cm.instrument, cm.event_seq, cm.decision_ms, CASE out_4h WHEN 'hypothesis' THEN 1.0 WHEN 'counter' THEN -1.0 WHEN 'neither' THEN CASE hypothesis WHEN 'upper' THEN mark_4h ELSE -mark_4h END END AS gross, {FEE_BPS}::DOUBLE / nullif(half_bps_4h, 0) AS fee
  FROM cm JOIN ym USING (pair, effort_window, instrument, event_seq) JOIN mk USING (instrument, event_seq)), nt AS (SELECT *, gross - fee AS net FROM n0 WHERE gross - fee IS NOT NULL)"""
MV = f"""{YR}, mo AS (SELECT instrument, bar_ms, close::DOUBLE / open - 1 AS r, ln(high::DOUBLE / low) AS lr, bar_ms % {DAY_MS} // {H} AS hour, (bar_ms // {DAY_MS} + 3) % 7 AS weekday, bar_ms // {7 * DAY_MS} % 2 AS half FROM dense WHERE close IS NOT NULL AND open > 0 AND low > 0 AND high > low)"""


def _seasonal(slot: str) -> str:
    est = "sqrt(avg(r * r)) AS pooled, exp(avg(ln(lr))) AS geometric, sqrt(avg(lr * lr)) AS log_range"
    return f"{MV}, al AS (SELECT {est} FROM mo), pe AS (SELECT {slot}, count(*) AS n, {est} FROM mo GROUP BY 1) SELECT {slot}, n, pe.pooled / al.pooled AS pooled, pe.geometric / al.geometric AS geometric, pe.log_range / al.log_range AS log_range FROM pe, al"


def _share(g: str) -> str:
    return f"""SELECT '{g}' AS grouping, share, 1 - (1 - share) * (n - 1) / (n - k) AS adjusted_r2 FROM (SELECT (sum(s * s / n) - sum(s) * sum(s) / sum(n)) / (sum(q) - sum(s) * sum(s) / sum(n)) AS share, sum(n) AS n, count(*) AS k
      FROM (SELECT {g}, count(*) AS n, sum(lr) AS s, sum(lr * lr) AS q FROM mo GROUP BY 1))"""


HOW = "((isodow(l) - 1) * 24 + hour(l))"
LOCAL = "timezone('America/New_York', make_timestamptz(ts_ms * 1000))"
SQL = {
    "z3_independent_units": f"""{YR}, u0 AS (SELECT *, CASE WHEN decision_ms - lag(decision_ms) OVER w < {4 * H} THEN 0 ELSE 1 END AS new FROM ym WINDOW w AS (PARTITION BY pair, instrument ORDER BY decision_ms, event_seq)),
      u1 AS (SELECT *, sum(new) OVER (PARTITION BY pair, instrument ORDER BY decision_ms, event_seq ROWS UNBOUNDED PRECEDING) AS episode FROM u0), u2 AS (SELECT pair, instrument, episode, min({{'d': decision_ms, 'e': event_seq}}) AS f FROM u1 WHERE out_4h IN ('hypothesis', 'counter', 'neither') GROUP BY 1, 2, 3),
      u3 AS (SELECT pair, instrument, f.d AS decision_ms, f.e AS event_seq, row_number() OVER (PARTITION BY pair, instrument ORDER BY f) AS k FROM u2), u4 AS (SELECT a.pair, a.instrument, a.k, min(b.k) AS nxt FROM u3 a LEFT JOIN u3 b ON a.pair = b.pair AND a.instrument = b.instrument AND b.decision_ms >= a.decision_ms + {4 * H} GROUP BY 1, 2, 3),
      u5 AS (SELECT DISTINCT pair, instrument, CAST(1 AS BIGINT) AS k FROM u3 UNION ALL SELECT u5.pair, u5.instrument, nxt FROM u5 JOIN u4 ON u4.pair = u5.pair AND u4.instrument = u5.instrument AND u4.k = u5.k WHERE nxt IS NOT NULL) SELECT pair, instrument, decision_ms, event_seq FROM u3 JOIN u5 USING (pair, instrument, k)""",
    "z4_cells": f"{CE} SELECT * FROM ce",
    "z9_sample_needed": f"{CE} SELECT pair, horizon, mu, CAST(ceil(pow(1.96 / nullif(mu, 0), 2)) AS BIGINT) AS needed FROM (SELECT *, (n_hypothesis - n_counter)::DOUBLE / nullif(n_hypothesis + n_counter + n_neither, 0) AS mu FROM ce WHERE split = 'all')",
    "z10_net_results": f"{NT} SELECT * FROM nt",
    "z16_breakout_survival": f"""{YR}, q0 AS (SELECT *, CASE WHEN region = lag(region) OVER (PARTITION BY instrument, day_ms ORDER BY bar_ms) THEN 0 ELSE 1 END AS new FROM sa), q1 AS (SELECT *, sum(new) OVER (PARTITION BY instrument, day_ms ORDER BY bar_ms ROWS UNBOUNDED PRECEDING) AS run FROM q0),
      q2 AS (SELECT instrument, day_ms, run, count(*) AS length FROM q1 WHERE region <> 'inside' GROUP BY 1, 2, 3), q3 AS (SELECT length, unnest(range(1, length + 1)) AS closes FROM q2) SELECT closes, count(*) AS at_risk, count(*) FILTER (WHERE closes = length) AS ended, count(*) FILTER (WHERE closes = length)::DOUBLE / count(*) AS hazard FROM q3 GROUP BY 1""",
    "z17_hour_homogeneity": f"""WITH {TAPE}, t AS (SELECT ts_ms % {DAY_MS} // {H} AS g, count(*) AS n, count(*) FILTER (WHERE aggressor = 'buy') AS a FROM trades GROUP BY 1), x AS (SELECT *, n * (SELECT sum(a) FROM t)::DOUBLE / (SELECT sum(n) FROM t) AS e1 FROM t)
      SELECT sum(pow(a - e1, 2) / e1 + pow(n - a - (n - e1), 2) / (n - e1)) AS x2, count(*) - 1 AS df, min(least(e1, n - e1)) >= 5 AS evaluable FROM x""",
    "z19_seasonal_hours": _seasonal("hour"),
    "z19_seasonal_weekdays": _seasonal("weekday"),
    "z20_variance_shares": f"{MV} {' UNION ALL '.join(_share(g) for g in ('hour', 'weekday', 'instrument'))}",
    "z21_half_stability": f"{MV}, p2 AS (SELECT hour, avg(lr) FILTER (WHERE half = 0) AS a, avg(lr) FILTER (WHERE half = 1) AS b FROM mo GROUP BY 1) SELECT corr(a, b) AS corr, max(abs(a - b)) AS max_difference, sqrt(avg((a - b) * (a - b))) AS rms_difference, count(*) AS slots FROM p2 WHERE a IS NOT NULL AND b IS NOT NULL",
    "z22_alert_volume": f"""{YR}, al AS (SELECT decision_ms FROM yr WHERE sample = 'trigger'), pd2 AS (SELECT decision_ms // {DAY_MS} AS d, count(*) AS n FROM al GROUP BY 1), bz AS (SELECT max(c) AS busiest_hour FROM (SELECT count(*) OVER (PARTITION BY decision_ms // {DAY_MS} ORDER BY decision_ms RANGE BETWEEN CURRENT ROW AND {H - 1} FOLLOWING) AS c FROM al))
      SELECT count(*) AS days, list_sort(list(n))[CAST(ceil(0.5 * count(*)) AS BIGINT)] AS p50, list_sort(list(n))[CAST(ceil(0.95 * count(*)) AS BIGINT)] AS p95, max(n) AS most, any_value(busiest_hour) AS busiest_hour FROM pd2, bz""",
    "z25_trigger_rates": f"{YR} SELECT trigger, decision_ms // {7 * DAY_MS} % 2 AS half, regime, count(*) AS n FROM ra WHERE sample = 'trigger' GROUP BY 1, 2, 3",
    "z26_samples_by_session": f"{YR} SELECT decision_ms % {DAY_MS} // {H} AS hour, CASE WHEN decision_ms % {DAY_MS} // {H} < 8 THEN 'asia' WHEN decision_ms % {DAY_MS} // {H} < 14 THEN 'europe' ELSE 'america' END AS session, count(*) FILTER (WHERE sample = 'baseline') AS baseline, count(*) FILTER (WHERE sample = 'trigger') AS triggers, triggers::DOUBLE / nullif(baseline, 0) AS ratio FROM yr GROUP BY 1, 2",
    "z27_neither_shares": f"{YR} SELECT horizon, count(*) FILTER (WHERE race = 'neither')::DOUBLE / nullif(count(*) FILTER (WHERE race IN ('upper', 'lower', 'neither')), 0) AS neither, count(*) FILTER (WHERE race = 'censored')::DOUBLE / count(*) AS censored FROM rc GROUP BY 1",
    "z28_daily_noise": f"{YR}, dd AS (SELECT decision_ms // {DAY_MS} AS d, count(*) FILTER (WHERE race = 'upper')::DOUBLE / count(*) AS share FROM rc WHERE horizon = '4h' AND race IN ('upper', 'lower', 'neither') GROUP BY 1) SELECT regr_slope(a.share, b.share) AS slope, corr(b.share, a.share) AS corr, count(*) AS n FROM dd a JOIN dd b ON a.d = b.d + 1",
    "z30_move_bands": f"{MV}, mq AS (SELECT instrument, list_sort(list(abs(r) * 10000)) AS q, count(*) FILTER (WHERE abs(r) * 10000 <= 500)::DOUBLE / count(*) AS within_500 FROM mo GROUP BY 1) SELECT instrument, len(q) AS n, q[CAST(ceil(0.5 * len(q)) AS BIGINT)] AS p50, q[CAST(ceil(0.9 * len(q)) AS BIGINT)] AS p90, q[CAST(ceil(0.99 * len(q)) AS BIGINT)] AS p99, within_500 FROM mq",
    "z31_effort_rates": f"{YR} SELECT instrument, bar_ms // {7 * DAY_MS} % 2 AS half, count(*) AS n, count(*) FILTER (WHERE active) AS n_active, count(*) FILTER (WHERE active)::DOUBLE / count(*) AS rate FROM ef WHERE active IS NOT NULL GROUP BY 1, 2",
    "z5_hour_of_week": f"WITH {TAPE}, t AS (SELECT {LOCAL} AS l FROM trades) SELECT {HOW} AS hour, count(*) AS n FROM t GROUP BY 1",
    "z6_tilt": f"""WITH {TAPE}, t0 AS (SELECT *, {LOCAL} AS l, CASE WHEN aggressor = 'buy' THEN 1 ELSE -1 END AS side FROM trades), t AS (SELECT *, {HOW} AS hour FROM t0), b AS (SELECT instrument, hour, avg(side) AS base FROM t WHERE qty <= 60 GROUP BY 1, 2),
      m AS (SELECT instrument, hour, count(*) AS n, sum(side) AS s FROM t WHERE qty > 60 GROUP BY 1, 2) SELECT CAST(sum(n) FILTER (WHERE base IS NOT NULL) AS BIGINT) AS n, CAST(sum(n) FILTER (WHERE base IS NULL) AS BIGINT) AS dropped, sum(s - n * base) / sum(n) FILTER (WHERE base IS NOT NULL) AS tilt FROM m LEFT JOIN b USING (instrument, hour)""",
}
