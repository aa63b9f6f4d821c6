"""Registered queries: levels, zones, divergences, effort and triggers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions.tables import kept
from tapeloom.operators import flow as X
from tapeloom.operators import location as L
from tapeloom.operators import structure as S
from tapeloom.plans.bars_flow import WIN, covered
from tapeloom.plans.profile_structure import SW
from tapeloom.sources.tape import DAY_MS, HOUR_MS, trades

H = HOUR_MS
PAD, WIDTH, PAST, CLOSES = 200, 2_000_000_000, 24, 3


def ranges(s, d):
    """The prior day's range, as the area that the auction is read against."""
    b = covered(s, d).where("close IS NOT NULL")
    day = (F.col("bar_ms") - F.pmod("bar_ms", F.lit(DAY_MS)) + DAY_MS).alias("day_ms")
    return b.groupBy("instrument", day).agg(*[F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY close)").alias(n) for n, q in (("lo", 0.25), ("hi", 0.75))])


@kept
def levels(s, d):
    b = covered(s, d)
    swept = S.sweeps(b, S.swings(b))
    life = S.level_rows(swept, S.sweep_outcomes(b, swept)).where("kind LIKE 'structural%'")
    day = b.where("close IS NOT NULL").groupBy("instrument", (F.col("bar_ms") - F.pmod("bar_ms", F.lit(DAY_MS)) + DAY_MS).alias("valid_from")).agg(F.max("high").alias("h"), F.min("low").alias("l"))
    day = day.withColumn("valid_to", F.col("valid_from") + DAY_MS)
    prior = [day.select("instrument", F.lit(k).alias("kind"), F.col(c).alias("low"), F.col(c).alias("high"), "valid_from", "valid_to") for k, c in (("prior_high", "h"), ("prior_low", "l"))]
    return L.registry(life, *prior)


def zones(s, d):
    return L.in_zone(covered(s, d), levels(s, d), PAD)


def swings(s, d):
    return S.swings(covered(s, d))


@kept
def anchored(s, d):
    return L.anchors(swings(s, d), trades(s, d), X.cumulative_delta(trades(s, d)), H)


def flow4(s, d):
    return X.windows(covered(s, d), 4, H)


@kept
def efforts(s, d):
    return L.effort(flow4(s, d), PAST)


def table(s, d):
    b = covered(s, d)
    swept = S.sweeps(b, swings(s, d))
    fail = S.sweep_outcomes(b, swept).where("outcome = 'failure'").select("instrument", F.col("swept_bar_ms").alias("bar_ms"))
    div = L.divergences(anchored(s, d)).select("instrument", F.col("known_bar_ms").alias("bar_ms"))
    edges = L.gated(L.rising_edges(efforts(s, d)), zones(s, d), ["structural_high", "structural_low", "prior_high", "prior_low"])
    return L.trigger_table({"sfp.1h": ("sfp", fail), "cvd_divergence.1h": ("divergence", div), "effort_result.4h": ("effort", edges)})


QUERIES = {
    "l1_level_registry": levels,
    "l2_in_zone": lambda s, d: zones(s, d).groupBy("instrument", "kind").agg(F.count("*").alias("n"), F.count_if("in_zone").alias("n_in")),
    "l3_visits": lambda s, d: L.visits(zones(s, d)),
    "l4_nearest_levels": lambda s, d: L.nearest(covered(s, d), levels(s, d), 3),
    "l5_confluence": lambda s, d: L.confluence(levels(s, d), WIDTH),
    "c1_swing_anchors": anchored,
    "c2_cvd_divergence": lambda s, d: L.divergences(anchored(s, d)),
    "c4_effort_result": efforts,
    "c5_rising_edges": lambda s, d: L.rising_edges(efforts(s, d)),
    "c6_exhaustion": lambda s, d: L.exhaustion(efforts(s, d), flow4(s, d), covered(s, d), H, 12, 2000),
    "t6_bias_steps": lambda s, d: L.bias(swings(s, d)),
    "t7_trigger_table": table,
}

LV = f"""{SW}, pd AS (SELECT instrument, bar_ms - bar_ms % {DAY_MS} + {DAY_MS} AS d, max(high) AS h, min(low) AS l FROM nb GROUP BY 1, 2),
lv AS (SELECT instrument, 'structural_' || side AS kind, price AS low, price AS high, known_bar_ms AS valid_from, swept_bar_ms AS valid_to FROM st
  UNION ALL SELECT instrument, 'prior_high', h, h, d, d + {DAY_MS} FROM pd UNION ALL SELECT instrument, 'prior_low', l, l, d, d + {DAY_MS} FROM pd),
ac AS (SELECT n.instrument, n.bar_ms, n.high AS bar_high, n.low AS bar_low, n.close, v.kind, v.low, v.high, v.valid_from FROM nb n JOIN lv v ON n.instrument = v.instrument AND n.bar_ms >= v.valid_from AND (v.valid_to IS NULL OR n.bar_ms < v.valid_to)),
zn AS (SELECT *, (low - bar_high) * 10000 <= low * {PAD} AND (bar_low - high) * 10000 <= low * {PAD} AS in_zone FROM ac)"""
AN = f"""{SW}, cv AS (SELECT *, CAST(sum(CASE WHEN aggressor = 'buy' THEN qty ELSE -qty END) OVER (PARTITION BY instrument ORDER BY ts_ms, trade_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cvd FROM trades),
an AS (SELECT s.instrument, s.side, s.bar_ms, s.price, s.known_bar_ms, first(t.ts_ms ORDER BY t.ts_ms, t.trade_id) AS ts_ms, first(t.trade_id ORDER BY t.ts_ms, t.trade_id) AS trade_id, first(t.cvd ORDER BY t.ts_ms, t.trade_id) AS cvd
  FROM sw s JOIN cv t ON t.instrument = s.instrument AND t.ts_ms >= s.bar_ms AND t.ts_ms < s.bar_ms + {H} AND t.price = s.price GROUP BY 1, 2, 3, 4, 5),
dv AS (SELECT instrument, side, bar_ms, p_bar_ms, known_bar_ms, price, CASE WHEN side = 'high' THEN 'bearish' ELSE 'bullish' END AS divergence FROM
  (SELECT *, lag(price) OVER w AS pp, lag(cvd) OVER w AS pv, lag(bar_ms) OVER w AS p_bar_ms FROM an WINDOW w AS (PARTITION BY instrument, side ORDER BY bar_ms)) WHERE (side = 'high' AND price > pp AND cvd < pv) OR (side = 'low' AND price < pp AND cvd > pv))"""
EF = f"""{WIN}, e0 AS (SELECT instrument, bar_ms, w_volume, abs(last_close - reference) AS move FROM ww WHERE last_close - reference IS NOT NULL),
e1 AS (SELECT *, list_sort(list(w_volume) OVER p) AS es, list_sort(list(move) OVER p) AS ms FROM e0 WINDOW p AS (PARTITION BY instrument ORDER BY bar_ms ROWS BETWEEN {PAST} PRECEDING AND 1 PRECEDING)),
ef AS (SELECT instrument, bar_ms, w_volume AS effort, move, CASE WHEN len(es) = {PAST} THEN es[CAST(ceil(0.8 * {PAST}) AS BIGINT)] END AS effort_high, CASE WHEN len(es) = {PAST} THEN ms[CAST(ceil(0.5 * {PAST}) AS BIGINT)] END AS move_median,
  CASE WHEN len(es) = {PAST} THEN w_volume >= es[CAST(ceil(0.8 * {PAST}) AS BIGINT)] AND move <= ms[CAST(ceil(0.5 * {PAST}) AS BIGINT)] END AS active FROM e1)"""
AU = f"""{SW}, ar AS (SELECT instrument, bar_ms - bar_ms % {DAY_MS} + {DAY_MS} AS day_ms, list_sort(list(close)) AS c FROM nb GROUP BY 1, 2),
rg AS (SELECT n.instrument, n.bar_ms, a.day_ms, CASE WHEN close > c[CAST(ceil(0.75 * len(c)) AS BIGINT)] THEN 'above' WHEN close < c[CAST(ceil(0.25 * len(c)) AS BIGINT)] THEN 'below' ELSE 'inside' END AS region FROM nb n JOIN ar a ON n.instrument = a.instrument AND n.bar_ms - n.bar_ms % {DAY_MS} = a.day_ms),
r1 AS (SELECT *, CASE WHEN region = lag(region) OVER (PARTITION BY instrument, day_ms ORDER BY bar_ms) THEN 0 ELSE 1 END AS new FROM rg),
r2 AS (SELECT *, sum(new) OVER (PARTITION BY instrument, day_ms ORDER BY bar_ms ROWS UNBOUNDED PRECEDING) AS run FROM r1),
sa AS (SELECT instrument, day_ms, bar_ms, region, CASE WHEN region = 'inside' THEN 'balance' WHEN row_number() OVER (PARTITION BY instrument, day_ms, run ORDER BY bar_ms) >= {CLOSES} THEN 'accepted' ELSE 'probe' END AS state FROM r2),
tr AS (SELECT instrument, bar_ms, was, state, CASE WHEN was = 'probe' AND state = 'balance' THEN 'failed_auction' WHEN state = 'accepted' THEN 'breakout_acceptance' WHEN was = 'accepted' AND state = 'balance' THEN 'failed_reclaim' ELSE 'probe' END AS fact
  FROM (SELECT *, lag(state) OVER (PARTITION BY instrument, day_ms ORDER BY bar_ms) AS was FROM sa) WHERE was <> state)"""

SQL = {
    "l1_level_registry": f"{LV} SELECT * FROM lv",
    "l2_in_zone": f"{LV} SELECT instrument, kind, count(*) AS n, count(*) FILTER (WHERE in_zone) AS n_in FROM zn GROUP BY 1, 2",
    "l3_visits": f"""{LV}, v AS (SELECT *, coalesce(lag(in_zone) OVER (PARTITION BY instrument, kind, valid_from, low, high ORDER BY bar_ms), false) AS was FROM zn)
      SELECT instrument, kind, low, high, valid_from, bar_ms, CASE WHEN in_zone THEN 'enter' ELSE 'leave' END AS event, CAST(sum(CASE WHEN in_zone THEN 1 ELSE 0 END) OVER (PARTITION BY instrument, kind, valid_from, low, high ORDER BY bar_ms ROWS UNBOUNDED PRECEDING) AS BIGINT) AS touches FROM v WHERE was <> in_zone""",
    "l4_nearest_levels": f"""{LV}, x AS (SELECT *, CASE WHEN close < low THEN low - close WHEN close > high THEN high - close ELSE 0 END AS distance FROM ac)
      SELECT instrument, bar_ms, CAST(row_number() OVER (PARTITION BY instrument, bar_ms ORDER BY abs(distance), kind, valid_from, low, high) AS INTEGER) AS rank, kind, distance FROM x QUALIFY rank <= 3""",
    "l5_confluence": f"""{LV}, k AS (SELECT DISTINCT instrument, kind, low, high, valid_from FROM lv) SELECT k.*, (SELECT count(DISTINCT o.kind) FROM lv o WHERE o.instrument = k.instrument AND o.kind <> k.kind AND abs(o.low - k.low) <= {WIDTH} AND o.valid_from <= k.valid_from AND (o.valid_to IS NULL OR o.valid_to > k.valid_from)) AS confluence FROM k""",
    "c1_swing_anchors": f"{AN} SELECT * FROM an",
    "c2_cvd_divergence": f"{AN} SELECT * FROM dv",
    "c4_effort_result": f"{EF} SELECT * FROM ef",
    "c5_rising_edges": f"{EF} SELECT instrument, bar_ms FROM (SELECT *, coalesce(lag(active) OVER (PARTITION BY instrument ORDER BY bar_ms), false) AS was FROM ef WHERE active IS NOT NULL) WHERE active AND NOT was",
    "c6_exhaustion": f"""{EF}, b AS (SELECT instrument, bar_ms, close, max(high) OVER w AS hi, min(low) OVER w AS lo FROM dense WINDOW w AS (PARTITION BY instrument ORDER BY bar_ms ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))
      SELECT b.instrument, b.bar_ms, CASE WHEN abs(b.close - hi) * 10000 <= hi * 2000 THEN 'high' ELSE 'low' END AS side FROM b JOIN ef ON ef.instrument = b.instrument AND ef.bar_ms + {H} = b.bar_ms JOIN ww ON ww.instrument = b.instrument AND ww.bar_ms = b.bar_ms
      WHERE b.close IS NOT NULL AND effort >= effort_high AND move > move_median AND w_volume < effort AND (abs(b.close - hi) * 10000 <= hi * 2000 OR abs(b.close - lo) * 10000 <= lo * 2000)""",
    "t6_bias_steps": f"{SW} SELECT instrument, side, bar_ms, known_bar_ms, CASE WHEN price > p THEN 'higher' WHEN price < p THEN 'lower' ELSE 'equal' END AS step FROM (SELECT *, lag(price) OVER (PARTITION BY instrument, side ORDER BY bar_ms) AS p FROM sw) WHERE p IS NOT NULL",
}
