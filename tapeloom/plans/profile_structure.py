"""Registered queries: volume profiles, VWAP, swings and sweeps."""

from __future__ import annotations

from tapeloom.operators import profile as P
from tapeloom.operators import structure as S
from tapeloom.plans.bars_flow import DENSE, covered
from tapeloom.plans.tape_sql import TAPE
from tapeloom.sources.tape import DAY_MS, HOUR_MS, trades

BIN = 1_000_000_000


def hist(s, d):
    return P.histogram(trades(s, d), BIN)


def dense(s, d):
    return P.dense_histogram(hist(s, d))


def swept(s, d):
    b = covered(s, d)
    return S.sweeps(b, S.swings(b))


def outcomes(s, d):
    return S.sweep_outcomes(covered(s, d), swept(s, d))


QUERIES = {
    "p1_histogram": hist,
    "p2_dense_histogram": dense,
    "p3_point_of_control": lambda s, d: P.point_of_control(hist(s, d)),
    "p4_value_area": lambda s, d: P.value_area(dense(s, d)),
    "p5_smoothed": lambda s, d: P.smoothed(dense(s, d)),
    "p6_nodes": lambda s, d: P.nodes(P.smoothed(dense(s, d))),
    "p7_prior_day": lambda s, d: P.prior_day(P.point_of_control(hist(s, d))).select("instrument", "day_ms", "poc", "low_bin", "high_bin"),
    "p8_composite_5d": lambda s, d: P.composite(hist(s, d), 5),
    "p8_composite_7d": lambda s, d: P.composite(hist(s, d), 7),
    "p9_developing_profile": lambda s, d: P.developing_profile(trades(s, d), BIN, HOUR_MS),
    "p10_profile_levels": lambda s, d: P.levels(P.value_area(dense(s, d)), BIN),
    "p11_profile_finer_bins": lambda s, d: P.value_area(P.dense_histogram(P.histogram(trades(s, d), BIN // 4), max_bins=5000), area=0.5),
    "p12_session_vwap": lambda s, d: P.session_vwap(trades(s, d)),
    "s1_swings": lambda s, d: S.swings(covered(s, d)),
    "s2_last_swings": lambda s, d: S.last_swings(covered(s, d), S.swings(covered(s, d))),
    "s3_touches": lambda s, d: S.touches(covered(s, d), swept(s, d), 200).select("instrument", "side", "bar_ms", "n_touches"),
    "s4_sweeps": lambda s, d: swept(s, d).select("instrument", "side", "bar_ms", "swept_bar_ms"),
    "s5_sweep_outcomes": outcomes,
    "s6_capped_registry": lambda s, d: S.capped_registry(swept(s, d), 5),
    "s7_level_rows": lambda s, d: S.level_rows(swept(s, d), outcomes(s, d)),
}

H = f"h AS (SELECT instrument, ts_ms - ts_ms % {DAY_MS} AS day_ms, price // {BIN} AS bin, CAST(sum(qty) AS BIGINT) AS qty FROM trades GROUP BY 1, 2, 3)"
D = f"""WITH {TAPE}, {H}, sp AS (SELECT instrument, day_ms, min(bin) AS lo, max(bin) AS hi FROM h GROUP BY 1, 2),
dn AS (SELECT g.instrument, g.day_ms, g.bin, coalesce(h.qty, 0) AS qty FROM (SELECT instrument, day_ms, unnest(range(lo, hi + 1)) AS bin FROM sp WHERE hi - lo < 10000) g LEFT JOIN h USING (instrument, day_ms, bin))"""
POC = """, o AS (SELECT h.*, sp.lo, sp.hi FROM h JOIN sp USING (instrument, day_ms)),
poc AS (SELECT instrument, day_ms, first(bin ORDER BY qty DESC, abs(2 * bin - lo - hi), bin) AS poc, max(qty) AS poc_qty, CAST(sum(qty) AS BIGINT) AS total, min(bin) AS low_bin, max(bin) AS high_bin FROM o GROUP BY 1, 2)"""
SW = f"""{DENSE}, nb AS (SELECT * FROM dense WHERE close IS NOT NULL),
f AS (SELECT *, lead(bar_ms, 3) OVER w AS known_bar_ms, lag(bar_ms, 3) OVER w AS b3, max(high) OVER l AS lh, max(high) OVER r AS rh, min(low) OVER l AS ll, min(low) OVER r AS rl FROM nb
  WINDOW w AS (PARTITION BY instrument ORDER BY bar_ms), l AS (PARTITION BY instrument ORDER BY bar_ms ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), r AS (PARTITION BY instrument ORDER BY bar_ms ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)),
sw AS (SELECT instrument, bar_ms, 'high' AS side, high AS price, known_bar_ms FROM f WHERE b3 IS NOT NULL AND known_bar_ms IS NOT NULL AND high > lh AND high >= rh
  UNION ALL SELECT instrument, bar_ms, 'low', low, known_bar_ms FROM f WHERE b3 IS NOT NULL AND known_bar_ms IS NOT NULL AND low < ll AND low <= rl),
st AS (SELECT s.instrument, s.side, s.bar_ms, s.price, s.known_bar_ms, min(n.bar_ms) AS swept_bar_ms FROM sw s LEFT JOIN nb n ON n.instrument = s.instrument AND n.bar_ms > s.known_bar_ms
  AND ((s.side = 'high' AND n.high > s.price) OR (s.side = 'low' AND n.low < s.price)) GROUP BY 1, 2, 3, 4, 5),
nx AS (SELECT *, lead(close, 1) OVER w AS c1, lead(close, 2) OVER w AS c2, max(high) OVER (w ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS hi, min(low) OVER (w ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS lo FROM nb WINDOW w AS (PARTITION BY instrument ORDER BY bar_ms)),
so AS (SELECT st.instrument, side, st.bar_ms, price, swept_bar_ms, CASE WHEN side = 'high' AND (close <= price OR c1 <= price OR c2 <= price) OR side = 'low' AND (close >= price OR c1 >= price OR c2 >= price) THEN 'failure' WHEN c2 IS NOT NULL THEN 'break' ELSE 'open' END AS outcome,
  CASE WHEN side = 'high' THEN hi ELSE lo END AS extreme FROM st JOIN nx ON nx.instrument = st.instrument AND nx.bar_ms = st.swept_bar_ms)"""


def _composite(n: int) -> str:
    return f"""WITH {TAPE}, {H}, a AS (SELECT instrument, min(day_ms) AS a, max(day_ms) AS b FROM h GROUP BY 1),
    t AS (SELECT h.instrument, day_ms + k * {DAY_MS} AS day_ms, bin, qty FROM h, range(1, {n + 1}) r(k))
    SELECT t.instrument, t.day_ms, bin, CAST(sum(qty) AS BIGINT) AS qty FROM t JOIN a USING (instrument) WHERE t.day_ms >= a + {n * DAY_MS} AND t.day_ms <= b + {DAY_MS} GROUP BY 1, 2, 3"""


SQL = {
    "p1_histogram": f"WITH {TAPE}, {H} SELECT * FROM h",
    "p2_dense_histogram": f"{D} SELECT * FROM dn",
    "p3_point_of_control": f"{D}{POC} SELECT * FROM poc",
    "p5_smoothed": f"""{D} SELECT *, lag(qty, 2, 0) OVER w + 2 * lag(qty, 1, 0) OVER w + 3 * qty + 2 * lead(qty, 1, 0) OVER w + lead(qty, 2, 0) OVER w AS smooth FROM dn WINDOW w AS (PARTITION BY instrument, day_ms ORDER BY bin)""",
    "p7_prior_day": f"{D}{POC} SELECT instrument, day_ms + {DAY_MS} AS day_ms, poc, low_bin, high_bin FROM poc",
    "p8_composite_5d": _composite(5),
    "p8_composite_7d": _composite(7),
    "p9_developing_profile": f"""WITH {TAPE}, s AS (SELECT DISTINCT instrument, ts_ms - ts_ms % {DAY_MS} AS day_ms, ts_ms - ts_ms % {HOUR_MS} AS step_ms FROM trades),
      c AS (SELECT s.instrument, s.day_ms, s.step_ms, t.price // {BIN} AS bin, CAST(sum(t.qty) AS BIGINT) AS qty FROM s JOIN trades t ON t.instrument = s.instrument AND t.ts_ms >= s.day_ms AND t.ts_ms < s.step_ms + {HOUR_MS} GROUP BY 1, 2, 3, 4)
      SELECT instrument, day_ms, step_ms, first(bin ORDER BY qty DESC, bin) AS poc, max(qty) AS poc_qty FROM c GROUP BY 1, 2, 3""",
    "p12_session_vwap": f"""WITH {TAPE}, m AS (SELECT instrument, ts_ms - ts_ms % {DAY_MS} AS day_ms, ts_ms - ts_ms % 60000 AS step_ms, sum(price::HUGEINT * qty) AS n, sum(qty) AS q FROM trades GROUP BY 1, 2, 3)
      SELECT instrument, day_ms, step_ms, CAST(sum(n) OVER w // sum(q) OVER w AS BIGINT) AS vwap FROM m WINDOW w AS (PARTITION BY instrument, day_ms ORDER BY step_ms ROWS UNBOUNDED PRECEDING)""",
    "s1_swings": f"{SW} SELECT * FROM sw",
    "s2_last_swings": f"""{SW}, k AS (SELECT instrument, known_bar_ms AS bar_ms, last(price ORDER BY bar_ms) FILTER (WHERE side = 'high') AS h, last(price ORDER BY bar_ms) FILTER (WHERE side = 'low') AS l FROM sw GROUP BY 1, 2)
      SELECT d.instrument, d.bar_ms, last_value(h IGNORE NULLS) OVER w AS last_high, last_value(l IGNORE NULLS) OVER w AS last_low FROM dense d LEFT JOIN k ON k.instrument = d.instrument AND k.bar_ms = d.bar_ms WINDOW w AS (PARTITION BY d.instrument ORDER BY d.bar_ms ROWS UNBOUNDED PRECEDING)""",
    "s3_touches": f"""{SW} SELECT st.instrument, st.side, st.bar_ms, count(n.bar_ms) AS n_touches FROM st LEFT JOIN nb n ON n.instrument = st.instrument AND n.bar_ms > known_bar_ms AND (swept_bar_ms IS NULL OR n.bar_ms < swept_bar_ms)
      AND ((side = 'high' AND n.high <= price AND (price - n.high) * 10000 <= price * 200) OR (side = 'low' AND n.low >= price AND (n.low - price) * 10000 <= price * 200)) GROUP BY 1, 2, 3""",
    "s4_sweeps": f"{SW} SELECT instrument, side, bar_ms, swept_bar_ms FROM st",
    "s5_sweep_outcomes": f"{SW} SELECT * FROM so",
    "s7_level_rows": f"""{SW} SELECT instrument, 'structural_' || side AS kind, price AS low, price AS high, known_bar_ms AS valid_from, swept_bar_ms AS valid_to FROM st
      UNION ALL SELECT instrument, 'prior_sweep', extreme, extreme, swept_bar_ms, NULL FROM so
      UNION ALL SELECT instrument, 'sfp_zone', least(price, extreme), greatest(price, extreme), swept_bar_ms, NULL FROM so WHERE outcome = 'failure'""",
}
