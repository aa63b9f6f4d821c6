"""Registered queries: the auction of each day against the value area of the day before, on minute bars, and value areas in SQL."""

from __future__ import annotations

from tapeloom.functions.tables import kept
from tapeloom.operators import auction as A
from tapeloom.operators import bars as B
from tapeloom.operators import location as L
from tapeloom.operators import profile as P
from tapeloom.plans import profile_structure as PS
from tapeloom.plans.profile_structure import BIN
from tapeloom.plans.tape_sql import TAPE, bars
from tapeloom.sources.tape import DAY_MS, MINUTE_MS, trades

TOL, CLOSES = A.TOLERANCE_BPS, A.CLOSES


@kept
def minute_bars(s, d):
    return B.time_bars(trades(s, d), MINUTE_MS)


@kept
def references(s, d):
    return A.references(P.value_area(PS.dense(s, d)), BIN)


@kept
def statuses(s, d):
    return A.statuses(minute_bars(s, d), references(s, d))


def triggers(s, d):
    return A.triggers(A.transitions(statuses(s, d)))


def guides(s, d):
    refs = references(s, d)
    visits = L.visits(L.in_zone(minute_bars(s, d), A.edge_levels(refs), TOL))
    return A.guides(visits, statuses(s, d), refs)


QUERIES = {
    "l7_auction_state": statuses,
    "l8_auction_transitions": lambda s, d: A.transitions(statuses(s, d)),
    "l9_valid_reference": references,
    "t1_auction_triggers": triggers,
    "g2_guide_prices": guides,
    "g3_confirmations": lambda s, d: triggers(s, d).select("instrument", "bar_ms", "trigger", "side"),
}


def value_areas(bin_size: int, max_bins: int, tenths: int) -> str:
    """Value areas by growing all sessions one step at a time from their points of control."""
    return f"""WITH RECURSIVE {TAPE},
h AS (SELECT instrument, ts_ms - ts_ms % {DAY_MS} AS day_ms, price // {bin_size} AS bin, CAST(sum(qty) AS BIGINT) AS qty FROM trades GROUP BY 1, 2, 3),
sp AS (SELECT instrument, day_ms, min(bin) AS a, max(bin) AS b, CAST(sum(qty) AS BIGINT) AS total FROM h GROUP BY 1, 2 HAVING max(bin) - min(bin) < {max_bins}),
pc AS (SELECT instrument, day_ms, a, b, total, first(bin ORDER BY qty DESC, abs(2 * bin - a - b), bin) AS poc, max(qty) AS held FROM h JOIN sp USING (instrument, day_ms) GROUP BY ALL),
gr AS (SELECT instrument, day_ms, a, b, total, poc, poc AS lo, poc AS hi, held FROM pc UNION ALL
  SELECT instrument, day_ms, a, b, total, poc, CASE WHEN dn >= up THEN lo - 1 ELSE lo END, CASE WHEN up >= dn THEN hi + 1 ELSE hi END, held + CASE WHEN dn >= up THEN dn ELSE 0 END + CASE WHEN up >= dn THEN up ELSE 0 END
  FROM (SELECT g.*, CASE WHEN lo > a THEN coalesce(x.qty, 0) ELSE -1 END AS dn, CASE WHEN hi < b THEN coalesce(y.qty, 0) ELSE -1 END AS up FROM gr g
    LEFT JOIN h x ON x.instrument = g.instrument AND x.day_ms = g.day_ms AND x.bin = g.lo - 1 LEFT JOIN h y ON y.instrument = g.instrument AND y.day_ms = g.day_ms AND y.bin = g.hi + 1
    WHERE g.held * 10 < g.total * {tenths})),
va AS (SELECT instrument, day_ms, poc, lo AS val, hi AS vah, held AS area_qty, total FROM gr WHERE held * 10 >= total * {tenths})"""


# one close at a time, all days together; regions are -1, 0, 1, no probe or failure is null
ST = f"""{value_areas(BIN, 10_000, 7)},
rf AS (SELECT instrument, day_ms + {DAY_MS} AS day_ms, val * {BIN} AS val, (vah + 1) * {BIN} AS vah, (vah + 1 - val) * {BIN} * 10000 > ((vah + 1) + abs(val)) * {BIN} * {TOL} AS valid FROM va),
{bars(MINUTE_MS, "mb")},
mc AS (SELECT m.instrument, r.day_ms, m.bar_ms, m.high, m.low, m.close, r.val, r.vah, row_number() OVER (PARTITION BY m.instrument, r.day_ms ORDER BY m.bar_ms) AS rn,
  CASE WHEN close >= vah THEN 1 WHEN close < val THEN -1 ELSE 0 END AS s,
  CASE WHEN (close - vah) * 10000 > vah * {TOL} THEN 'above' WHEN (vah - close) * 10000 <= vah * {TOL} THEN 'high_edge' WHEN (val - close) * 10000 > val * {TOL} THEN 'below' WHEN (close - val) * 10000 <= val * {TOL} THEN 'low_edge' ELSE 'in' END AS position
  FROM mb m JOIN rf r ON r.instrument = m.instrument AND r.day_ms = m.bar_ms - m.bar_ms % {DAY_MS} WHERE r.valid),
cl AS (SELECT *, bar_ms + {MINUTE_MS} AS e, CASE position WHEN 'above' THEN 1 WHEN 'below' THEN -1 WHEN 'in' THEN 0 END AS r FROM mc),
au AS (SELECT instrument, day_ms, rn, s AS acc, true AS start, NULL::INTEGER AS p, NULL::BIGINT AS pt, NULL::BIGINT AS pn, NULL::INTEGER AS f, NULL::BIGINT AS fn, NULL::BIGINT AS ft, NULL::BIGINT AS bk FROM cl WHERE rn = 1 UNION ALL
  SELECT instrument, day_ms, rn, CASE WHEN p1n >= {CLOSES} THEN p1 ELSE acc END, start AND coalesce(p1n < {CLOSES}, true), CASE WHEN p1n < {CLOSES} THEN p1 END, CASE WHEN p1n < {CLOSES} THEN p1t END, CASE WHEN p1n < {CLOSES} THEN p1n END,
    CASE WHEN b1 < {CLOSES} THEN f1 END, CASE WHEN b1 < {CLOSES} THEN f1n END, CASE WHEN b1 < {CLOSES} THEN f1t END, CASE WHEN b1 < {CLOSES} THEN b1 END
  FROM (SELECT instrument, day_ms, rn, acc, start, p1, p1t, p1n, CASE WHEN p1 IS NULL THEN CASE WHEN fails THEN p ELSE f END END AS f1, CASE WHEN p1 IS NULL THEN CASE WHEN fails THEN pn ELSE fn END END AS f1n,
      CASE WHEN p1 IS NULL THEN CASE WHEN fails THEN e ELSE ft END END AS f1t, CASE WHEN p1 IS NULL THEN CASE WHEN fails THEN 1 ELSE bk + CAST(s = acc AS INTEGER) END END AS b1
    FROM (SELECT c.instrument, c.day_ms, c.rn, c.e, c.s, a.acc, a.start, a.p, a.pn, a.f, a.fn, a.ft, a.bk, a.p IS NOT NULL AND coalesce(c.r = a.acc, false) AS fails,
        CASE WHEN c.r IS NULL THEN a.p WHEN c.r <> a.acc THEN c.r END AS p1,
        CASE WHEN c.r IS NULL OR c.r = a.p THEN a.pt WHEN c.r <> a.acc THEN c.e END AS p1t,
        CASE WHEN c.r IS NULL OR c.r = a.p THEN a.pn + CAST(c.s = a.p AS INTEGER) WHEN c.r <> a.acc THEN 1 END AS p1n
      FROM au a JOIN cl c ON c.instrument = a.instrument AND c.day_ms = a.day_ms AND c.rn = a.rn + 1))),
nm AS (SELECT * FROM (VALUES (-1, 'below'), (0, 'in'), (1, 'above')) t(k, name)),
st AS (SELECT c.instrument, c.day_ms, c.bar_ms, c.close, c.position, n.name AS accepted, CASE WHEN a.start THEN 'start' ELSE 'acceptance' END AS origin,
  CASE WHEN p <> 0 THEN 'breakout' WHEN p IS NULL AND f = 0 THEN 'failed_reclaim' WHEN p IS NULL AND f <> 0 THEN 'failed_breakout' WHEN p = 0 OR acc = 0 THEN CASE WHEN r IS NULL THEN 'at_value_edge' ELSE 'inside_value' END WHEN a.start THEN 'outside_value' ELSE 'acceptance' END AS state,
  CASE WHEN p <> 0 THEN np.name WHEN p IS NULL AND f = 0 THEN n.name WHEN p IS NULL AND f <> 0 THEN nf.name WHEN p = 0 OR acc = 0 THEN CASE position WHEN 'high_edge' THEN 'above' WHEN 'low_edge' THEN 'below' END ELSE n.name END AS side,
  np.name AS probe_toward, pt AS probe_since_ms, pn AS probe_closes, nf.name AS failed_toward, fn AS failed_closes, ft AS failed_at_ms, bk AS closes_back
  FROM au a JOIN cl c USING (instrument, day_ms, rn) JOIN nm n ON n.k = a.acc LEFT JOIN nm np ON np.k = a.p LEFT JOIN nm nf ON nf.k = a.f),
tr AS (SELECT instrument, day_ms, bar_ms, was, state, side, accepted, position, close FROM (SELECT *, lag(state) OVER (PARTITION BY instrument, day_ms ORDER BY bar_ms) AS was FROM st) WHERE was IS DISTINCT FROM state),
tg AS (SELECT instrument, day_ms, bar_ms, CASE state WHEN 'failed_breakout' THEN 'failed_auction' WHEN 'failed_reclaim' THEN 'failed_reclaim' ELSE 'breakout_acceptance' END AS trigger, side, close FROM tr
  WHERE state LIKE 'failed%' OR (state = 'acceptance' AND was = 'breakout')),
zn AS (SELECT instrument, day_ms, bar_ms, edge, val, vah, (x - high) * 10000 <= x * {TOL} AND (low - x) * 10000 <= x * {TOL} AS met FROM (SELECT *, unnest(['vah', 'val']) AS edge, unnest([vah, val]) AS x FROM mc)),
en AS (SELECT *, row_number() OVER (PARTITION BY instrument, day_ms, edge ORDER BY bar_ms) AS touches FROM
  (SELECT *, lag(met, 1, false) OVER (PARTITION BY instrument, day_ms, edge ORDER BY bar_ms) AS before FROM zn) WHERE met AND NOT before)"""

SQL = {
    "p4_value_area": f"{value_areas(BIN, 10_000, 7)} SELECT * FROM va",
    "p10_profile_levels": f"""{value_areas(BIN, 10_000, 7)}, k AS (SELECT instrument, day_ms, unnest(['poc', 'vah', 'val']) AS kind, unnest([poc, vah, val]) * {BIN} AS low FROM va)
      SELECT instrument, day_ms, kind, low + {BIN // 2} AS price, low, low + {BIN} AS high FROM k""",
    "p11_profile_finer_bins": f"{value_areas(BIN // 4, 5000, 5)} SELECT * FROM va",
    "l7_auction_state": f"{ST} SELECT * FROM st",
    "l8_auction_transitions": f"{ST} SELECT * FROM tr",
    "l9_valid_reference": f"{ST} SELECT * FROM rf",
    "t1_auction_triggers": f"{ST} SELECT * FROM tg",
    "g2_guide_prices": f"""{ST}, g AS (SELECT en.*, st.accepted, CASE WHEN (edge = 'vah') = (st.accepted = 'above') AND (edge = 'val') = (st.accepted = 'below') THEN 'in' WHEN edge = 'vah' THEN 'above' ELSE 'below' END AS toward,
        vah * {TOL} // 10000 AS vw, val * {TOL} // 10000 AS lw FROM en JOIN st USING (instrument, day_ms, bar_ms)),
      k AS (SELECT *, map(['above', 'in', 'below'], [vah + vw + 1, val + lw + 1, NULL]) AS fr, map(['above', 'in', 'below'], [NULL, vah - vw, val - lw]) AS be FROM g)
      SELECT instrument, day_ms, bar_ms, edge, touches, val, vah, accepted, toward, fr[toward] AS starts_from, be[toward] AS starts_below,
        map(['above', 'in', 'below'], [vah, val, NULL])[toward] AS counts_from, map(['above', 'in', 'below'], [NULL, vah, val])[toward] AS counts_below, fr[accepted] AS fails_from, be[accepted] AS fails_below,
        CASE WHEN toward = 'in' THEN 'failed_reclaim' ELSE 'failed_auction' END AS failure, CASE WHEN toward <> 'in' THEN 'breakout_acceptance' END AS acceptance, {CLOSES} AS closes FROM k""",
    "g3_confirmations": f"{ST} SELECT instrument, bar_ms, trigger, side FROM tg",
}
