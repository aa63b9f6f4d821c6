"""Registered queries: what stood around an anchor, alerts, and snapshots against the diffs of a book."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.operators import book as K
from tapeloom.operators import location as L
from tapeloom.plans import location_triggers as T
from tapeloom.plans.location_triggers import AN, LV, PAD
from tapeloom.plans.tape_sql import TAPE
from tapeloom.sources.tape import DAY_MS, raw_tape

PRIOR, SINCE = ["prior_high", "prior_low"], 19_735 * DAY_MS


def samples(s, d):
    """Views as open interest samples; of one time, the one with the largest id."""
    t = raw_tape(s, d).where("event_type = 'view'")
    return t.groupBy("instrument", "ts_ms").agg(F.max_by("price", "trade_id").alias("open_interest"))


def aligned(s, d):
    """Trades as diffs over the ids 4 n to 4 n + 2, feed errors as snapshots at 4 n + 1, sometimes beyond the id that a diff covers."""
    t = raw_tape(s, d)
    diffs = t.where("event_type <> 'error'").select("instrument", (F.col("trade_id") * 4).alias("first_id"), (F.col("trade_id") * 4 + 2).alias("last_id"))
    far = F.when(F.col("qty") % 2 == 0, F.col("trade_id") * 4 + 1).otherwise((F.col("trade_id") + 1) * 4 + 1)
    return K.align_snapshots(t.where("event_type = 'error'").select("instrument", far.alias("snapshot_id")), diffs)


QUERIES = {
    "c3_oi_divergence": lambda s, d: L.open_interest_divergences(T.anchored(s, d), samples(s, d)),
    "l6_anchor_context": lambda s, d: L.context(T.anchored(s, d), T.levels(s, d), PAD),
    "g1_zone_alerts": lambda s, d: L.zone_alerts(L.visits(T.zones(s, d)), PRIOR, SINCE),
    "k2_snapshot_alignment": aligned,
}

SQL = {
    "c3_oi_divergence": f"""{AN}, sm AS (SELECT instrument, ts_ms, arg_max(price, trade_id) AS oi FROM ev WHERE event_type = 'view' GROUP BY 1, 2),
      ao AS (SELECT an.*, sm.oi FROM an ASOF LEFT JOIN sm ON an.instrument = sm.instrument AND an.ts_ms >= sm.ts_ms),
      pr AS (SELECT *, lag(price) OVER w AS pp, lag(oi) OVER w AS po, lag(bar_ms) OVER w AS p_bar_ms FROM ao WINDOW w AS (PARTITION BY instrument, side ORDER BY bar_ms))
      SELECT instrument, side, bar_ms, p_bar_ms, known_bar_ms, price, oi - po AS oi_change FROM pr WHERE oi < po AND CASE WHEN side = 'high' THEN price > pp ELSE price < pp END""",
    "l6_anchor_context": f"""{LV}, {"cv AS" + AN.split("cv AS", 1)[1]}, hit AS (SELECT a.instrument, a.side, a.bar_ms, a.price, v.kind, v.low, v.valid_from FROM an a LEFT JOIN lv v ON v.instrument = a.instrument AND v.valid_from <= a.known_bar_ms AND (v.valid_to IS NULL OR v.valid_to > a.known_bar_ms)
        AND (v.low - a.price) * 10000 <= v.low * {PAD} AND (a.price - v.high) * 10000 <= v.low * {PAD} AND NOT (v.kind = 'structural_' || a.side AND v.low = a.price AND v.valid_from = a.known_bar_ms))
      SELECT instrument, side, bar_ms, price, count(kind) AS n_levels, coalesce(string_agg(kind || ':' || low || ':' || valid_from, ',' ORDER BY kind || ':' || low || ':' || valid_from), '') AS levels FROM hit GROUP BY 1, 2, 3, 4""",
    "g1_zone_alerts": f"""{LV}, v AS (SELECT *, coalesce(lag(in_zone) OVER w, false) AS was FROM zn WHERE kind LIKE 'prior%' WINDOW w AS (PARTITION BY instrument, kind, valid_from, low, high ORDER BY bar_ms)),
      c AS (SELECT instrument, kind, low, high, valid_from, bar_ms, CASE WHEN in_zone THEN 'enter' ELSE 'leave' END AS event, CAST(count(*) FILTER (WHERE in_zone) OVER (PARTITION BY instrument, kind, valid_from, low, high ORDER BY bar_ms ROWS UNBOUNDED PRECEDING) AS BIGINT) AS touches FROM v WHERE was <> in_zone)
      SELECT c.*, e.bar_ms AS entered_ms FROM c JOIN c e USING (instrument, kind, low, high, valid_from, touches) WHERE e.event = 'enter' AND e.bar_ms >= {SINCE}""",
    "k2_snapshot_alignment": f"""WITH {TAPE}, df AS (SELECT instrument, trade_id * 4 AS first_id, trade_id * 4 + 2 AS last_id FROM ev WHERE event_type <> 'error'),
      sn AS (SELECT instrument, CASE WHEN qty % 2 = 0 THEN trade_id * 4 + 1 ELSE trade_id * 4 + 5 END AS snapshot_id FROM ev WHERE event_type = 'error')
      SELECT sn.instrument, snapshot_id, first_id, last_id, CASE WHEN last_id IS NULL THEN 'waiting' WHEN first_id > snapshot_id THEN 'too_old' ELSE 'aligned' END AS state FROM sn ASOF LEFT JOIN df ON sn.instrument = df.instrument AND snapshot_id <= last_id""",
}
