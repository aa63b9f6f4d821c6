"""Registered queries: books from snapshots and liquidity flow on the generic tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions.tables import kept, written
from tapeloom.functions.timing import ID_WIDTH, lagged
from tapeloom.operators import liquidity as Q
from tapeloom.operators.book import books_at, level_life
from tapeloom.sources.tape import raw_tape

#: Prices lie TICK apart around MID, SIDE_LEVELS on each side; unit of the tape's prices that makes one level.
MID, TICK, SIDE_LEVELS, UNIT = 1_000_000, 20, 8, 10_000_000_000


def book_events(s, d):
    """Events as a book's stream: quantities that 3 divides are taker trades, the others changes of one level; 7 divides what removes it.

    Bids lie below the mid and asks above it by the event's value. Feed gaps break the chain of ids.
    """
    t = raw_tape(s, d)
    k = F.floor(F.col("price") / UNIT) % SIDE_LEVELS
    trade = F.col("qty") % 3 == 0
    buy = F.col("aggressor") == "buy"
    # a buy takes from asks, and as a change of the book it is a bid
    below = buy != trade
    price = F.when(below, MID - TICK * (k + 1)).otherwise(MID + TICK * k).cast("long")
    return t.select("instrument", F.col("trade_id").alias("seq"), "ts_ms", "aggressor", F.when(below, "bid").otherwise("ask").alias("side"), price.alias("price"), "qty", trade.alias("trade"), (F.col("event_type") == "error").alias("gap"))


@kept
def diffs(s, d):
    u = book_events(s, d).where("NOT trade AND NOT gap")
    u = written(lagged(u, ["instrument"], "seq", ["seq"], {"seq": "prev"}, ID_WIDTH), "lagged")
    gaps = book_events(s, d).where("gap").select("instrument", F.col("seq").alias("gap_seq"))
    u = Q.asof(u, gaps, ["instrument"], "seq", "gap_seq", {"gap_seq": "gap_seq"}, strict=True, width=ID_WIDTH)
    lost = F.coalesce(F.col("gap_seq") > F.col("prev"), F.lit(False)) & (F.col("gap_seq") % 5 == 0)
    qty = F.when(F.col("qty") % 7 == 0, 0).otherwise(F.col("qty"))
    return u.select("instrument", "seq", "ts_ms", "side", "price", qty.alias("qty"), F.when(lost, F.col("gap_seq")).otherwise(F.coalesce("prev", F.lit(-1))).alias("prev_id"))


@kept
def snapshots(s, d):
    """What the exchange's whole book holds after each event whose id ends in 50: the levels of all changes, whatever was lost on the way."""
    whole = level_life(diffs(s, d).withColumn("epoch", F.lit(0).cast("long")))
    at = book_events(s, d).where("NOT trade AND NOT gap AND seq % 100 = 50").select("instrument", F.col("seq").alias("at_seq"))
    return books_at(whole, at).select("instrument", F.col("at_seq").alias("snapshot_id"), "side", "price", "qty")


@kept
def epochs(s, d):
    return Q.snapshot_epochs(snapshots(s, d), diffs(s, d))


@kept
def states(s, d):
    return Q.epoch_states(snapshots(s, d), epochs(s, d))


@kept
def frames(s, d):
    return Q.frames_before(snapshots(s, d), epochs(s, d), states(s, d))


@kept
def flow(s, d):
    t = book_events(s, d).where("trade AND NOT gap").select("instrument", "seq", "price", "qty", "aggressor")
    return Q.liquidity_flow(frames(s, d), t, states(s, d))


def windows(s, d):
    e = epochs(s, d).join(states(s, d).where("state = 'aligned'").select("instrument", "epoch"), ["instrument", "epoch"], "left_semi")
    known = e.where("live").select("instrument", "seq")
    bad = diffs(s, d).join(known, ["instrument", "seq"], "left_anti")
    return Q.flow_windows(Q.flow_minutes(flow(s, d)), bad)


QUERIES = {
    "k1_seeded_levels": lambda s, d: Q.seeded_levels(snapshots(s, d), epochs(s, d), states(s, d)),
    "k2_snapshot_states": lambda s, d: states(s, d).select("instrument", "epoch", "state", "n_live", "end_seq"),
    "k3_trusted_windows": lambda s, d: states(s, d).where("state = 'aligned'").select("instrument", "epoch", "trusted_low", "trusted_high"),
    "k4_best_before": lambda s, d: frames(s, d).select("instrument", "epoch", "seq", "bid", "ask", "old"),
    "k8_liquidity_flow": flow,
    "k9_flow_windows": windows,
    "k8_flow_minutes": lambda s, d: Q.flow_minutes(flow(s, d)),
}

BOOK = f"""WITH RECURSIVE be AS (SELECT *, CASE WHEN below THEN 'bid' ELSE 'ask' END AS side, CASE WHEN below THEN {MID} - {TICK} * (k + 1) ELSE {MID} + {TICK} * k END AS price FROM
  (SELECT user_id % 4 AS instrument, event_id AS seq, epoch_us(ts) // 1000 AS ts_ms, q AS qty, q % 3 = 0 AS trade, event_type = 'error' AS gap, CAST(round(value * 100000000) AS BIGINT) // {UNIT} % {SIDE_LEVELS} AS k,
    (event_type IN ('purchase', 'click', 'signup')) <> (q % 3 = 0) AS below FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS q FROM events))),
d0 AS (SELECT *, lag(seq) OVER (PARTITION BY instrument ORDER BY seq) AS prev FROM be WHERE NOT trade AND NOT gap),
df AS (SELECT instrument, seq, ts_ms, side, price, CASE WHEN qty % 7 = 0 THEN 0 ELSE qty END AS qty, CASE WHEN g > prev AND g % 5 = 0 THEN g ELSE coalesce(prev, -1) END AS prev_id
  FROM (SELECT d0.*, (SELECT max(b.seq) FROM be b WHERE b.gap AND b.instrument = d0.instrument AND b.seq < d0.seq) AS g FROM d0)),
sn AS (SELECT a.instrument, a.seq AS snapshot_id, b.side, b.price, arg_max(b.qty, b.seq) AS qty FROM df a JOIN df b ON a.instrument = b.instrument AND b.seq <= a.seq WHERE a.seq % 100 = 50 GROUP BY 1, 2, 3, 4 HAVING arg_max(b.qty, b.seq) > 0),
ep AS (SELECT *, sum(bad) OVER (PARTITION BY instrument, epoch ORDER BY seq) = 0 AS live FROM (SELECT *, CASE WHEN lag(seq) OVER w IS NULL THEN prev_id > epoch ELSE prev_id <> lag(seq) OVER w END::INT AS bad
  FROM (SELECT df.*, (SELECT max(snapshot_id) FROM sn WHERE sn.instrument = df.instrument AND snapshot_id < df.seq) AS epoch FROM df) WHERE epoch IS NOT NULL WINDOW w AS (PARTITION BY instrument, epoch ORDER BY seq))),
ws AS (SELECT *, lead(epoch) OVER (PARTITION BY instrument ORDER BY epoch) AS nxt FROM (SELECT instrument, snapshot_id AS epoch, min(price) FILTER (WHERE side = 'bid') AS trusted_low, max(price) FILTER (WHERE side = 'ask') AS trusted_high FROM sn GROUP BY 1, 2)),
es AS (SELECT w.instrument, w.epoch, CASE WHEN m IS NULL THEN 'waiting' WHEN fl THEN 'aligned' ELSE 'too_old' END AS state, coalesce(nl, 0) AS n_live, coalesce(br, nxt + 1, m + 1, w.epoch + 1) AS end_seq, trusted_low, trusted_high
  FROM ws w LEFT JOIN (SELECT instrument, epoch, count(*) FILTER (WHERE live) AS nl, min(seq) FILTER (WHERE NOT live) AS br, max(seq) AS m, arg_min(live, seq) AS fl FROM ep GROUP BY 1, 2) USING (instrument, epoch)),
lv AS (SELECT *, lead(seq) OVER (PARTITION BY instrument, epoch, side, price ORDER BY seq) AS nx FROM (SELECT instrument, snapshot_id AS epoch, snapshot_id AS seq, side, price, qty FROM sn UNION ALL SELECT instrument, epoch, seq, side, price, qty FROM ep WHERE live) JOIN es USING (instrument, epoch) WHERE state = 'aligned'),
sl AS (SELECT instrument, epoch, side, price, qty, seq AS valid_from, coalesce(nx, end_seq) AS valid_to FROM lv WHERE qty > 0)"""
FRAMES = f"""{BOOK}, fr AS (SELECT e.instrument, e.epoch, e.seq, e.ts_ms, e.side, e.price, e.qty, max(s.price) FILTER (WHERE s.side = 'bid') AS bid, min(s.price) FILTER (WHERE s.side = 'ask') AS ask, coalesce(max(s.qty) FILTER (WHERE s.side = e.side AND s.price = e.price), 0) AS old,
  row_number() OVER (PARTITION BY e.instrument, e.epoch ORDER BY e.seq) AS step FROM (SELECT ep.* FROM ep JOIN es USING (instrument, epoch) WHERE live AND state = 'aligned') e
  LEFT JOIN sl s ON s.instrument = e.instrument AND s.epoch = e.epoch AND s.valid_from < e.seq AND s.valid_to >= e.seq GROUP BY 1, 2, 3, 4, 5, 6, 7)"""
FLOW = f"""{FRAMES}, pt AS (SELECT b.instrument, es.epoch, b.side, b.price, b.qty, (SELECT min(step) FROM fr WHERE fr.instrument = b.instrument AND fr.epoch = es.epoch AND fr.seq > b.seq) AS step
  FROM be b JOIN es ON es.instrument = b.instrument AND b.seq > es.epoch AND b.seq < es.end_seq AND es.epoch = (SELECT max(epoch) FROM es x WHERE x.instrument = b.instrument AND x.epoch < b.seq) WHERE b.trade AND NOT b.gap),
pf AS (SELECT instrument, epoch, side, price, step, CAST(sum(qty) AS BIGINT) AS fresh FROM pt WHERE step IS NOT NULL GROUP BY ALL),
lx AS (SELECT DISTINCT instrument, epoch, side, price FROM (SELECT instrument, epoch, side, price FROM pf UNION ALL SELECT instrument, epoch, side, price FROM fr)),
gr AS (SELECT l.instrument, l.epoch, l.side, l.price, f.step, f.seq, f.ts_ms, f.bid + f.ask AS m, coalesce(fresh, 0) AS fresh, CASE WHEN f.side = l.side AND f.price = l.price THEN f.qty - f.old ELSE 0 END AS delta,
    coalesce(f.bid < f.ask AND abs(f.bid + f.ask - 2 * l.price) * 10000 <= {max(Q.BANDS_BPS)} * (f.bid + f.ask) AND l.price BETWEEN trusted_low AND trusted_high, false) AS near
  FROM lx l JOIN fr f USING (instrument, epoch) JOIN es USING (instrument, epoch) LEFT JOIN pf ON pf.instrument = l.instrument AND pf.epoch = l.epoch AND pf.side = l.side AND pf.price = l.price AND pf.step = f.step),
rc AS (SELECT gr.*, CAST(0 AS BIGINT) AS carried FROM gr WHERE step = 1 UNION ALL SELECT gr.*, greatest(0, least(rc.fresh, rc.carried + rc.fresh - CASE WHEN rc.near THEN greatest(0, -rc.delta) ELSE 0 END))
  FROM rc JOIN gr ON gr.instrument = rc.instrument AND gr.epoch = rc.epoch AND gr.side = rc.side AND gr.price = rc.price AND gr.step = rc.step + 1),
fw AS (SELECT *, greatest(0, -delta) AS removed, least(greatest(0, -delta), carried + fresh) AS matched, carried - least(carried, greatest(0, -delta)) AS unmatched FROM rc WHERE near),
fo AS (SELECT instrument, epoch, side, price, seq, ts_ms, band, greatest(0, delta) + unmatched AS added, removed - matched AS cancelled, matched + unmatched AS filled, unmatched AS inferred
  FROM fw, (VALUES {', '.join(f'({b})' for b in Q.BANDS_BPS)}) v(band) WHERE abs(m - 2 * price) * 10000 <= band * m AND (delta <> 0 OR unmatched > 0))"""
SQL = {
    "k1_seeded_levels": f"{BOOK} SELECT * FROM sl",
    "k2_snapshot_states": f"{BOOK} SELECT instrument, epoch, state, n_live, end_seq FROM es",
    "k3_trusted_windows": f"{BOOK} SELECT instrument, epoch, trusted_low, trusted_high FROM es WHERE state = 'aligned'",
    "k4_best_before": f"{FRAMES} SELECT instrument, epoch, seq, bid, ask, old FROM fr",
    "k8_liquidity_flow": f"{FLOW} SELECT * FROM fo",
    "k9_flow_windows": f"""{FLOW}, mi AS (SELECT instrument, ts_ms - ts_ms % 60000 AS m, side, band, sum(added) AS added, sum(cancelled) AS cancelled, sum(filled) AS filled, sum(inferred) AS inferred FROM fo GROUP BY 1, 2, 3, 4),
      bad AS (SELECT DISTINCT instrument, ts_ms - ts_ms % 60000 AS m FROM df ANTI JOIN fr USING (instrument, seq)), en AS (SELECT DISTINCT instrument, m + 60000 AS e FROM (SELECT instrument, m FROM mi UNION ALL SELECT instrument, m FROM bad)),
      fi AS (SELECT instrument, min(m) AS f FROM mi GROUP BY 1)
      SELECT en.instrument, e AS end_ms, w AS minutes, side, band, CAST(sum(added) AS BIGINT) AS added, CAST(sum(cancelled) AS BIGINT) AS cancelled, CAST(sum(filled) AS BIGINT) AS filled, CAST(sum(inferred) AS BIGINT) AS inferred, e - w * 60000 <= f AS partial_start,
        EXISTS (SELECT 1 FROM bad WHERE bad.instrument = en.instrument AND bad.m < e AND bad.m >= e - w * 60000) AS feed_gap
      FROM en JOIN fi USING (instrument), (VALUES (5), (15), (60)) v(w), mi WHERE mi.instrument = en.instrument AND mi.m < e AND mi.m >= e - w * 60000 GROUP BY en.instrument, e, w, side, band, f""",
    "k8_flow_minutes": f"{FLOW} SELECT instrument, ts_ms - ts_ms % 60000 AS minute_ms, side, band, CAST(sum(added) AS BIGINT) AS added, CAST(sum(cancelled) AS BIGINT) AS cancelled, CAST(sum(filled) AS BIGINT) AS filled, CAST(sum(inferred) AS BIGINT) AS inferred FROM fo GROUP BY 1, 2, 3, 4",
}
