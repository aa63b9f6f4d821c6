"""Registered queries: event order and gaps, derivatives context, data-quality reports."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeloom.functions.timing import numbered
from tapeloom.operators import derivatives as D
from tapeloom.operators import ordering as E
from tapeloom.operators.flow import cumulative_delta
from tapeloom.plans.tape_sql import TAPE
from tapeloom.sources.tape import DAY_MS, HOUR_MS, gaps, raw_tape, trades

H = HOUR_MS
LAG_MS = 1_800_000


def arrivals(s, d):
    """The tape as it might arrive: each seventh row half an hour late."""
    t = raw_tape(s, d).select("instrument", "ts_ms", "trade_id")
    at = F.col("ts_ms") + F.when(F.col("trade_id") % 7 == 0, LAG_MS).otherwise(0)
    return numbered(t.withColumn("at", at), ["instrument"], "at", ["at", "trade_id"], "seq").drop("at")


def doubled(s, d):
    t = trades(s, d)
    return t.unionByName(t.where("trade_id % 5 = 0"))


def aggregates(s, d):
    """Aggregates of each fourth trade of an instrument alone; the others have to be restored or are lost."""
    t = trades(s, d).where("trade_id % 4 = 0")
    return t.select("instrument", F.col("trade_id").alias("agg_id"), F.col("trade_id").alias("first_id"), F.col("trade_id").alias("last_id"), F.lit(0).cast("long").alias("price"), "aggressor", "qty")


def flat(df):
    return df.withColumn("price", F.lit(0).cast("long"))


def positions(df):
    w = W.partitionBy("instrument", "day_ms").orderBy("ts_ms", "trade_id")
    return df.withColumn("day_ms", F.col("ts_ms") - F.pmod("ts_ms", F.lit(DAY_MS))).withColumn("position", F.row_number().over(w))


def checkpoints(df):
    """Each trade's number, and the running signed quantity as the state there."""
    c = cumulative_delta(df)
    return numbered(c, ["instrument"], "ts_ms", ["ts_ms", "trade_id"], "position")


def oi(s, d):
    t = raw_tape(s, d).where("event_type = 'view'")
    return t.select("instrument", "ts_ms", F.col("trade_id").alias("seq"), F.col("price").alias("oi"), F.lit(H).alias("resolution_ms"))


def marks(s, d):
    t = raw_tape(s, d).where("event_type = 'purchase'")
    nxt = F.col("ts_ms") - F.pmod("ts_ms", F.lit(8 * H)) + 8 * H
    return t.select("instrument", "ts_ms", F.col("trade_id").alias("seq"), F.col("price").alias("mark"), (F.col("price") - F.col("qty") * 1_000_000).alias("index"), nxt.alias("next_funding_ms"))


def hours(s, d):
    t = trades(s, d)
    return t.select("instrument", (F.col("ts_ms") - F.pmod("ts_ms", F.lit(H)) + H).alias("at_ms")).distinct()


def settled(s, d):
    t = raw_tape(s, d).where("event_type = 'signup'")
    return t.select("instrument", "ts_ms", F.col("trade_id").alias("seq"), F.col("qty").alias("rate"))


def capture_report(s, d):
    """H1: named checks with their counts."""
    t, g = trades(s, d), gaps(s, d)
    checks = {
        "trades": t.agg(F.count("*").alias("n")), "gaps": g.agg(F.count("*").alias("n")), "rejected": E.rejections(raw_tape(s, d).where("event_type <> 'error'")).agg(F.count("*").alias("n")),
        "id_breaks": E.sequence_breaks(t, ["instrument"], 4).agg(F.count("*").alias("n")), "silences": E.silences(t, 2 * H).agg(F.count("*").alias("n")),
        "missing_days": E.missing_days(t).agg(F.count("*").alias("n")), "late": E.late_events(arrivals(s, d), LAG_MS // 3).agg(F.count("*").alias("n")),
    }
    out = None
    for name, df in checks.items():
        row = df.select(F.lit(name).alias("check"), "n")
        out = row if out is None else out.unionByName(row)
    return out


QUERIES = {
    "ev1_canonical_order": lambda s, d: E.canonical({"trade": trades(s, d).withColumnRenamed("trade_id", "seq"), "gap": gaps(s, d).select("instrument", F.col("start_ms").alias("ts_ms"), F.col("end_ms").alias("seq"))}),
    "ev2_dedupe_ids": lambda s, d: E.deduplicated(doubled(s, d), ["instrument", "trade_id"], ["ts_ms"]).groupBy("instrument").agg(F.count("*").alias("n"), F.sum("qty").alias("qty")),
    "ev2_drop_repeats": lambda s, d: E.without_repeats(trades(s, d), ["instrument"], ["ts_ms", "trade_id"], ["aggressor"]).select("instrument", "trade_id", "aggressor"),
    "ev3_sequence_breaks": lambda s, d: E.sequence_breaks(trades(s, d), ["instrument"]),
    "ev4_session_gaps": lambda s, d: E.session_gaps(trades(s, d).withColumns({"seq": F.col("trade_id"), "session": F.floor(F.col("trade_id") / 1000)}), "session"),
    "ev5_unparsable_samples": lambda s, d: raw_tape(s, d).where("qty <= 0 OR qty IS NULL").select("instrument", F.col("ts_ms").alias("start_ms"), F.col("ts_ms").alias("end_ms"), F.lit("missing_data").alias("reason")),
    "ev6_late_events": lambda s, d: E.late_events(arrivals(s, d), LAG_MS // 3),
    "ev7_missing_days": lambda s, d: E.missing_days(trades(s, d).where(f"pmod(ts_ms div {DAY_MS}, 5) <> 0")),
    "ev8_silences": lambda s, d: E.silences(trades(s, d), 2 * H),
    "ev9_aggregate_fold": lambda s, d: E.folded(aggregates(s, d), flat(trades(s, d))),
    "ev10_rejections": lambda s, d: E.rejections(raw_tape(s, d).where("event_type <> 'error'")),
    "ev11_restart_segments": lambda s, d: E.restart_segments(trades(s, d), 2 * H).groupBy("instrument", "chain").agg(F.count("*").alias("n"), F.min("ts_ms").alias("first_ms")),
    "ev12_stitched": lambda s, d: E.stitched(trades(s, d).where("aggressor = 'buy'"), trades(s, d).where("aggressor = 'sell'"), 1_705_000_000_000).groupBy("instrument", "aggressor").agg(F.count("*").alias("n"), F.min("ts_ms").alias("a"), F.max("ts_ms").alias("b")),
    "ev13_known_until": lambda s, d: E.known_until(trades(s, d), gaps(s, d)),
    "ev14_fingerprint": lambda s, d: E.fingerprint(trades(s, d)),
    "ev15_first_difference": lambda s, d: E.first_difference(checkpoints(trades(s, d)), checkpoints(trades(s, d).where("trade_id % 997 <> 0")), ["instrument"], ["cvd"]),
    "ev16_readmitted_days": lambda s, d: E.first_difference(positions(trades(s, d)), positions(trades(s, d).where("trade_id % 997 <> 0")), ["instrument", "day_ms"], ["trade_id", "price", "qty"]),
    "d1_oi_steps": lambda s, d: D.oi_steps(oi(s, d)).select("instrument", "seq", "delta", "elapsed_ms"),
    "d2_oi_velocity": lambda s, d: D.oi_steps(oi(s, d)).select("instrument", "seq", "per_minute"),
    "d3_oi_grid": lambda s, d: D.oi_grid(oi(s, d), H, H // 2),
    "d4_mark_state": lambda s, d: D.mark_state(marks(s, d), hours(s, d)),
    "d5_settled_funding": lambda s, d: D.settled_funding(settled(s, d), hours(s, d)),
    "d6_liquidation_windows": lambda s, d: D.liquidation_windows(trades(s, d), 4, H),
    "h1_capture_report": capture_report,
    "h2_archive_days": lambda s, d: E.missing_days(trades(s, d).where("qty > 95")).groupBy("instrument").agg(F.count("*").alias("n_missing")),
    "h3_availability": lambda s, d: raw_tape(s, d).groupBy("event_type", (F.col("ts_ms") - F.pmod("ts_ms", F.lit(DAY_MS))).alias("day_ms")).agg(F.count("*").alias("n")),
}

T = f"WITH {TAPE}"
OI = f"{T}, oi AS (SELECT instrument, ts_ms, trade_id AS seq, price AS oi FROM ev WHERE event_type = 'view'), st AS (SELECT *, lag(oi) OVER w AS p, ts_ms - lag(ts_ms) OVER w AS e FROM oi WINDOW w AS (PARTITION BY instrument ORDER BY ts_ms, seq))"
HOURS = f"hr AS (SELECT DISTINCT instrument, ts_ms - ts_ms % {H} + {H} AS at_ms FROM trades)"
LATE = f"ar AS (SELECT instrument, ts_ms, row_number() OVER (PARTITION BY instrument ORDER BY ts_ms + CASE WHEN trade_id % 7 = 0 THEN {LAG_MS} ELSE 0 END, trade_id) AS seq FROM ev), lt AS (SELECT *, max(ts_ms) OVER (PARTITION BY instrument ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen_ms FROM ar)"
DIFF = f"""{T}, p AS (SELECT *, ts_ms - ts_ms % {DAY_MS} AS day_ms FROM trades), a AS (SELECT *, row_number() OVER (PARTITION BY instrument, day_ms ORDER BY ts_ms, trade_id) AS position FROM p),
b AS (SELECT *, row_number() OVER (PARTITION BY instrument, day_ms ORDER BY ts_ms, trade_id) AS position FROM p WHERE trade_id % 997 <> 0)"""
DAYS = "{name}_d AS (SELECT DISTINCT instrument, ts_ms - ts_ms % 86400000 AS day_ms FROM trades WHERE {where}), {name}_s AS (SELECT instrument, unnest(range(min(day_ms), max(day_ms) + 1, 86400000)) AS day_ms FROM {name}_d GROUP BY instrument), {name} AS (SELECT * FROM {name}_s ANTI JOIN {name}_d USING (instrument, day_ms))"

SQL = {
    "ev1_canonical_order": f"""{T}, u AS (SELECT instrument, ts_ms, trade_id AS seq, 'trade' AS kind, 0 AS kind_rank FROM trades UNION ALL SELECT instrument, start_ms, end_ms, 'gap', 8 FROM gaps)
      SELECT *, row_number() OVER (PARTITION BY instrument, ts_ms - ts_ms % {DAY_MS} ORDER BY ts_ms, kind_rank, seq) AS order_no FROM u""",
    "ev2_dedupe_ids": f"{T} SELECT instrument, count(*) AS n, CAST(sum(qty) AS BIGINT) AS qty FROM trades GROUP BY 1",
    "ev2_drop_repeats": f"{T} SELECT instrument, trade_id, aggressor FROM (SELECT *, lag(aggressor) OVER (PARTITION BY instrument ORDER BY ts_ms, trade_id) AS p FROM trades) WHERE p IS DISTINCT FROM aggressor",
    "ev3_sequence_breaks": f"{T} SELECT instrument, p AS start_ms, ts_ms AS end_ms, trade_id - i - 1 AS missing, 'sequence_break' AS reason FROM (SELECT *, lag(ts_ms) OVER w AS p, lag(trade_id) OVER w AS i FROM trades WINDOW w AS (PARTITION BY instrument ORDER BY trade_id)) WHERE trade_id <> i + 1",
    "ev4_session_gaps": f"{T} SELECT instrument, p AS start_ms, ts_ms AS end_ms, 'disconnected' AS reason FROM (SELECT *, lag(ts_ms) OVER w AS p, lag(trade_id // 1000) OVER w AS i FROM trades WINDOW w AS (PARTITION BY instrument ORDER BY ts_ms, trade_id)) WHERE trade_id // 1000 <> i",
    "ev5_unparsable_samples": f"{T} SELECT instrument, ts_ms AS start_ms, ts_ms AS end_ms, 'missing_data' AS reason FROM ev WHERE qty <= 0 OR qty IS NULL",
    "ev6_late_events": f"{T}, {LATE} SELECT instrument, seq, ts_ms, seen_ms FROM lt WHERE ts_ms < seen_ms - {LAG_MS // 3}",
    "ev7_missing_days": f"{T}, {DAYS.format(name='m', where=f'(ts_ms // {DAY_MS}) % 5 <> 0')} SELECT * FROM m",
    "ev8_silences": f"{T} SELECT instrument, p AS start_ms, ts_ms AS end_ms, ts_ms - p AS silent_ms FROM (SELECT *, lag(ts_ms) OVER (PARTITION BY instrument ORDER BY ts_ms) AS p FROM trades) WHERE ts_ms - p > {2 * H}",
    "ev9_aggregate_fold": f"""{T}, g AS (SELECT * FROM trades WHERE trade_id % 4 = 0), u AS (SELECT t.*, g.trade_id AS agg_id, g.aggressor = t.aggressor AS same FROM trades t ASOF JOIN g ON t.instrument = g.instrument AND t.trade_id >= g.trade_id WHERE t.trade_id <> g.trade_id),
      r AS (SELECT *, bool_and(same) OVER (PARTITION BY instrument, agg_id ORDER BY trade_id ROWS UNBOUNDED PRECEDING) AS ok FROM u)
      SELECT g.instrument, g.trade_id AS agg_id, CAST(g.qty + coalesce(sum(r.qty) FILTER (WHERE ok), 0) AS BIGINT) AS qty, count(*) FILTER (WHERE ok) AS n_restored, count(*) FILTER (WHERE NOT ok) AS n_lost FROM g LEFT JOIN r ON r.instrument = g.instrument AND r.agg_id = g.trade_id GROUP BY g.instrument, g.trade_id, g.qty""",
    "ev10_rejections": f"{T} SELECT instrument, trade_id, CASE WHEN qty <= 0 THEN 'quantity' ELSE 'price' END AS reason FROM ev WHERE event_type <> 'error' AND (qty <= 0 OR price <= 0)",
    "ev11_restart_segments": f"{T}, j AS (SELECT *, CASE WHEN ts_ms - lag(ts_ms) OVER w > {2 * H} THEN 1 ELSE 0 END AS j FROM trades WINDOW w AS (PARTITION BY instrument ORDER BY ts_ms, trade_id)), c AS (SELECT *, CAST(sum(j) OVER (PARTITION BY instrument ORDER BY ts_ms, trade_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS chain FROM j) SELECT instrument, chain, count(*) AS n, min(ts_ms) AS first_ms FROM c GROUP BY 1, 2",
    "ev12_stitched": f"{T} SELECT instrument, aggressor, count(*) AS n, min(ts_ms) AS a, max(ts_ms) AS b FROM trades WHERE (aggressor = 'buy') = (ts_ms < 1705000000000) GROUP BY 1, 2",
    "ev13_known_until": f"{T} SELECT instrument, max(ts_ms) AS known_until, coalesce((SELECT max(end_ms) FROM gaps g WHERE g.instrument = t.instrument) > max(ts_ms), false) AS trailing_gap FROM trades t GROUP BY 1",
    "ev14_fingerprint": f"""{T}, mi AS (SELECT instrument, ts_ms - ts_ms % 60000 AS minute_ms, count(*) AS n, sha256(string_agg(sha256(concat_ws('|', ts_ms, trade_id, price, qty, aggressor)), '' ORDER BY ts_ms, trade_id)) AS h FROM trades GROUP BY 1, 2),
      d AS (SELECT instrument, minute_ms - minute_ms % {DAY_MS} AS day_ms, sum(n) AS n, sha256(string_agg(h, '' ORDER BY minute_ms)) AS h FROM mi GROUP BY 1, 2)
      SELECT instrument, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(h, '' ORDER BY day_ms)) AS digest FROM d GROUP BY 1""",
    "ev15_first_difference": f"""{T}, x AS (SELECT instrument, trade_id, ts_ms, CASE WHEN aggressor = 'buy' THEN qty ELSE -qty END AS q FROM trades),
      a AS (SELECT instrument, row_number() OVER w AS position, sum(q) OVER w AS cvd FROM x WINDOW w AS (PARTITION BY instrument ORDER BY ts_ms, trade_id ROWS UNBOUNDED PRECEDING)),
      b AS (SELECT instrument, row_number() OVER w AS position, sum(q) OVER w AS cvd FROM x WHERE trade_id % 997 <> 0 WINDOW w AS (PARTITION BY instrument ORDER BY ts_ms, trade_id ROWS UNBOUNDED PRECEDING))
      SELECT coalesce(a.instrument, b.instrument) AS instrument, count(a.cvd) AS n_a, count(b.cvd) AS n_b, min(coalesce(a.position, b.position)) FILTER (WHERE a.cvd IS DISTINCT FROM b.cvd) AS first_difference
      FROM a FULL JOIN b ON a.instrument = b.instrument AND a.position = b.position GROUP BY 1""",
    "ev16_readmitted_days": f"""{DIFF} SELECT coalesce(a.instrument, b.instrument) AS instrument, coalesce(a.day_ms, b.day_ms) AS day_ms, count(a.trade_id) AS n_a, count(b.trade_id) AS n_b,
      min(coalesce(a.position, b.position)) FILTER (WHERE a.trade_id IS DISTINCT FROM b.trade_id) AS first_difference FROM a FULL JOIN b ON a.instrument = b.instrument AND a.day_ms = b.day_ms AND a.position = b.position GROUP BY 1, 2""",
    "d1_oi_steps": f"{OI} SELECT instrument, seq, CASE WHEN e <= {H + 15000} THEN oi - p END AS delta, CASE WHEN e <= {H + 15000} THEN e END AS elapsed_ms FROM st",
    "d2_oi_velocity": f"{OI} SELECT instrument, seq, CASE WHEN e <= {H + 15000} AND e > 0 THEN (oi - p) * 60000.0::DOUBLE / e END AS per_minute FROM st",
    "d3_oi_grid": f"""{OI}, sp AS (SELECT instrument, min(ts_ms) - min(ts_ms) % {H} + {H} AS a, max(ts_ms) - max(ts_ms) % {H} AS b FROM oi GROUP BY 1), gr AS (SELECT instrument, unnest(range(a, b + 1, {H})) AS grid_ms FROM sp),
      g AS (SELECT gr.instrument, grid_ms, CASE WHEN grid_ms - o.ts_ms <= {H // 2} THEN o.oi END AS oi FROM gr ASOF LEFT JOIN oi o ON gr.instrument = o.instrument AND gr.grid_ms >= o.ts_ms)
      SELECT *, oi - lag(oi) OVER (PARTITION BY instrument ORDER BY grid_ms) AS delta FROM g""",
    "d4_mark_state": f"""{T}, {HOURS}, m AS (SELECT instrument, ts_ms, price, qty FROM ev WHERE event_type = 'purchase') SELECT h.instrument, at_ms, m.qty * 1000000 AS basis, ts_ms - ts_ms % {8 * H} + {8 * H} - at_ms AS to_funding_ms FROM hr h ASOF LEFT JOIN m ON h.instrument = m.instrument AND h.at_ms >= m.ts_ms""",
    "d5_settled_funding": f"{T}, {HOURS}, m AS (SELECT instrument, ts_ms, qty FROM ev WHERE event_type = 'signup') SELECT h.instrument, at_ms, m.qty AS rate, m.ts_ms AS settled_ms FROM hr h ASOF LEFT JOIN m ON h.instrument = m.instrument AND h.at_ms >= m.ts_ms",
    "d6_liquidation_windows": f"""{T}, p AS (SELECT instrument, ts_ms - ts_ms % {H} AS bar_ms, aggressor, qty FROM trades), g AS (SELECT instrument, unnest(range(min(bar_ms), max(bar_ms) + 1, {H})) AS bar_ms FROM p GROUP BY 1),
      c AS (SELECT instrument, bar_ms, count(*) FILTER (WHERE aggressor = 'buy') AS n_buy, count(*) FILTER (WHERE aggressor = 'sell') AS n_sell, coalesce(sum(qty) FILTER (WHERE aggressor = 'buy'), 0) AS q_buy, coalesce(sum(qty) FILTER (WHERE aggressor = 'sell'), 0) AS q_sell FROM g LEFT JOIN p USING (instrument, bar_ms) GROUP BY 1, 2)
      SELECT instrument, bar_ms, CAST(sum(n_buy) OVER w AS BIGINT) AS n_buy, CAST(sum(n_sell) OVER w AS BIGINT) AS n_sell, CAST(sum(q_buy) OVER w AS BIGINT) AS q_buy, CAST(sum(q_sell) OVER w AS BIGINT) AS q_sell FROM c
      WINDOW w AS (PARTITION BY instrument ORDER BY bar_ms ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) QUALIFY row_number() OVER (PARTITION BY instrument ORDER BY bar_ms) >= 4""",
    "h1_capture_report": f"""{T}, {LATE}, {DAYS.format(name='m', where='true')} SELECT 'trades' AS "check", count(*) AS n FROM trades UNION ALL SELECT 'gaps', count(*) FROM gaps UNION ALL SELECT 'rejected', count(*) FROM ev WHERE event_type <> 'error' AND (qty <= 0 OR price <= 0)
      UNION ALL SELECT 'id_breaks', count(*) FROM (SELECT trade_id, lag(trade_id) OVER (PARTITION BY instrument ORDER BY trade_id) AS p FROM trades) WHERE trade_id <> p + 4 UNION ALL SELECT 'silences', count(*) FROM (SELECT ts_ms - lag(ts_ms) OVER (PARTITION BY instrument ORDER BY ts_ms) AS g FROM trades) WHERE g > {2 * H}
      UNION ALL SELECT 'missing_days', count(*) FROM m UNION ALL SELECT 'late', count(*) FROM lt WHERE ts_ms < seen_ms - {LAG_MS // 3}""",
    "h2_archive_days": f"{T}, {DAYS.format(name='m', where='qty > 95')} SELECT instrument, count(*) AS n_missing FROM m GROUP BY 1",
    "h3_availability": f"{T} SELECT event_type, ts_ms - ts_ms % {DAY_MS} AS day_ms, count(*) AS n FROM ev GROUP BY 1, 2",
}
