"""Registered queries: keyed state of the tape's stream, late rows, warm start and checkpoints, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.plans.stream_queries import scratch
from tapeloom.plans.tape_sql import TAPE
from tapeloom.sources.tape import DAY_MS, raw_tape
from tapeloom.streaming import keyed_state as K

#: Each seventh event arrives LAG_MS late, and the stream holds HOLD_MS back; live rows begin on the sixteenth day.
LAG_MS, HOLD_MS, LIVE_FROM_MS = 1_800_000, 600_000, 1_705_276_800_000
TRADE = ["instrument", "ts_ms", "trade_id", "price", "prev_id", "epoch", "day_ms", "ref_high", "ref_low", "region", "run"]


def events(e, lag_ms):
    """Trades (kind 0) and feed gaps (kind 1, without price) of the generic events, with their time of arrival."""
    kind = F.when(F.col("event_type") == "error", 1).otherwise(0).cast("long")
    t = e.where("event_type = 'error' OR qty > 0").select("instrument", "ts_ms", kind.alias("kind"), "trade_id", F.when(kind == 0, F.col("price")).alias("price"))
    return t.withColumn("at", F.col("ts_ms") + F.when(F.col("trade_id") % 7 == 0, lag_ms).otherwise(0))


def live(s, d, lag_ms):
    """The events as a stream of files."""
    table = s.read.parquet(f"{d}/events.parquet")
    return events(raw_tape(s, d, s.readStream.schema(table.schema).option("pathGlobFilter", "*.parquet").load(f"{d}/events.parquet*", format="parquet")), lag_ms)


def ran(s, d):
    path = scratch(s, "keyed")
    return K.run_keyed(live(s, d, LAG_MS), path, HOLD_MS), path


def conservation(s, d):
    """Per instrument: events that arrived, and those that were late, are released, and wait in the state."""
    path = scratch(s, "keyed")
    out = K.run_keyed(live(s, d, LAG_MS), path, HOLD_MS)
    every = events(raw_tape(s, d), LAG_MS).groupBy("instrument").agg(F.count("*").alias("arrived"))
    last = s.read.format("statestore").option("stateVarName", "state").load(f"{path}/_state").select(F.col("key.instrument").alias("instrument"), F.col("value.n").alias("released"))
    late = out.where("kind = 'late_event'").groupBy("instrument").agg(F.count("*").alias("late"))
    held = K.still_held(s, path).groupBy("instrument").agg(F.count("*").alias("held"))
    return every.join(late, "instrument", "left").join(last, "instrument", "left").join(held, "instrument", "left").fillna(0)


def warm(s, d):
    """Trades of the live days from a run that began with the state of the days before."""
    history = events(raw_tape(s, d), 0).where(F.col("ts_ms") < LIVE_FROM_MS)
    rows = K.run_keyed(live(s, d, 0).where(F.col("ts_ms") >= LIVE_FROM_MS), scratch(s, "warm"), HOLD_MS, K.history_state(history))
    return rows.where("kind = 'trade'").select(*TRADE)


QUERIES = {
    "m2_late_gaps": lambda s, d: ran(s, d)[0].where("kind = 'late_event'").select("instrument", F.col("ts_ms").alias("start_ms"), F.col("seen_ms").alias("end_ms"), "trade_id", F.col("kind").alias("reason")),
    "m2_conservation": conservation,
    "m7_keyed_state": lambda s, d: ran(s, d)[0].where("kind = 'trade'").select(*TRADE),
    "m8_warm_start": warm,
    "m8_history_rows": lambda s, d: K.history_rows(events(raw_tape(s, d), 0)).select(*TRADE),
    "m9_checkpoints": lambda s, d: ran(s, d)[0].where("kind = 'checkpoint'").select("instrument", "ts_ms", "n", "stream_hash", "state_hash"),
}


def _rows(lag_ms: int, drop: bool) -> str:
    """Relations: ``ar`` arrivals with what was seen before each, ``rl`` released events, ``tr`` the rows of their trades."""
    late = f"coalesce(ts_ms < seen - {HOLD_MS}, false)" if drop else "false"
    released = f"ts_ms < (SELECT max(b.ts_ms) FROM ar b WHERE b.instrument = ar.instrument) - {HOLD_MS}"
    return f"""WITH {TAPE}, e0 AS (SELECT instrument, ts_ms, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS kind, trade_id, CASE WHEN event_type <> 'error' THEN price END AS price,
  ts_ms + CASE WHEN trade_id % 7 = 0 THEN {lag_ms} ELSE 0 END AS arrives FROM ev WHERE event_type = 'error' OR qty > 0),
ar AS (SELECT *, max(ts_ms) OVER (PARTITION BY instrument ORDER BY arrives, trade_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM e0),
rl AS (SELECT *, CAST(sum(kind) OVER o AS BIGINT) AS epoch, row_number() OVER o AS n FROM ar WHERE NOT {late} AND {released} WINDOW o AS (PARTITION BY instrument ORDER BY ts_ms, kind, trade_id)),
t0 AS (SELECT *, ts_ms - ts_ms % {DAY_MS} AS day_ms, lag(trade_id) OVER (PARTITION BY instrument ORDER BY ts_ms, trade_id) AS prev_id FROM rl WHERE kind = 0),
dy AS (SELECT instrument, day_ms, lag(h) OVER w AS ref_high, lag(l) OVER w AS ref_low FROM (SELECT instrument, day_ms, max(price) AS h, min(price) AS l FROM t0 GROUP BY 1, 2) WINDOW w AS (PARTITION BY instrument ORDER BY day_ms)),
t1 AS (SELECT t0.*, ref_high, ref_low, CASE WHEN ref_high IS NULL THEN 'none' WHEN price > ref_high THEN 'above' WHEN price < ref_low THEN 'below' ELSE 'inside' END AS region FROM t0 JOIN dy USING (instrument, day_ms)),
t2 AS (SELECT *, row_number() OVER (PARTITION BY instrument, day_ms ORDER BY ts_ms, trade_id) - row_number() OVER (PARTITION BY instrument, day_ms, region ORDER BY ts_ms, trade_id) AS island FROM t1),
tr AS (SELECT *, row_number() OVER (PARTITION BY instrument, day_ms, region, island ORDER BY ts_ms, trade_id) AS run FROM t2)"""


COLS = ", ".join(TRADE)
LATE, ALL = _rows(LAG_MS, True), _rows(0, False)
SQL = {
    "m2_late_gaps": f"{LATE} SELECT instrument, ts_ms AS start_ms, seen AS end_ms, trade_id, 'late_event' AS reason FROM ar WHERE ts_ms < seen - {HOLD_MS}",
    "m2_conservation": f"""{LATE}, x AS (SELECT instrument, count(*) AS arrived, count(*) FILTER (WHERE ts_ms < seen - {HOLD_MS}) AS late FROM ar GROUP BY 1), y AS (SELECT instrument, count(*) AS released FROM rl GROUP BY 1)
      SELECT instrument, arrived, late, coalesce(released, 0) AS released, arrived - late - coalesce(released, 0) AS held FROM x LEFT JOIN y USING (instrument)""",
    "m7_keyed_state": f"{LATE} SELECT {COLS} FROM tr",
    "m8_warm_start": f"{ALL} SELECT {COLS} FROM tr WHERE ts_ms >= {LIVE_FROM_MS}",
    "m8_history_rows": f"{ALL.replace(f' - {HOLD_MS}', ' + 1')} SELECT {COLS} FROM tr",
    "m9_checkpoints": f"""{LATE}, h0 AS (SELECT rl.*, tr.trade_id AS ti, tr.day_ms AS dm, tr.ref_high AS rh, tr.ref_low AS rw, tr.region AS rg, tr.run AS ru,
        ('0x' || left(sha256(concat_ws('|', rl.n, rl.ts_ms, rl.trade_id, coalesce(CAST(rl.price AS VARCHAR), ''))), 12))::HUGEINT AS h FROM rl LEFT JOIN tr ON tr.instrument = rl.instrument AND tr.n = rl.n),
      h1 AS (SELECT instrument, ts_ms, n, epoch, CAST(sum(h) OVER o % {K.SPACE} AS BIGINT) AS stream_hash, last_value(CASE WHEN ti IS NOT NULL THEN {{'i': ti, 'd': dm, 'h': rh, 'l': rw, 'g': rg, 'r': ru}} END IGNORE NULLS) OVER o AS t,
        lead(ts_ms) OVER (PARTITION BY instrument ORDER BY n) AS nxt FROM h0 WINDOW o AS (PARTITION BY instrument ORDER BY n ROWS UNBOUNDED PRECEDING))
      SELECT instrument, (ts_ms // {K.CHECKPOINT_MS} + 1) * {K.CHECKPOINT_MS} AS ts_ms, n, stream_hash,
        sha256(concat_ws('|', coalesce(t.i::VARCHAR, ''), epoch, coalesce(t.d::VARCHAR, ''), coalesce(t.h::VARCHAR, ''), coalesce(t.l::VARCHAR, ''), coalesce(t.g, 'none'), coalesce(t.r, 0))) AS state_hash
      FROM h1 WHERE nxt // {K.CHECKPOINT_MS} > ts_ms // {K.CHECKPOINT_MS}""",
}
