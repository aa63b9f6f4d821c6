"""Registered queries: the streaming forms, run once over the events, against batch results as SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tapeloom.functions.tables import shared_folder
from tapeloom.plans.tape_sql import TAPE
from tapeloom.streaming import tape_streams as M


def scratch(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def bars(s, d):
    return M.run_once(M.bars(M.stream(s, d), "1 hour"), scratch(s, "bars"))


def sliding(s, d):
    return M.run_once(M.sliding(M.stream(s, d), "3 hours", "1 hour"), scratch(s, "sliding"))


def sessions(s, d):
    return M.run_once(M.sessions(M.stream(s, d), "1 hour"), scratch(s, "sessions"))


def unique(s, d):
    out = M.run_once(M.deduplicated(M.stream(s, d)), scratch(s, "unique"))
    return out.groupBy("instrument").agg(F.count("*").alias("n"), F.sum("qty").alias("qty"))


QUERIES = {"m3_stream_dedupe": unique, "m4_stream_bars": bars, "m5_stream_sliding": sliding, "m6_stream_sessions": sessions}

CLOSED = "(SELECT max(ts_ms) - 2000 FROM trades)"
COLS = "count(*) AS n, CAST(sum(qty) AS BIGINT) AS qty, max(price) AS high, min(price) AS low"
SQL = {
    "m3_stream_dedupe": f"WITH {TAPE} SELECT instrument, count(*) AS n, CAST(sum(qty) AS BIGINT) AS qty FROM trades GROUP BY 1",
    "m4_stream_bars": f"WITH {TAPE} SELECT instrument, ts_ms - ts_ms % 3600000 AS start_ms, ts_ms - ts_ms % 3600000 + 3600000 AS end_ms, {COLS} FROM trades GROUP BY 1, 2, 3 HAVING end_ms <= {CLOSED}",
    "m5_stream_sliding": f"WITH {TAPE} SELECT instrument, ts_ms - ts_ms % 3600000 - k * 3600000 AS start_ms, ts_ms - ts_ms % 3600000 - k * 3600000 + 10800000 AS end_ms, {COLS} FROM trades, range(3) r(k) GROUP BY 1, 2, 3 HAVING end_ms <= {CLOSED}",
    "m6_stream_sessions": f"""WITH {TAPE}, a AS (SELECT *, CASE WHEN ts_ms - lag(ts_ms) OVER w < 3600000 THEN 0 ELSE 1 END AS new FROM trades WINDOW w AS (PARTITION BY instrument ORDER BY ts_ms)),
      b AS (SELECT *, sum(new) OVER (PARTITION BY instrument ORDER BY ts_ms ROWS UNBOUNDED PRECEDING) AS e FROM a) SELECT instrument, min(ts_ms) AS start_ms, max(ts_ms) + 3600000 AS end_ms, {COLS} FROM b GROUP BY instrument, e HAVING end_ms <= {CLOSED}""",
}
