"""Registered queries: outcomes of trades on trigger decisions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions.tables import kept
from tapeloom.operators import trade_outcomes as X
from tapeloom.plans.bars_flow import hour_bars
from tapeloom.plans.outcome_queries import referenced
from tapeloom.plans.study_relations import YR, all_records, study_effort
from tapeloom.sources.tape import HOUR_MS, gaps, trades

H = HOUR_MS
STOP, TARGET_R, LATENCY, WAIT, HOLD = 150_000, 2, 250, H, 12 * H
SLIP, FEE, FUNDING = 1, 5, 1
REGIMES = ("low", "normal", "elevated", "high")


def decisions(s, d):
    t = all_records(s, d).where("sample = 'trigger'").select("instrument", "event_seq", "trigger", "decision_ms", "regime", "failed_side")
    t = t.join(referenced(s, d).select("instrument", "event_seq", "reference", "atr"), ["instrument", "event_seq"])
    return X.sided(t.join(study_effort(s, d).select("instrument", "event_seq", "aggressor"), ["instrument", "event_seq"], "left"))


@kept
def admitted(s, d):
    return X.admitted(decisions(s, d), STOP, TARGET_R, REGIMES)


@kept
def entries(s, d):
    return X.entered(admitted(s, d), trades(s, d), LATENCY, WAIT)


@kept
def exits(s, d):
    return X.exited(entries(s, d), hour_bars(s, d), trades(s, d), HOLD, H)


@kept
def taken(s, d):
    return X.taken(X.censored(X.results(exits(s, d), SLIP, FEE, FUNDING), gaps(s, d)), HOLD)


def conserved(s, d):
    """Per trigger: decisions = filtered + unfilled + skipped + records."""
    k = ["instrument", "event_seq", "trigger"]
    j = admitted(s, d).select(*k, "reason").join(taken(s, d).select(*k, "taken"), k, "left")
    out = j.groupBy("trigger").agg(
        F.count("*").alias("decisions"), F.count("reason").alias("filtered"), F.count_if(F.col("reason").isNull() & F.col("taken").isNull()).alias("unfilled"),
        F.count_if(~F.col("taken")).alias("skipped"), F.count_if("taken").alias("records"),
    )
    return out.withColumn("conserved", F.col("decisions") == F.col("filtered") + F.col("unfilled") + F.col("skipped") + F.col("records"))


K = ["instrument", "event_seq", "trigger"]
QUERIES = {
    "w1_admission": lambda s, d: admitted(s, d).select(*K, "reason"),
    "w2_sides": lambda s, d: decisions(s, d).select(*K, "side"),
    "w3_stops_targets": lambda s, d: admitted(s, d).select(*K, "risk", "stop", "target"),
    "w4_entries": lambda s, d: entries(s, d).select(*K, "entry_ms", "entry_id", "entry_price"),
    "w5_exits": lambda s, d: exits(s, d).select(*K, "exit_by", "exit_ms", "exit_price"),
    "w6_fills": lambda s, d: taken(s, d).select(*K, "entry_fill", "exit_fill"),
    "w7_results": lambda s, d: taken(s, d).select(*K, "gross_r", "fee_r", "settlements", "funding_r", "net_r"),
    "w8_censors": lambda s, d: taken(s, d).select(*K, "censor"),
    "w9_one_position": lambda s, d: taken(s, d).select(*K, "taken"),
    "w10_metrics_by_regime": lambda s, d: X.metrics(taken(s, d).where("taken AND censor IS NULL")),
    "w11_conservation": conserved,
}

SLIPPED = lambda p, up: f"CASE WHEN {up} THEN {p} + {p} * {SLIP} // 10000 ELSE {p} - {p} * {SLIP} // 10000 END"
TO = f"""{YR}, dc AS (SELECT ra.instrument, ra.event_seq, ra.trigger, ra.decision_ms, ra.regime, rr.reference, rr.atr, CASE WHEN trigger = 'effort_result.4h' THEN CASE aggressor WHEN 'buy' THEN 'sell' WHEN 'sell' THEN 'buy' END ELSE CASE failed_side WHEN 'above' THEN 'sell' WHEN 'below' THEN 'buy' END END AS side,
  (atr * {STOP}) // 100000 + CASE WHEN (atr * {STOP}) % 100000 > 50000 OR ((atr * {STOP}) % 100000 = 50000 AND (atr * {STOP}) // 100000 % 2 = 1) THEN 1 ELSE 0 END AS risk FROM ra JOIN rr USING (instrument, event_seq) LEFT JOIN er USING (instrument, event_seq) WHERE sample = 'trigger'),
dp AS (SELECT *, CASE side WHEN 'buy' THEN reference - risk WHEN 'sell' THEN reference + risk END AS stop, CASE side WHEN 'buy' THEN reference + {TARGET_R} * risk WHEN 'sell' THEN reference - {TARGET_R} * risk END AS target FROM dc),
dq AS (SELECT *, CASE WHEN regime = 'not_ready' THEN 'filter' WHEN side IS NULL THEN 'side' WHEN reference IS NULL THEN 'reference' WHEN coalesce(risk <= 0, true) THEN 'risk' WHEN stop <= 0 OR target <= 0 THEN 'stop_side' END AS reason FROM dp),
d1 AS (SELECT q.instrument, q.event_seq, q.trigger, min({{'t': t.ts_ms, 'i': t.trade_id, 'p': t.price}}) AS e FROM dq q JOIN trades t ON t.instrument = q.instrument AND t.ts_ms >= q.decision_ms + {LATENCY} AND t.ts_ms < q.decision_ms + {WAIT} WHERE reason IS NULL GROUP BY 1, 2, 3),
en AS (SELECT q.*, e.t AS entry_ms, e.i AS entry_id, e.p AS entry_price FROM dq q LEFT JOIN d1 USING (instrument, event_seq, trigger) WHERE reason IS NULL),
x1 AS (SELECT n.instrument, n.event_seq, n.trigger, min({{'t': t.ts_ms, 'i': t.trade_id}}) FILTER (WHERE (side = 'buy' AND t.price >= target) OR (side = 'sell' AND t.price <= target)) AS ta, min({{'t': t.ts_ms, 'i': t.trade_id}}) FILTER (WHERE (side = 'buy' AND t.price <= stop) OR (side = 'sell' AND t.price >= stop)) AS sa
  FROM en n JOIN trades t ON t.instrument = n.instrument AND t.ts_ms >= n.entry_ms AND t.ts_ms < n.entry_ms + {HOLD} AND (t.ts_ms > n.entry_ms OR t.trade_id > n.entry_id) GROUP BY 1, 2, 3),
x2 AS (SELECT en.*, CASE WHEN ta IS NOT NULL AND (sa IS NULL OR ta < sa) THEN 'target' WHEN sa IS NOT NULL THEN 'stop' ELSE 'time' END AS exit_by, CASE WHEN ta IS NOT NULL AND (sa IS NULL OR ta < sa) THEN ta.t + 1 WHEN sa IS NOT NULL THEN sa.t + 1 ELSE entry_ms + {HOLD} END AS look_ms
  FROM en LEFT JOIN x1 USING (instrument, event_seq, trigger) WHERE entry_ms IS NOT NULL),
x3 AS (SELECT x.instrument, x.event_seq, x.trigger, min({{'t': t.ts_ms, 'i': t.trade_id, 'p': t.price}}) AS o FROM x2 x JOIN trades t ON t.instrument = x.instrument AND t.ts_ms >= x.look_ms GROUP BY 1, 2, 3),
ex AS (SELECT x2.*, o.t AS exit_ms, o.p AS exit_price FROM x2 LEFT JOIN x3 USING (instrument, event_seq, trigger)),
fi AS (SELECT *, {SLIPPED("entry_price", "side = 'buy'")} AS entry_fill, {SLIPPED("exit_price", "side <> 'buy'")} AS exit_fill, exit_ms // 28800000 - entry_ms // 28800000 AS settlements, CASE WHEN side = 'buy' THEN 1 ELSE -1 END AS sg FROM ex),
rs AS (SELECT *, sg * (exit_fill - entry_fill)::DOUBLE / risk AS gross_r, (entry_fill + exit_fill)::DOUBLE * {FEE} / 10000 / risk AS fee_r, (sg * settlements * entry_fill)::DOUBLE * {FUNDING} / 10000 / risk AS funding_r FROM fi),
ce2 AS (SELECT *, gross_r - fee_r - funding_r AS net_r, CASE WHEN exit_ms IS NULL THEN 'end_of_data' WHEN EXISTS (SELECT 1 FROM gaps g WHERE g.instrument = rs.instrument AND g.start_ms <= rs.exit_ms AND g.end_ms >= rs.decision_ms) THEN 'gap' END AS censor FROM rs),
o1 AS (SELECT *, row_number() OVER (PARTITION BY instrument, trigger ORDER BY decision_ms, event_seq) AS k, decision_ms + coalesce(exit_ms - decision_ms, {HOLD}) AS free_ms FROM ce2),
o2 AS (SELECT a.instrument, a.trigger, a.k, min(b.k) AS nxt FROM o1 a LEFT JOIN o1 b ON a.instrument = b.instrument AND a.trigger = b.trigger AND b.k > a.k AND b.decision_ms >= a.free_ms GROUP BY 1, 2, 3),
o3 AS (SELECT DISTINCT instrument, trigger, CAST(1 AS BIGINT) AS k FROM o1 UNION ALL SELECT o3.instrument, o3.trigger, nxt FROM o3 JOIN o2 ON o2.instrument = o3.instrument AND o2.trigger = o3.trigger AND o2.k = o3.k WHERE nxt IS NOT NULL),
tk AS (SELECT o1.*, o3.k IS NOT NULL AS taken FROM o1 LEFT JOIN o3 USING (instrument, trigger, k))"""
C = "instrument, event_seq, trigger"
SQL = {
    "w1_admission": f"{TO} SELECT {C}, reason FROM dq",
    "w2_sides": f"{TO} SELECT {C}, side FROM dc",
    "w3_stops_targets": f"{TO} SELECT {C}, risk, stop, target FROM dq",
    "w4_entries": f"{TO} SELECT {C}, entry_ms, entry_id, entry_price FROM en",
    "w5_exits": f"{TO} SELECT {C}, exit_by, exit_ms, exit_price FROM ex",
    "w6_fills": f"{TO} SELECT {C}, entry_fill, exit_fill FROM tk",
    "w7_results": f"{TO} SELECT {C}, gross_r, fee_r, settlements, funding_r, net_r FROM tk",
    "w8_censors": f"{TO} SELECT {C}, censor FROM tk",
    "w9_one_position": f"{TO} SELECT {C}, taken FROM tk",
    "w10_metrics_by_regime": f"""{TO}, b AS (SELECT *, unnest(['all', regime]) AS bucket FROM tk WHERE taken AND censor IS NULL) SELECT trigger, bucket, count(*) AS n, avg(net_r) AS expectancy, sum(net_r) FILTER (WHERE net_r > 0) / -sum(net_r) FILTER (WHERE net_r < 0) AS profit_factor, count(*) FILTER (WHERE net_r > 0)::DOUBLE / count(*) AS win_rate,
      count(*) FILTER (WHERE exit_by = 'target')::DOUBLE / count(*) AS target_rate, avg(exit_ms - entry_ms) AS mean_holding_ms FROM b GROUP BY 1, 2""",
    "w11_conservation": f"""{TO} SELECT trigger, count(*) AS decisions, count(reason) AS filtered, count(*) FILTER (WHERE reason IS NULL AND taken IS NULL) AS unfilled, count(*) FILTER (WHERE NOT taken) AS skipped, count(*) FILTER (WHERE taken) AS records, decisions = filtered + unfilled + skipped + records AS conserved
      FROM (SELECT dq.trigger, dq.reason, tk.taken FROM dq LEFT JOIN tk USING (instrument, event_seq, trigger)) GROUP BY 1""",
}
