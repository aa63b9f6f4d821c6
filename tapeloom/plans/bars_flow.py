"""Registered queries: bars, motion, regimes and order flow."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions.tables import kept
from tapeloom.operators import bars as B
from tapeloom.operators import flow as X
from tapeloom.operators import motion as V
from tapeloom.plans.tape_sql import TAPE, bars, dense
from tapeloom.sources.tape import HOUR_MS, gaps, trades

H, Q = HOUR_MS, 900_000
LARGE = 2_000_000_000_000
#: The tape has breaks, so its segments are shorter than the usual 200 values.
RANKED = 20


@kept
def hour_bars(spark, sf_dir):
    return B.time_bars(trades(spark, sf_dir), H)


@kept
def covered(spark, sf_dir, width=H):
    """Dense bars with coverage and large volume."""
    t = trades(spark, sf_dir)
    d = B.coverage(B.dense_bars(B.time_bars(t, width), width), gaps(spark, sf_dir), width)
    return d.join(X.large_prints(t, width, LARGE), ["instrument", "bar_ms"], "left").fillna(0, ["large_volume", "n_large"])


def moved(spark, sf_dir):
    return V.motion(V.with_segment(covered(spark, sf_dir)), H)


@kept
def atrs(spark, sf_dir):
    return V.atr(moved(spark, sf_dir))


def b6(spark, sf_dir):
    """Bars against klines of their own quarter hours."""
    q = B.time_bars(trades(spark, sf_dir), Q)
    key, bar = F.col("bar_ms"), (F.col("bar_ms") - F.pmod("bar_ms", F.lit(H))).alias("bar_ms")
    k = q.groupBy("instrument", bar).agg(
        F.min_by("open", key).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", key).alias("close"), F.sum("buy_volume").alias("volume"),
    )
    return B.compare_klines(hour_bars(spark, sf_dir), k)


def b7(spark, sf_dir):
    n = B.dense_bars(hour_bars(spark, sf_dir), H)
    v = B.kline_verdict(b6(spark, sf_dir), 0).drop("missing", "verdict").crossJoin(n.agg(F.count("*").alias("expected")))
    missing = F.col("expected") - F.col("compared")
    return v.select("compared", "matched", missing.alias("missing"), F.when(F.col("compared") == 0, "inconclusive").when(F.col("matched") < F.col("compared"), "fail").when(missing > 0, "inconclusive").otherwise("pass").alias("verdict"))


def b8(spark, sf_dir):
    t = trades(spark, sf_dir)
    ids = [F.min("trade_id").alias("first_id"), F.max("trade_id").alias("last_id"), F.sum("qty").alias("volume")]
    a = t.groupBy("instrument", (F.col("ts_ms") - F.pmod("ts_ms", F.lit(H))).alias("x")).agg(*ids).withColumn("side", F.lit("a"))
    b = t.groupBy("instrument", (F.col("ts_ms") - F.pmod("ts_ms", F.lit(Q * 6))).alias("x")).agg(*ids).withColumn("side", F.lit("b"))
    return B.id_blocks(a.unionByName(b).drop("x"))


QUERIES = {
    "b1_time_bars": hour_bars,
    "b2_dense_bars": lambda s, d: B.dense_bars(hour_bars(s, d), H),
    "b3_coverage": lambda s, d: covered(s, d).select("instrument", "bar_ms", "n_trades", "partial_start", "feed_gap"),
    "b4_known_at": lambda s, d: B.known_at(hour_bars(s, d).select("instrument", "bar_ms", "close"), trades(s, d), H),
    "b5_developing_bar": lambda s, d: B.developing(trades(s, d), H),
    "b6_kline_compare": b6,
    "b7_kline_verdict": b7,
    "b8_id_blocks": b8,
    "v1_motion": lambda s, d: moved(s, d).select("instrument", "bar_ms", "change", "range", "simple_return", "velocity"),
    "v2_segments": lambda s, d: V.with_segment(covered(s, d)).select("instrument", "bar_ms", "segment"),
    "v3_true_range": lambda s, d: moved(s, d).select("instrument", "bar_ms", "true_range"),
    "v4_atr": lambda s, d: atrs(s, d).where("atr IS NOT NULL").select("instrument", "bar_ms", "atr"),
    "v5_atr_percentile": lambda s, d: V.regime(atrs(s, d), RANKED).select("instrument", "bar_ms", "percentile"),
    "v6_regime": lambda s, d: V.regime(atrs(s, d), RANKED).where("regime IS NOT NULL").groupBy("instrument", "regime").agg(F.count("*").alias("n")),
    "v7_warm_up": lambda s, d: atrs(s, d).select("instrument", "bar_ms", "observed", "required", F.col("atr").isNotNull().alias("ready")),
    "f1_cvd": lambda s, d: X.cumulative_delta(trades(s, d)),
    "f2_day_cvd": lambda s, d: X.day_delta(trades(s, d)),
    "f3_flow_window": lambda s, d: X.windows(covered(s, d), 4, H).select("instrument", "bar_ms", "w_buy_volume", "w_sell_volume", "w_delta", "w_volume", "w_n_trades", "w_partial_start", "w_feed_gap"),
    "f4_large_prints": lambda s, d: X.large_prints(trades(s, d), H, LARGE),
    "f5_displacement": lambda s, d: X.windows(covered(s, d), 4, H).select("instrument", "bar_ms", "reference", "displacement"),
    "f6_flow_ratios": lambda s, d: X.windows(covered(s, d), 4, H).select("instrument", "bar_ms", "imbalance", "trades_per_minute", "volume_per_minute", "large_share", "price_response"),
}

DENSE = f"WITH RECURSIVE {TAPE}, {bars(H)}, {dense(H)}"
SEG = f"""{DENSE}, seg AS (SELECT *, CAST(sum(CASE WHEN close IS NULL AND feed_gap THEN 1 ELSE 0 END) OVER (PARTITION BY instrument ORDER BY bar_ms) AS BIGINT) AS segment FROM dense),
pc AS (SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY instrument, segment ORDER BY bar_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_close FROM seg),
mv AS (SELECT *, close - prev_close AS change, greatest(high - low, abs(high - prev_close), abs(low - prev_close)) AS true_range FROM pc WHERE close IS NOT NULL)"""
ATR = f"""{SEG}, tr AS (SELECT instrument, segment, bar_ms, true_range, row_number() OVER (PARTITION BY instrument, segment ORDER BY bar_ms) AS observed FROM mv WHERE prev_close IS NOT NULL),
a0 AS (SELECT instrument, segment, 14 AS observed, CAST(sum(true_range) AS BIGINT) AS num FROM tr WHERE observed <= 14 GROUP BY 1, 2 HAVING count(*) = 14),
ar AS (SELECT instrument, segment, CAST(observed AS BIGINT) AS observed,
  num // 14 + CASE WHEN (num % 14) * 2 > 14 OR ((num % 14) * 2 = 14 AND (num // 14) % 2 = 1) THEN 1 ELSE 0 END AS atr FROM a0
  UNION ALL SELECT t.instrument, t.segment, t.observed,
  (r.atr * 13 + t.true_range) // 14 + CASE WHEN ((r.atr * 13 + t.true_range) % 14) * 2 > 14 OR (((r.atr * 13 + t.true_range) % 14) * 2 = 14 AND ((r.atr * 13 + t.true_range) // 14) % 2 = 1) THEN 1 ELSE 0 END
  FROM ar r JOIN tr t ON t.instrument = r.instrument AND t.segment = r.segment AND t.observed = r.observed + 1),
atr AS (SELECT t.instrument, t.segment, t.bar_ms, t.observed, a.atr FROM tr t LEFT JOIN ar a USING (instrument, segment, observed))"""
REGIME = f"""{ATR}, ready AS (SELECT * FROM atr WHERE atr IS NOT NULL),
past AS (SELECT *, list(atr) OVER (PARTITION BY instrument, segment ORDER BY bar_ms ROWS BETWEEN {RANKED} PRECEDING AND 1 PRECEDING) AS p FROM ready),
pct AS (SELECT instrument, bar_ms, CASE WHEN len(p) = {RANKED} THEN len(list_filter(p, lambda x: x <= atr)) * 100.0 / {RANKED} END::DOUBLE AS percentile FROM past)"""
WIN = f"""{DENSE}, w AS (SELECT *, row_number() OVER o AS seen, last_value(close IGNORE NULLS) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 4 PRECEDING) AS reference,
  last_value(close IGNORE NULLS) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_close,
  CAST(sum(buy_volume) OVER n AS BIGINT) AS w_buy_volume, CAST(sum(sell_volume) OVER n AS BIGINT) AS w_sell_volume, CAST(sum(delta) OVER n AS BIGINT) AS w_delta,
  CAST(sum(volume) OVER n AS BIGINT) AS w_volume, CAST(sum(n_trades) OVER n AS BIGINT) AS w_n_trades, CAST(sum(large_volume) OVER n AS BIGINT) AS w_large_volume,
  bool_or(partial_start) OVER n AS w_partial_start, bool_or(feed_gap) OVER n AS w_feed_gap FROM dense
  WINDOW o AS (PARTITION BY instrument ORDER BY bar_ms), n AS (PARTITION BY instrument ORDER BY bar_ms ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)), ww AS (SELECT * FROM w WHERE seen >= 4)"""
KLINES = f"""WITH {TAPE}, {bars(H)}, {bars(Q, "q")}, k AS (SELECT instrument, bar_ms - bar_ms % {H} AS bar_ms, first(open ORDER BY bar_ms) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY bar_ms) AS close, sum(buy_volume) AS volume FROM q GROUP BY 1, 2),
c AS (SELECT b.instrument, b.bar_ms, concat_ws(',', CASE WHEN b.open <> k.open THEN 'open' END, CASE WHEN b.high <> k.high THEN 'high' END, CASE WHEN b.low <> k.low THEN 'low' END,
  CASE WHEN b.close <> k.close THEN 'close' END, CASE WHEN b.volume <> k.volume THEN 'volume' END) AS mismatches FROM bars b JOIN k USING (instrument, bar_ms))"""

SQL = {
    "b1_time_bars": f"WITH {TAPE}, {bars(H)} SELECT * EXCLUDE (large_volume, n_large) FROM bars",
    "b2_dense_bars": f"{DENSE} SELECT * EXCLUDE (large_volume, partial_start, feed_gap) FROM dense",
    "b3_coverage": f"{DENSE} SELECT instrument, bar_ms, n_trades, partial_start, feed_gap FROM dense",
    "b4_known_at": f"WITH {TAPE}, {bars(H)} SELECT b.instrument, b.bar_ms, b.close, min(t.ts_ms) AS known_at FROM bars b LEFT JOIN trades t ON t.instrument = b.instrument AND t.ts_ms >= b.bar_ms + {H} GROUP BY 1, 2, 3",
    "b5_developing_bar": f"""WITH {TAPE} SELECT instrument, trade_id, ts_ms - ts_ms % {H} AS bar_ms, first_value(price) OVER w AS open, max(price) OVER w AS high, min(price) OVER w AS low, price AS close, CAST(sum(qty) OVER w AS BIGINT) AS volume
      FROM trades WINDOW w AS (PARTITION BY instrument, ts_ms - ts_ms % {H} ORDER BY ts_ms, trade_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "b6_kline_compare": f"{KLINES} SELECT * FROM c",
    "b7_kline_verdict": f"""{KLINES}, {dense(H)}, n AS (SELECT count(*) AS compared, count(*) FILTER (WHERE mismatches = '') AS matched, (SELECT count(*) FROM dense) - count(*) AS missing FROM c)
      SELECT *, CASE WHEN compared = 0 THEN 'inconclusive' WHEN matched < compared THEN 'fail' WHEN missing > 0 THEN 'inconclusive' ELSE 'pass' END AS verdict FROM n""",
    "b8_id_blocks": f"""WITH {TAPE}, r AS (SELECT instrument, min(trade_id) AS first_id, max(trade_id) AS last_id, sum(qty) AS volume, 'a' AS side FROM trades GROUP BY instrument, ts_ms - ts_ms % {H}
      UNION ALL SELECT instrument, min(trade_id), max(trade_id), sum(qty), 'b' FROM trades GROUP BY instrument, ts_ms - ts_ms % {Q * 6}),
      m AS (SELECT *, CASE WHEN first_id <= max(last_id) OVER (PARTITION BY instrument ORDER BY first_id, last_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM r),
      b AS (SELECT *, CAST(sum(new) OVER (PARTITION BY instrument ORDER BY first_id, last_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS block FROM m)
      SELECT instrument, block, min(first_id) AS first_id, max(last_id) AS last_id, CAST(sum(CASE WHEN side = 'a' THEN volume ELSE 0 END) AS BIGINT) AS volume_a,
      CAST(sum(CASE WHEN side = 'b' THEN volume ELSE 0 END) AS BIGINT) AS volume_b, sum(CASE WHEN side = 'a' THEN volume ELSE 0 END) = sum(CASE WHEN side = 'b' THEN volume ELSE 0 END) AS equal FROM b GROUP BY 1, 2""",
    "v1_motion": f"{SEG} SELECT instrument, bar_ms, change, high - low AS range, change::DOUBLE / prev_close AS simple_return, change::DOUBLE / 60 AS velocity FROM mv",
    "v2_segments": f"{SEG} SELECT instrument, bar_ms, segment FROM seg",
    "v3_true_range": f"{SEG} SELECT instrument, bar_ms, true_range FROM mv",
    "v4_atr": f"{ATR} SELECT instrument, bar_ms, atr FROM atr WHERE atr IS NOT NULL",
    "v5_atr_percentile": f"{REGIME} SELECT * FROM pct",
    "v6_regime": f"{REGIME} SELECT instrument, CASE WHEN percentile <= 25 THEN 'low' WHEN percentile <= 50 THEN 'normal' WHEN percentile <= 75 THEN 'elevated' ELSE 'high' END AS regime, count(*) AS n FROM pct WHERE percentile IS NOT NULL GROUP BY 1, 2",
    "v7_warm_up": f"{ATR} SELECT instrument, bar_ms, CAST(observed AS INTEGER) AS observed, 14 AS required, atr IS NOT NULL AS ready FROM atr",
    "f1_cvd": f"WITH {TAPE} SELECT instrument, trade_id, ts_ms, CAST(sum(CASE WHEN aggressor = 'buy' THEN qty ELSE -qty END) OVER (PARTITION BY instrument ORDER BY ts_ms, trade_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cvd FROM trades",
    "f2_day_cvd": f"WITH {TAPE} SELECT instrument, trade_id, ts_ms - ts_ms % 86400000 AS day_ms, CAST(sum(CASE WHEN aggressor = 'buy' THEN qty ELSE -qty END) OVER (PARTITION BY instrument, ts_ms - ts_ms % 86400000 ORDER BY ts_ms, trade_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cvd_utc_day FROM trades",
    "f3_flow_window": f"{WIN} SELECT instrument, bar_ms, w_buy_volume, w_sell_volume, w_delta, w_volume, w_n_trades, w_partial_start, w_feed_gap FROM ww",
    "f4_large_prints": f"WITH {TAPE}, {bars(H)} SELECT instrument, bar_ms, large_volume, n_large FROM bars",
    "f5_displacement": f"{WIN} SELECT instrument, bar_ms, reference, last_close - reference AS displacement FROM ww",
    "f6_flow_ratios": f"""{WIN} SELECT instrument, bar_ms, w_delta::DOUBLE / nullif(w_volume, 0) AS imbalance, w_n_trades::DOUBLE / 240 AS trades_per_minute, w_volume::DOUBLE / 240 AS volume_per_minute,
      w_large_volume::DOUBLE / nullif(w_volume, 0) AS large_share, (last_close - reference)::DOUBLE / nullif(w_delta, 0) AS price_response FROM ww""",
}
