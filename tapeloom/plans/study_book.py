"""Registered queries: order book, statistics and trade outcomes on the generic tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeloom.functions.tables import shared_folder
from tapeloom.functions.timing import ID_WIDTH, lagged
from tapeloom.operators import book as K
from tapeloom.operators import stats as Z
from tapeloom.operators.bars import time_bars
from tapeloom.plans.tape_sql import TAPE, bars
from tapeloom.sources import results as R
from tapeloom.sources.tape import DAY_MS, HOUR_MS, epoch_ms, raw_tape, trades

H, UNIT = HOUR_MS, 10_000_000_000


def updates(s, d):
    """Events as level updates: side by aggressor, price by tens, a quantity that is a multiple of 9 removes the level."""
    t = raw_tape(s, d)
    side = F.when(F.col("aggressor") == "buy", "bid").otherwise("ask")
    price = F.when(side == "bid", 49 - F.floor(F.col("price") / UNIT)).otherwise(50 + F.floor(F.col("price") / UNIT))
    qty = F.when(F.col("qty") % 9 == 0, 0).otherwise(F.col("qty"))
    t = lagged(t, ["instrument"], "trade_id", ["trade_id"], {"trade_id": "prev"}, ID_WIDTH)
    prev = F.when(F.col("trade_id") % 500 != 0, F.col("prev"))
    u = t.select("instrument", F.col("trade_id").alias("seq"), side.alias("side"), price.cast("long").alias("price"), qty.alias("qty"), prev.alias("prev_id"))
    return u.withColumn("prev_id", F.coalesce("prev_id", F.lit(-1).cast("long")))


def life(s, d):
    return K.level_life(K.epochs(updates(s, d)))


def books(s, d):
    m = updates(s, d).select("instrument", F.col("seq").alias("at_seq"))
    return K.books_at(life(s, d), m)


def daily(s, d):
    """Signed count and number of trades per day, days numbered."""
    t = trades(s, d).groupBy((F.col("ts_ms") - F.pmod("ts_ms", F.lit(DAY_MS))).alias("day_ms")).agg(F.sum(F.when(F.col("aggressor") == "buy", 1).otherwise(-1)).alias("s"), F.count("*").alias("n"))
    return t.withColumn("day_no", F.row_number().over(W.orderBy("day_ms")) - 1)


def pvalues(s, d):
    """One test per part brand: a p-value from its lineitem discounts."""
    li, p = s.read.parquet(f"{d}/lineitem.parquet"), s.read.parquet(f"{d}/part.parquet")
    j = li.join(p, li.l_partkey == p.p_partkey).groupBy("p_brand").agg((F.sum(F.round(F.col("l_discount") * 100).cast("long")) % 1000).alias("x"))
    return j.select("p_brand", (F.col("x") / 20_000.0).alias("p"))


def deals(s, d):
    """Orders as trades of a customer segment with a net result around their size."""
    o, c = s.read.parquet(f"{d}/orders.parquet"), s.read.parquet(f"{d}/customer.parquet")
    net = F.round(F.col("o_totalprice") * 100).cast("long") % 20_001 - 10_000
    return o.join(c, o.o_custkey == c.c_custkey).select("c_mktsegment", "o_orderkey", epoch_ms(o, "o_orderdate").alias("ts_ms"), net.alias("net"))


def strata(s, d):
    t = trades(s, d).withColumn("side", F.when(F.col("aggressor") == "buy", 1).otherwise(-1)).withColumn("hour", Z.hour_of_week(F.col("ts_ms")))
    return Z.tilt(t.where("qty > 60"), t.where("qty <= 60"), ["instrument", "hour"])


def experiments(s, d, engine: str):
    """One result per customer segment: counts and sums of its deals."""
    r = deals(s, d).groupBy(F.col("c_mktsegment").alias("spec")).agg(F.count("*").alias("n"), F.sum("net").alias("total"), F.count_if(F.col("net") > 0).alias("wins"))
    return r.withColumns({"pipeline": F.lit("deals@1"), "engine": F.lit(engine)})


def rerun(s, d):
    """Results recorded once, then again with two segments changed and a new engine's beside them: what the second run is told."""
    store, values = f"{shared_folder(s)}/results-{uuid.uuid4().hex}", ["n", "total", "wins"]
    R.record(experiments(s, d, "a"), store, values)
    changed = experiments(s, d, "a").withColumn("total", F.when(F.col("spec") < "C", F.col("total") + 1).otherwise(F.col("total")))
    return R.record(changed.unionByName(experiments(s, d, "b")), store, values)


QUERIES = {
    "w14_recorded_results": rerun,
    "k1_book_levels": life,
    "k4_best_prices": lambda s, d: K.best(books(s, d)),
    "k5_depth_walk": lambda s, d: K.depth_walk(books(s, d), 150),
    "k6_book_compare": lambda s, d: K.compare(books(s, d), books(s, d).where("qty > 10"), ["instrument", "at_seq", "side", "price"]),
    "k7_depth_bands": lambda s, d: K.bands(books(s, d), [1000, 2000, 5000]),
    "k10_clusters": lambda s, d: K.clusters(books(s, d)),
    "z1_state_runs": lambda s, d: Z.runs(trades(s, d), ["instrument"], "trade_id", "aggressor", ID_WIDTH),
    "z2_episodes": lambda s, d: Z.episodes(trades(s, d), ["instrument"], "ts_ms", H),
    "z5_hour_of_week": lambda s, d: trades(s, d).groupBy(Z.hour_of_week(F.col("ts_ms")).alias("hour")).agg(F.count("*").alias("n")),
    "z6_tilt": strata,
    "z12_drawdown": lambda s, d: Z.drawdown(deals(s, d), ["c_mktsegment"], ["ts_ms", "o_orderkey"], "net"),
    "z14_benjamini_hochberg": lambda s, d: Z.benjamini_hochberg(pvalues(s, d), "p", 0.05),
    "z18_autocorrelation": lambda s, d: Z.autocorrelation(daily(s, d), "day_no", "n", [1, 2, 7]),
    "w10_trade_metrics": lambda s, d: Z.trade_metrics(deals(s, d), ["c_mktsegment"], "net"),
    "w13_pooled_hours": lambda s, d: time_bars(trades(s, d), H).groupBy(F.pmod(F.col("bar_ms") / H, F.lit(24)).cast("int").alias("hour")).agg(F.sum("volume").alias("volume"), F.sum("n_trades").alias("n")),
}

UP = f"""WITH {TAPE}, u0 AS (SELECT instrument, trade_id AS seq, CASE WHEN aggressor = 'buy' THEN 'bid' ELSE 'ask' END AS side, CASE WHEN aggressor = 'buy' THEN 49 - price // {UNIT} ELSE 50 + price // {UNIT} END AS price,
  CASE WHEN qty % 9 = 0 THEN 0 ELSE qty END AS qty, lag(trade_id) OVER (PARTITION BY instrument ORDER BY trade_id) AS p FROM ev),
u1 AS (SELECT *, CASE WHEN p IS NOT NULL AND seq % 500 = 0 THEN 1 ELSE 0 END AS broken FROM u0), u AS (SELECT *, CAST(sum(broken) OVER (PARTITION BY instrument ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS epoch FROM u1),
lf AS (SELECT instrument, epoch, side, price, qty, seq AS valid_from, coalesce(lead(seq) OVER (PARTITION BY instrument, epoch, side, price ORDER BY seq), max(seq) OVER (PARTITION BY instrument, epoch) + 1) AS valid_to FROM u),
bk AS (SELECT m.instrument, m.seq AS at_seq, l.side, l.price, l.qty FROM u m JOIN lf l ON l.instrument = m.instrument AND l.valid_from <= m.seq AND l.valid_to > m.seq AND l.qty > 0),
bs AS (SELECT instrument, at_seq, max(price) FILTER (WHERE side = 'bid') AS bid, min(price) FILTER (WHERE side = 'ask') AS ask, min(price) FILTER (WHERE side = 'bid') AS deepest_bid, max(price) FILTER (WHERE side = 'ask') AS deepest_ask FROM bk GROUP BY 1, 2)"""
DY = f"WITH {TAPE}, dy AS (SELECT row_number() OVER (ORDER BY day_ms) - 1 AS day_no, * FROM (SELECT ts_ms - ts_ms % {DAY_MS} AS day_ms, sum(CASE WHEN aggressor = 'buy' THEN 1 ELSE -1 END) AS s, count(*) AS n FROM trades GROUP BY 1))"
DEALS = "WITH dl AS (SELECT c_mktsegment, o_orderkey, epoch_us(o_orderdate) // 1000 AS ts_ms, CAST(round(o_totalprice * 100) AS BIGINT) % 20001 - 10000 AS net FROM orders JOIN customer ON o_custkey = c_custkey)"

SQL = {
    "w14_recorded_results": f"""{DEALS}, r AS (SELECT c_mktsegment AS spec, count(*) AS n, sum(net) AS total, count(*) FILTER (WHERE net > 0) AS wins FROM dl GROUP BY 1), x AS (SELECT *, spec < 'C' AS other FROM r),
      h AS (SELECT spec, engine, other AND engine = 'a' AS other, list_transform([[n, total, wins], [n, total + 1, wins]], lambda v: sha256(array_to_string(list_transform(v, lambda y: length(y::VARCHAR) || ':' || y::VARCHAR), ''))) AS s FROM x, (VALUES ('a'), ('b')) e(engine))
      SELECT spec, 'deals@1' AS pipeline, engine, CASE WHEN other THEN s[2] ELSE s[1] END AS content, CASE WHEN engine = 'a' THEN s[1] END AS stored, CASE WHEN engine = 'b' THEN 'recorded' WHEN other THEN 'diverged' ELSE 'reproduced' END AS verdict FROM h""",
    "k1_book_levels": f"{UP} SELECT * FROM lf WHERE qty > 0",
    "k4_best_prices": f"{UP} SELECT * FROM bs",
    "k5_depth_walk": f"""{UP}, w AS (SELECT *, sum(qty) OVER (PARTITION BY instrument, at_seq, side ORDER BY CASE WHEN side = 'ask' THEN price ELSE -price END ROWS UNBOUNDED PRECEDING) - qty AS b FROM bk), t AS (SELECT *, greatest(0, least(150 - b, qty)) AS take FROM w)
      SELECT instrument, at_seq, side, CAST(sum(take) AS BIGINT) AS filled, CAST(sum(take * price) AS BIGINT) AS notional FROM t GROUP BY 1, 2, 3""",
    "k6_book_compare": f"{UP} SELECT instrument, at_seq, side, price, qty AS qty_a, CAST(NULL AS BIGINT) AS qty_b, 'missing' AS difference FROM bk WHERE qty <= 10",
    "k7_depth_bands": f"""{UP}, x AS (SELECT bk.*, bps, bid + ask AS m FROM bk JOIN bs USING (instrument, at_seq), (VALUES (1000), (2000), (5000)) v(bps) WHERE bid IS NOT NULL AND ask IS NOT NULL)
      SELECT instrument, at_seq, bps, CAST(sum(CASE WHEN side = 'bid' THEN qty ELSE 0 END) AS BIGINT) AS bid_qty, CAST(sum(CASE WHEN side = 'ask' THEN qty ELSE 0 END) AS BIGINT) AS ask_qty, sum(CASE WHEN side = 'bid' THEN qty ELSE -qty END)::DOUBLE / sum(qty) AS imbalance FROM x WHERE abs(2 * price - m) * 10000 <= m * bps GROUP BY 1, 2, 3""",
    "k10_clusters": f"""{UP}, md AS (SELECT instrument, at_seq, side, list_sort(list(qty)) AS q FROM bk GROUP BY 1, 2, 3) SELECT instrument, at_seq, side, CAST(row_number() OVER (PARTITION BY instrument, at_seq, side ORDER BY qty DESC, price) AS INTEGER) AS rank, price, qty, q[CAST(ceil(0.5 * len(q)) AS BIGINT)] AS median_qty FROM bk JOIN md USING (instrument, at_seq, side) QUALIFY rank <= 5""",
    "z1_state_runs": f"WITH {TAPE}, a AS (SELECT *, CASE WHEN aggressor = lag(aggressor) OVER w THEN 0 ELSE 1 END AS new FROM trades WINDOW w AS (PARTITION BY instrument ORDER BY trade_id)), b AS (SELECT *, CAST(sum(new) OVER (PARTITION BY instrument ORDER BY trade_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM a) SELECT instrument, run, aggressor, min(trade_id) AS first, max(trade_id) AS last, count(*) AS n FROM b GROUP BY 1, 2, 3",
    "z2_episodes": f"WITH {TAPE}, a AS (SELECT *, CASE WHEN ts_ms - lag(ts_ms) OVER w < {H} THEN 0 ELSE 1 END AS new FROM trades WINDOW w AS (PARTITION BY instrument ORDER BY ts_ms)), b AS (SELECT *, CAST(sum(new) OVER (PARTITION BY instrument ORDER BY ts_ms ROWS UNBOUNDED PRECEDING) AS BIGINT) AS episode FROM a) SELECT instrument, episode, min(ts_ms) AS first, max(ts_ms) AS last, count(*) AS n FROM b GROUP BY 1, 2",
    "z12_drawdown": f"{DEALS}, c AS (SELECT *, sum(net) OVER w AS cum FROM dl WINDOW w AS (PARTITION BY c_mktsegment ORDER BY ts_ms, o_orderkey ROWS UNBOUNDED PRECEDING)), p AS (SELECT *, greatest(0, max(cum) OVER (PARTITION BY c_mktsegment ORDER BY ts_ms, o_orderkey ROWS UNBOUNDED PRECEDING)) AS peak FROM c) SELECT c_mktsegment, CAST(max(peak - cum) AS BIGINT) AS max_drawdown, CAST(sum(net) AS BIGINT) AS total FROM p GROUP BY 1",
    "z14_benjamini_hochberg": """WITH t AS (SELECT p_brand, CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) % 1000 / 20000.0::DOUBLE AS p FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY p) AS rank, count(*) OVER () AS m FROM t)
      SELECT p_brand, p, coalesce(p <= (SELECT max(p) FROM r WHERE p <= rank * 0.05::DOUBLE / m), false) AS rejected FROM r""",
    "z18_autocorrelation": f"{DY} SELECT lag, corr(a.n, b.n) AS corr, count(*) AS n FROM dy a, (VALUES (1), (2), (7)) v(lag), dy b WHERE b.day_no = a.day_no + lag GROUP BY 1",
    "w10_trade_metrics": f"{DEALS} SELECT c_mktsegment, count(*) AS n, avg(net) AS expectancy, sum(net) FILTER (WHERE net > 0)::DOUBLE / -sum(net) FILTER (WHERE net < 0) AS profit_factor, count(*) FILTER (WHERE net > 0)::DOUBLE / count(*) AS win_rate FROM dl GROUP BY 1",
    "w13_pooled_hours": f"WITH {TAPE}, {bars(H)} SELECT CAST(bar_ms // {H} % 24 AS INTEGER) AS hour, CAST(sum(volume) AS BIGINT) AS volume, CAST(sum(n_trades) AS BIGINT) AS n FROM bars GROUP BY 1",
}
