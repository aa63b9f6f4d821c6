"""Registered queries: resampled means and the rotation null, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeloom.functions.timing import bucket
from tapeloom.operators import resampling as R
from tapeloom.operators import study_stats as Z
from tapeloom.plans.outcome_queries import raced, samples
from tapeloom.plans.study_relations import YR, members
from tapeloom.plans.study_statistics import NT, net
from tapeloom.sources.tape import DAY_MS

SEED, N_MIN, SCALE = 1, 100, 1_000_000_000


def shipped(s, d):
    """Shipped lines per day as a series of the calendar: discounts above (+) and below 5 %, days numbered."""
    li = s.read.parquet(f"{d}/lineitem.parquet")
    points = F.round((F.col("l_discount") - 0.05) * 100).cast("long")
    t = li.groupBy(F.to_date("l_shipdate").alias("day")).agg(F.sum(points).alias("s"), F.count("*").alias("n"))
    return t.withColumn("day_no", F.row_number().over(W.orderBy("day")) - 1)


def resampled(days):
    return reduce(lambda a, b: a.unionByName(b), [R.block_bootstrap(days, b, R.DRAWS, SEED) for b in R.BLOCKS])


def shipped_interval(s, d):
    days = shipped(s, d)
    return R.interval(resampled(days), days.agg(F.sum("n")).first()[0] or 0, N_MIN)


def net_days(s, d):
    """Net results per day in whole units of 1 / SCALE."""
    days = Z.daily_sums(net(s, d), "decision_ms", "net")
    return days.withColumn("s", F.round(F.col("s") * SCALE).cast("long"))


def net_means(s, d):
    return resampled(net_days(s, d)).withColumn("mean", F.col("mean") / SCALE)


def rotations(s, d):
    ends = samples(s, d).select("instrument", "event_seq", "bar_end_ms")
    m = members(s, d).where("pair IN ('P1-buy', 'P1-sell')").join(ends, ["instrument", "event_seq"])
    m = m.select("instrument", "bar_end_ms", F.when(F.col("hypothesis") == "upper", 1).otherwise(-1).alias("sign"))
    value = F.when(F.col("race") == "upper", 1).when(F.col("race") == "lower", -1).when(F.col("race") == "neither", 0)
    r = raced(s, d).where("horizon = '4h'").select("instrument", "event_seq", value.alias("value")).where("value IS NOT NULL").join(ends, ["instrument", "event_seq"])
    r = r.select("instrument", "bar_end_ms", "value")
    return R.rotation_table(m, r, R.ROTATION_WEEKS[0]).unionByName(R.rotation_table(m, r, R.ROTATION_WEEKS[1]))


def neither_errors(s, d):
    """Share of races per horizon that neither barrier ended, and its standard error among resampled days."""
    o = raced(s, d).where("race IN ('upper', 'lower', 'neither')")
    found = []
    for h in ("4h", "12h", "1d"):
        t = o.where(F.col("horizon") == h).groupBy(bucket(F.col("decision_ms"), DAY_MS).alias("day_ms")).agg(F.count_if(F.col("race") == "neither").alias("s"), F.count("*").alias("n"))
        t = t.withColumn("day_no", F.row_number().over(W.orderBy("day_ms")) - 1)
        error = R.block_bootstrap(t, R.BLOCKS[0], R.DRAWS, SEED).agg(F.round(F.stddev_samp("mean"), 9).alias("error"))
        found.append(t.agg((F.sum("s") / F.sum("n")).alias("neither"), F.sum("n").alias("n")).join(error).withColumn("horizon", F.lit(h)))  # one row each
    return reduce(lambda a, b: a.unionByName(b), found)


QUERIES = {
    "z7_block_bootstrap": lambda s, d: resampled(shipped(s, d)),
    "z8_interval": shipped_interval,
    "z11_net_expectancy": net_means,
    "z13_rotation_scores": lambda s, d: rotations(s, d).drop("length"),
    "z13_rotation_p": lambda s, d: R.rotation_p(rotations(s, d), R.ROTATION_DRAWS, SEED),
    "z27_neither_errors": neither_errors,
}


def boot(days: str, name: str = "bm", blocks: tuple[int, ...] = R.BLOCKS) -> str:
    """Relation ``name`` (block, draw, mean) from relation ``days`` (day_no, s, n): every drawn day is joined by itself."""
    lengths = ", ".join(f"({b})" for b in blocks)
    return f"""{name}_c AS (SELECT count(*) AS c FROM {days}),
{name}_k AS (SELECT block, draw, k, ('0x' || left(sha256(concat_ws('|', {SEED}, block, draw, k)), 12))::BIGINT % c AS a, least(block, c - k * block) AS len, c
  FROM {name}_c, (VALUES {lengths}) v(block), range({R.DRAWS}) r(draw), range(1000) q(k) WHERE k * block < c),
{name}_d AS (SELECT block, draw, (a + unnest(range(len))) % c AS day_no, c FROM {name}_k),
{name} AS (SELECT block, draw, sum(s)::DOUBLE / nullif(sum(n), 0) AS mean FROM {name}_d JOIN {days} USING (day_no) GROUP BY 1, 2)"""


SHIPPED = "sd AS (SELECT row_number() OVER (ORDER BY day) - 1 AS day_no, s, n FROM (SELECT l_shipdate::DATE AS day, sum(CAST(round((l_discount - 0.05) * 100) AS BIGINT)) AS s, count(*) AS n FROM lineitem GROUP BY 1))"
DAYS = "SELECT decision_ms - decision_ms % {day} AS day_ms, {s} AS s, count(*) AS n FROM {of} GROUP BY 1"
NET = f"{NT}, nd AS (SELECT row_number() OVER (ORDER BY day_ms) - 1 AS day_no, CAST(round(s * {SCALE}) AS BIGINT) AS s, n FROM ({DAYS.format(day=DAY_MS, s='sum(net)', of='nt')}))"
ROT = f"""{YR}, zm AS (SELECT m.instrument, sm.bar_end_ms AS t, CASE hypothesis WHEN 'upper' THEN 1 ELSE -1 END AS sign FROM ym m JOIN sm USING (instrument, event_seq) WHERE pair IN ('P1-buy', 'P1-sell')),
zv AS (SELECT instrument, sm.bar_end_ms AS t, CASE race WHEN 'upper' THEN 1 WHEN 'lower' THEN -1 ELSE 0 END AS value FROM rc JOIN sm USING (instrument, event_seq) WHERE horizon = '4h' AND race IN ('upper', 'lower', 'neither')),
zw AS (SELECT min(t) - (min(t) - {R.MONDAY_MS}) % {R.WEEK_MS} AS f, max(t) AS l FROM zv),
zb AS (SELECT weeks, instrument, sign, t, (t - f) // {R.WEEK_MS} // weeks AS block, (t - f) // {R.WEEK_MS} % weeks AS week, least(weeks, (l - f) // {R.WEEK_MS} + 1 - (t - f) // {R.WEEK_MS} // weeks * weeks) AS length
  FROM zm, zw, (VALUES ({R.ROTATION_WEEKS[0]}), ({R.ROTATION_WEEKS[1]})) v(weeks) WHERE t BETWEEN f AND l),
zk AS (SELECT *, unnest(range(length)) AS rotation FROM zb),
zt AS (SELECT weeks, block, rotation, length, CAST(sum(sign * value) AS BIGINT) AS score, count(*) AS n
  FROM zk JOIN zv ON zv.instrument = zk.instrument AND zv.t = zk.t + ((week + rotation) % length - week) * {R.WEEK_MS} GROUP BY ALL)"""


def _neither() -> str:
    parts, unions = [], []
    for i, h in enumerate(("4h", "12h", "1d")):
        rows = DAYS.format(day=DAY_MS, s="count(*) FILTER (WHERE race = 'neither')", of=f"(SELECT * FROM rc WHERE horizon = '{h}' AND race IN ('upper', 'lower', 'neither'))")
        parts.append(f"ne{i} AS (SELECT row_number() OVER (ORDER BY day_ms) - 1 AS day_no, s, n FROM ({rows})), {boot(f'ne{i}', f'nb{i}', R.BLOCKS[:1])}")
        unions.append(f"SELECT (SELECT sum(s)::DOUBLE / sum(n) FROM ne{i}) AS neither, (SELECT CAST(sum(n) AS BIGINT) FROM ne{i}) AS n, round(stddev_samp(mean), 9) AS error, '{h}' AS horizon FROM nb{i}")
    return f"{YR}, {', '.join(parts)} {' UNION ALL '.join(unions)}"


SQL = {
    "z7_block_bootstrap": f"WITH {SHIPPED}, {boot('sd')} SELECT * FROM bm",
    "z8_interval": f"""WITH {SHIPPED}, {boot('sd')}, q AS (SELECT block, list_sort(list(mean)) AS m, count(*) AS draws FROM bm GROUP BY 1)
      SELECT block, m[CAST(ceil(0.025 * draws) AS BIGINT)] AS lo, m[CAST(ceil(0.975 * draws) AS BIGINT)] AS hi, 0 AS undefined, draws,
        CASE WHEN (SELECT sum(n) FROM sd) < {N_MIN} THEN 'insufficient' WHEN lo > 0 THEN 'hypothesis' WHEN hi < 0 THEN 'counter' ELSE 'inconclusive' END AS reading FROM q""",
    "z11_net_expectancy": f"{NET}, {boot('nd')} SELECT block, draw, mean / {SCALE} AS mean FROM bm",
    "z13_rotation_scores": f"{ROT} SELECT weeks, block, rotation, score, n FROM zt",
    "z13_rotation_p": f"""{ROT}, za AS (SELECT DISTINCT weeks, block, length FROM zt),
      zx AS (SELECT weeks, draw, block, ('0x' || substr(sha256(concat_ws('|', {SEED}, weeks, draw, block // {R.PER_DIGEST})), 1 + 4 * (block % {R.PER_DIGEST}), 4))::BIGINT % length AS rotation FROM za, range({R.ROTATION_DRAWS}) r(draw)),
      zy AS (SELECT zx.weeks, draw, sum(coalesce(score, 0))::DOUBLE / nullif(sum(coalesce(n, 0)), 0) AS mean FROM zx LEFT JOIN zt USING (weeks, block, rotation) GROUP BY 1, 2),
      zo AS (SELECT weeks, sum(score)::DOUBLE / sum(n) AS observed FROM zt WHERE rotation = 0 GROUP BY 1)
      SELECT weeks, observed, count(*) FILTER (WHERE coalesce(mean >= observed, true)) AS above, count(*) FILTER (WHERE coalesce(mean <= observed, true)) AS below, count(*) AS draws,
        least(1.0, 2.0 * (1 + least(above, below)) / (draws + 1)) AS p FROM zy JOIN zo USING (weeks) GROUP BY 1, 2""",
    "z27_neither_errors": _neither(),
}
