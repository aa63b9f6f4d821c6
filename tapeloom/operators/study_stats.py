"""Statistics of the studies: cells, independent units, net outcomes, rotation tests, seasonality, rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeloom.functions.timing import bucket
from tapeloom.operators.labels import thinned

DAY_MS, HOUR_MS = 86_400_000, 3_600_000
RAN = ("hypothesis", "counter", "neither")


def units(members: DataFrame, out: str, gap_ms: int, span_ms: int) -> DataFrame:
    """Z3: of each chained episode of a population and instrument the earliest member whose race ran, then greedy thinning."""
    keys = ["pair", "instrument"]
    w = W.partitionBy(*keys).orderBy("decision_ms", "event_seq")
    m = members.withColumn("new", F.coalesce((F.col("decision_ms") - F.lag("decision_ms").over(w) >= gap_ms).cast("int"), F.lit(1)))
    m = m.withColumn("episode", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    first = m.where(F.col(out).isin(*RAN)).groupBy(*keys, "episode").agg(F.min(F.struct("decision_ms", "event_seq")).alias("f"))
    rows = first.select(*keys, "f.decision_ms", "f.event_seq", F.lit(span_ms).cast("long").alias("span_ms"))
    return thinned(rows, keys, span="span_ms").where("clear").select(*keys, "decision_ms", "event_seq")


def cells(members: DataFrame, horizons: list[str]) -> DataFrame:
    """Counts per population, split and horizon."""
    splits = F.array(*[F.struct(F.lit(k).alias("split"), v.alias("value")) for k, v in (("all", F.lit("all")), ("regime", F.col("regime")), ("location", F.col("location")))])
    outs = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"out_{h}").alias("out")) for h in horizons])
    m = members.select("pair", F.explode(splits).alias("s"), outs.alias("o")).select("pair", "s.*", F.explode("o").alias("o")).select("pair", "split", "value", "o.*")
    return m.groupBy("pair", "split", "value", "horizon").agg(F.count("*").alias("members"), *[F.count_if(F.col("out") == x).alias(f"n_{x}") for x in RAN])


def sample_needed(found: DataFrame, z: float = 1.96) -> DataFrame:
    """Members needed to tell a cell's mean tilt from zero: ceil((z / mu) ** 2)."""
    ran = F.nullif(F.col("n_hypothesis") + F.col("n_counter") + F.col("n_neither"), F.lit(0))
    mu = (F.col("n_hypothesis") - F.col("n_counter")) / ran
    return found.where("split = 'all'").select("pair", "horizon", mu.alias("mu"), F.ceil(F.pow(F.lit(z) / F.nullif(mu, F.lit(0.0)), F.lit(2.0))).alias("needed"))


def net_results(rows: DataFrame, h: str, fee_bps: float) -> DataFrame:
    """Gross result in half-widths (a race that ended at neither by its mark), the fee in the same unit, and net."""
    sign = F.when(F.col("hypothesis") == "upper", 1.0).otherwise(-1.0)
    out = F.col(f"out_{h}")
    gross = F.when(out == "hypothesis", 1.0).when(out == "counter", -1.0).when(out == "neither", sign * F.col(f"mark_{h}"))
    fee = F.lit(fee_bps) / F.nullif(F.col(f"half_bps_{h}"), F.lit(0.0))
    return rows.select("pair", "instrument", "event_seq", "decision_ms", gross.alias("gross"), fee.alias("fee"), (gross - fee).alias("net")).where("net IS NOT NULL")


def daily_sums(rows: DataFrame, time: str, value: str) -> DataFrame:
    """day_no, s, n of the days that have rows; one row per day."""
    d = rows.groupBy(bucket(F.col(time), DAY_MS).alias("day_ms")).agg(F.sum(value).alias("s"), F.count("*").alias("n"))
    return d.withColumn("day_no", F.row_number().over(W.orderBy("day_ms")) - 1)


def survival(states: DataFrame) -> DataFrame:
    """Per number of closes outside: runs at risk, runs that ended there, and the hazard."""
    w = W.partitionBy("instrument", "day_ms").orderBy("bar_ms")
    s = states.withColumn("new", F.coalesce((F.col("region") != F.lag("region").over(w)).cast("int"), F.lit(1)))
    s = s.withColumn("run", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0))).where("region != 'inside'")
    runs = s.groupBy("instrument", "day_ms", "run").agg(F.count("*").cast("int").alias("length"))
    per = runs.withColumn("closes", F.explode(F.sequence(F.lit(1), F.col("length"))))
    return per.groupBy("closes").agg(F.count("*").alias("at_risk"), F.count_if(F.col("closes") == F.col("length")).alias("ended")).withColumn("hazard", F.col("ended") / F.col("at_risk"))


def homogeneity(rows: DataFrame, group: str, cls: Column, least: int = 5) -> DataFrame:
    """Pearson's X2 of a two-class table over groups; evaluable when every expected count is ``least`` or more."""
    t = rows.groupBy(F.col(group).alias("g")).agg(F.count("*").alias("n"), F.count_if(cls).alias("a"))
    every = t.agg(F.sum("n").alias("all_n"), F.sum("a").alias("all_a"))  # one row
    t = t.join(F.broadcast(every))
    e1 = F.col("n") * F.col("all_a") / F.col("all_n")
    e0 = F.col("n") - e1
    return t.agg(F.sum(F.pow(F.col("a") - e1, 2) / e1 + F.pow(F.col("n") - F.col("a") - e0, 2) / e0).alias("x2"), (F.count("*") - 1).alias("df"), (F.min(F.least(e1, e0)) >= least).alias("evaluable"))


def seasonal(moves: DataFrame, slot: str) -> DataFrame:
    """Volatility per slot by three estimators (pooled, geometric, log-range), each over that of all slots.

    moves: slot, r (return), lr (log of high over low, above 0)."""
    est = [F.sqrt(F.avg(F.col("r") * F.col("r"))).alias("pooled"), F.exp(F.avg(F.log("lr"))).alias("geometric"), F.sqrt(F.avg(F.col("lr") * F.col("lr"))).alias("log_range")]
    every = moves.agg(*est).select(*[F.col(c).alias(f"all_{c}") for c in ("pooled", "geometric", "log_range")])  # one row
    per = moves.groupBy(slot).agg(F.count("*").alias("n"), *est).join(F.broadcast(every))
    return per.select(slot, "n", *[(F.col(c) / F.col(f"all_{c}")).alias(c) for c in ("pooled", "geometric", "log_range")])


def variance_shares(rows: DataFrame, groups: list[str], value: str) -> DataFrame:
    """Per grouping the share of the total sum of squares that lies between groups, and the adjusted R2."""
    out = None
    for g in groups:
        per = rows.groupBy(F.col(g).alias("g")).agg(F.count("*").alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"))
        n, s, q, k = F.sum("n"), F.sum("s"), F.sum("q"), F.count("*")
        total = q - s * s / n
        share = (F.sum(F.col("s") * F.col("s") / F.col("n")) - s * s / n) / total
        one = per.agg(F.lit(g).alias("grouping"), share.alias("share"), (1 - (1 - share) * (n - 1) / (n - k)).alias("adjusted_r2"))
        out = one if out is None else out.unionByName(one)
    return out


def stability(rows: DataFrame, slot: str, half: str, value: str) -> DataFrame:
    """A profile's correlation, largest and root mean square difference between two halves."""
    p = rows.groupBy(slot).agg(F.avg(F.when(F.col(half) == 0, F.col(value))).alias("a"), F.avg(F.when(F.col(half) == 1, F.col(value))).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    d = F.col("a") - F.col("b")
    return p.agg(F.corr("a", "b").alias("corr"), F.max(F.abs(d)).alias("max_difference"), F.sqrt(F.avg(d * d)).alias("rms_difference"), F.count("*").alias("slots"))


def alert_volume(events: DataFrame, time: str) -> DataFrame:
    """Nearest-rank percentiles of events per day that has some, and the busiest hour that begins with an event."""
    per = events.groupBy(bucket(F.col(time), DAY_MS).alias("day_ms")).agg(F.count("*").alias("n"))
    w = W.partitionBy(bucket(F.col(time), DAY_MS)).orderBy(time).rangeBetween(0, HOUR_MS - 1)
    busy = events.select(F.count("*").over(w).alias("c")).agg(F.max("c").alias("busiest_hour"))  # one row
    ranks = [F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY n)").alias(f"p{int(q * 100)}") for q in (0.5, 0.95)]
    return per.agg(F.count("*").alias("days"), *ranks, F.max("n").alias("most")).join(F.broadcast(busy))


def ar1(days: DataFrame, value: str) -> DataFrame:
    """Slope and correlation of a daily series on the day before; days without rows break it."""
    a = days.select("day_ms", F.col(value).alias("y"))
    b = days.select((F.col("day_ms") + DAY_MS).alias("day_ms"), F.col(value).alias("x"))
    return a.join(b, "day_ms").agg(F.regr_slope("y", "x").alias("slope"), F.corr("x", "y").alias("corr"), F.count("*").alias("n"))
