"""Statistics over labelled records: tilts, bootstraps, multiple testing, trade outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeloom.functions.timing import DAY_MS, lagged, prefix_sum


def runs(rows: DataFrame, keys: list[str], order: str, state: str, width: int = DAY_MS) -> DataFrame:
    """Maximal stretches of an equal state; ``order`` is cut into buckets of ``width``."""
    r = lagged(rows, keys, order, [order, state], {state: "p"}, width)
    r = r.withColumn("new", F.coalesce((F.col(state) != F.col("p")).cast("int"), F.lit(1)))
    r = prefix_sum(r, keys, order, [order, state], "new", "run", width, peers=True)
    return r.groupBy(*keys, "run", state).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))


def episodes(rows: DataFrame, keys: list[str], order: str, gap: int, width: int = DAY_MS) -> DataFrame:
    """Chains of events that are less than ``gap`` apart; ``order`` is cut into buckets of ``width``."""
    r = lagged(rows, keys, order, [order], {order: "p"}, width)
    r = r.withColumn("new", F.coalesce((F.col(order) - F.col("p") >= gap).cast("int"), F.lit(1)))
    r = prefix_sum(r, keys, order, [order], "new", "episode", width, peers=True)
    return r.groupBy(*keys, "episode").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))


def hour_of_week(ms: Column, zone: str = "America/New_York") -> Column:
    """0 (Monday 00:00) to 167 on a local clock, whatever the session's zone is."""
    utc = F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(secs=(ms / 1000).cast("decimal(18,6)"))
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)
    return F.weekday(local) * 24 + F.hour(local)


def tilt(members: DataFrame, base: DataFrame, stratum: list[str]) -> DataFrame:
    """Mean side (+1 or -1) of members less that of the baseline, strata weighted by members; strata without baseline are counted."""
    b = base.groupBy(*stratum).agg(F.avg("side").alias("base"))
    m = members.groupBy(*stratum).agg(F.count("*").alias("n"), F.sum("side").alias("s")).join(b, stratum, "left")
    ok = F.col("base").isNotNull()
    return m.agg(
        F.sum(F.when(ok, F.col("n"))).alias("n"), F.sum(F.when(~ok, F.col("n"))).alias("dropped"),
        (F.sum(F.when(ok, F.col("s") - F.col("n") * F.col("base"))) / F.sum(F.when(ok, F.col("n")))).alias("tilt"),
    )


def drawdown(rows: DataFrame, keys: list[str], order: list[str], net: str) -> DataFrame:
    """Largest fall of the cumulative net below its peak so far (0 before the first row)."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    r = rows.withColumn("cum", F.sum(net).over(w))
    r = r.withColumn("peak", F.greatest(F.lit(0), F.max("cum").over(w)))
    return r.groupBy(*keys).agg(F.max(F.col("peak") - F.col("cum")).alias("max_drawdown"), F.sum(net).alias("total"))


def benjamini_hochberg(tests: DataFrame, p: str, q: float) -> DataFrame:
    """Adds rejected: p is at most the largest p with p <= rank * q / m. m is the number of tests of one study."""
    r = tests.withColumn("rank", F.row_number().over(W.orderBy(p)))
    m = tests.count()
    cut = r.where(F.col(p) <= F.col("rank") * q / m).agg(F.max(p).alias("cut"))
    return r.crossJoin(cut).select(*tests.columns, F.coalesce(F.col(p) <= F.col("cut"), F.lit(False)).alias("rejected"))


def autocorrelation(series: DataFrame, index: str, value: str, lags: list[int]) -> DataFrame:
    """Correlation of a series with itself at fixed lags; index is whole and dense."""
    b = series.select((F.col(index)).alias("i"), F.col(value).alias("y"))
    a = series.select(F.col(index).alias("i0"), F.col(value).alias("x")).withColumn("lag", F.explode(F.array(*[F.lit(k) for k in lags])))
    return a.withColumn("i", F.col("i0") + F.col("lag")).join(b, "i").groupBy("lag").agg(F.corr("x", "y").alias("corr"), F.count("*").alias("n"))


def trade_metrics(trades: DataFrame, keys: list[str], net: str) -> DataFrame:
    """Counts, expectancy, profit factor and win rate."""
    win, loss = F.sum(F.when(F.col(net) > 0, F.col(net))), -F.sum(F.when(F.col(net) < 0, F.col(net)))
    return trades.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(net).alias("expectancy"), (win / loss).alias("profit_factor"), (F.count_if(F.col(net) > 0) / F.count("*")).alias("win_rate"))
