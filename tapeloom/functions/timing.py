"""As-of joins and prefix sums in two levels, so that no window holds one instrument's whole history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DAY_MS = 86_400_000
#: Width of the buckets of rows that are ordered by ids instead of times.
ID_WIDTH = 65_536


def bucket(c: Column, width: int) -> Column:
    return (c - F.pmod(c, F.lit(width))).cast("long")


def prefix_sums(df: DataFrame, keys: list[str], time: str, order: list[str], values: dict[str, str], width: int = DAY_MS, peers: bool = False) -> DataFrame:
    """Adds ``values`` (column -> new name), running sums over each key in ``order`` (which begins with ``time``); with ``peers`` rows that
    are equal in ``order`` all have the sum up to the last of them.

    Sums per time bucket are carried by a window over the buckets, and added to the running sums within each bucket.
    """
    df, each = df.withColumn("__b", bucket(F.col(time), width)), range(len(values))
    per = df.groupBy(*keys, "__b").agg(*[F.sum(v).alias(f"__s{i}") for i, v in enumerate(values)])
    w = W.partitionBy(*keys).orderBy("__b").rowsBetween(W.unboundedPreceding, 0)
    per = per.select(*keys, "__b", *[(F.sum(f"__s{i}").over(w) - F.col(f"__s{i}")).alias(f"__before{i}") for i in each])
    w = W.partitionBy(*keys, "__b").orderBy(*order)
    w = (w.rangeBetween if peers else w.rowsBetween)(W.unboundedPreceding, 0)
    df = df.withColumns({f"__in{i}": F.sum(v).over(w) for i, v in enumerate(values)}).join(per, [*keys, "__b"])
    df = df.withColumns({n: F.col(f"__before{i}") + F.col(f"__in{i}") for i, n in enumerate(values.values())})
    return df.drop("__b", *[f"{c}{i}" for c in ("__in", "__before") for i in each])


def prefix_sum(df: DataFrame, keys: list[str], time: str, order: list[str], value: str, out: str, width: int = DAY_MS, peers: bool = False) -> DataFrame:
    """Adds ``out``, the running sum of ``value``: prefix_sums() of one column."""
    return prefix_sums(df, keys, time, order, {value: out}, width, peers)


def numbered(df: DataFrame, keys: list[str], time: str, order: list[str], out: str, width: int = DAY_MS) -> DataFrame:
    """Adds ``out``, the number of each row (from 1) of its key in ``order``, which begins with ``time``."""
    return prefix_sum(df.withColumn("__one", F.lit(1)), keys, time, order, "__one", out, width).drop("__one")


def lagged(df: DataFrame, keys: list[str], time: str, order: list[str], values: dict[str, str], width: int = DAY_MS) -> DataFrame:
    """Adds ``values`` (column -> new name) of the row before in ``order``, which begins with ``time``; null in a key's first row.

    Keys and times aren't null. The last row of each time bucket is carried to the next by a window with one row per bucket.
    """
    df = df.withColumns({"__b": bucket(F.col(time), width), "__v": F.struct(*[F.col(c).alias(n) for c, n in values.items()])})
    ends = df.groupBy(*keys, "__b").agg(F.max_by("__v", F.struct(*order)).alias("__end"))
    ends = ends.select(*keys, "__b", F.lag("__end").over(W.partitionBy(*keys).orderBy("__b")).alias("__carry"))
    df = df.withColumn("__p", F.lag("__v").over(W.partitionBy(*keys, "__b").orderBy(*order))).join(ends, [*keys, "__b"])
    before = F.coalesce("__p", "__carry")
    return df.withColumns({n: before[n] for n in values.values()}).drop("__b", "__v", "__p", "__carry")


def max_before(df: DataFrame, keys: list[str], time: str, order: list[str], value: str, out: str, width: int = DAY_MS) -> DataFrame:
    """Adds ``out``, the largest ``value`` of all rows before in ``order``, which begins with ``time``; null in a key's first row."""
    df = df.withColumn("__b", bucket(F.col(time), width))
    per = df.groupBy(*keys, "__b").agg(F.max(value).alias("__m"))
    earlier = F.max("__m").over(W.partitionBy(*keys).orderBy("__b").rowsBetween(W.unboundedPreceding, -1))
    per = per.select(*keys, "__b", earlier.alias("__carry"))
    inside = F.max(value).over(W.partitionBy(*keys, "__b").orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    return df.withColumn("__in", inside).join(per, [*keys, "__b"]).withColumn(out, F.greatest("__in", "__carry")).drop("__b", "__in", "__carry")


def asof(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_time: str,
    right_time: str,
    values: dict[str, str],
    forward: bool = False,
    strict: bool = False,
    tie: str | None = None,
    width: int = DAY_MS,
) -> DataFrame:
    """Each row of ``left`` with ``values`` (column of right -> new name) of the last row of ``right`` at or before its time.

    ``forward`` takes the first row at or after; ``strict`` excludes equal times; ``tie`` orders right rows of one
    time. Both sides are merged within time buckets; the last (first) row of each bucket is carried on by a window
    that has one row per bucket.
    """
    sign = -1 if forward else 1
    found = F.struct(*[F.col(c).alias(n) for c, n in values.items()])
    rank = F.col(tie) * sign if tie else F.lit(0)
    r = right.select(*keys, (F.col(right_time) * sign).alias("__t"), F.lit(2 if strict else 0).alias("__k"), rank.cast("long").alias("__tie"), found.alias("__v"))
    lt = left.withColumn("__t", F.col(left_time) * sign)
    every = lt.withColumns({"__k": F.lit(1), "__tie": F.lit(0).cast("long"), "__v": F.lit(None).cast(r.schema["__v"].dataType)})
    every = every.unionByName(r, allowMissingColumns=True).withColumn("__b", bucket(F.col("__t"), width))
    inside = F.last("__v", ignorenulls=True).over(
        W.partitionBy(*keys, "__b").orderBy("__t", "__k", "__tie").rowsBetween(W.unboundedPreceding, 0)
    )
    every = every.withColumn("__in", inside)
    ends = every.groupBy(*keys, "__b").agg(F.max_by("__v", F.when(F.col("__v").isNotNull(), F.struct("__t", "__k", "__tie"))).alias("__end"))
    carried = F.last("__end", ignorenulls=True).over(W.partitionBy(*keys).orderBy("__b").rowsBetween(W.unboundedPreceding, -1))
    ends = ends.select(*keys, "__b", carried.alias("__carry"))
    out = every.where("__k = 1").join(ends, [*keys, "__b"], "left").withColumn("__v", F.coalesce("__in", "__carry"))
    return out.select(*left.columns, *[F.col(f"__v.{n}").alias(n) for n in values.values()])
