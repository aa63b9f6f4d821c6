"""Order book reconstruction and what is read from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeloom.functions.timing import ID_WIDTH, asof, lagged, prefix_sum


def level_life(updates: DataFrame) -> DataFrame:
    """K1: (instrument, side, price, qty, valid_from, valid_to) from level updates in order of seq; quantity 0 removes a level."""
    w = W.partitionBy("instrument", "epoch", "side", "price").orderBy("seq")
    u = updates.withColumn("valid_to", F.lead("seq").over(w))
    ends = updates.groupBy("instrument", "epoch").agg((F.max("seq") + 1).alias("epoch_end"))
    u = u.join(ends, ["instrument", "epoch"]).withColumn("valid_to", F.coalesce("valid_to", "epoch_end"))
    return u.where("qty > 0").select("instrument", "epoch", "side", "price", "qty", F.col("seq").alias("valid_from"), "valid_to")


def epochs(updates: DataFrame) -> DataFrame:
    """K1: adds epoch, the number of breaks of the id chain so far (prev_id is not the id before)."""
    u = lagged(updates, ["instrument"], "seq", ["seq"], {"seq": "p"}, ID_WIDTH)
    u = u.withColumn("broken", F.coalesce((F.col("p") != F.col("prev_id")).cast("long"), F.lit(0).cast("long")))
    return prefix_sum(u, ["instrument"], "seq", ["seq"], "broken", "epoch", ID_WIDTH, peers=True).drop("p", "broken")


def align_snapshots(snapshots: DataFrame, diffs: DataFrame, width: int = 512) -> DataFrame:
    """K2: per snapshot (instrument, snapshot_id) the first diff (first_id, last_id) that ends at or after it, and its state: 'aligned'
    where that diff straddles the id, 'too_old' where it begins beyond it, 'waiting' where no diff is left.

    Both meet in buckets of ``width`` ids by the diffs' last ids; the first diff of later buckets is carried back.
    """
    key = ["instrument", "snapshot_id"]
    found = asof(snapshots.select(*key), diffs, ["instrument"], "snapshot_id", "last_id", {"first_id": "first_id", "last_id": "last_id"}, forward=True, width=width)
    state = F.when(F.col("last_id").isNull(), "waiting").when(F.col("first_id") > F.col("snapshot_id"), "too_old").otherwise("aligned")
    return found.select(*key, "first_id", "last_id", state.alias("state"))


def books_at(life: DataFrame, moments: DataFrame, width: int = 512) -> DataFrame:
    """The levels that stand at each moment (instrument, at_seq). Lives and moments meet in buckets of ``width`` sequence numbers."""
    spanned = life.withColumn("step", F.explode(F.sequence(F.floor(F.col("valid_from") / width), F.floor((F.col("valid_to") - 1) / width))))
    m = moments.withColumn("step", F.floor(F.col("at_seq") / width))
    return m.join(spanned, ["instrument", "step"]).where("valid_from <= at_seq AND valid_to > at_seq").drop("step")


def best(books: DataFrame) -> DataFrame:
    """K3, K4: best and deepest bid and ask of each moment."""
    side = lambda s: F.when(F.col("side") == s, F.col("price"))
    return books.groupBy("instrument", "at_seq").agg(F.max(side("bid")).alias("bid"), F.min(side("ask")).alias("ask"), F.min(side("bid")).alias("deepest_bid"), F.max(side("ask")).alias("deepest_ask"))


def depth_walk(books: DataFrame, qty: int) -> DataFrame:
    """K5: quantity filled and notional of consuming ``qty`` from the best price outward, per moment and side."""
    outward = F.when(F.col("side") == "ask", F.col("price")).otherwise(-F.col("price"))
    w = W.partitionBy("instrument", "at_seq", "side").orderBy(outward).rowsBetween(W.unboundedPreceding, 0)
    b = books.withColumn("before", F.sum("qty").over(w) - F.col("qty"))
    take = F.greatest(F.lit(0), F.least(F.lit(qty) - F.col("before"), F.col("qty")))
    return b.withColumn("take", take).groupBy("instrument", "at_seq", "side").agg(F.sum("take").cast("long").alias("filled"), F.sum(F.col("take") * F.col("price")).cast("long").alias("notional"))


def compare(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """K6: levels that are missing, extra or of another quantity in b."""
    one, two = a.select(*keys, F.col("qty").alias("qty_a")), b.select(*keys, F.col("qty").alias("qty_b"))
    j = one.join(two, keys, "full_outer").where(~F.col("qty_a").eqNullSafe(F.col("qty_b")))
    return j.withColumn("difference", F.when(F.col("qty_b").isNull(), "missing").when(F.col("qty_a").isNull(), "extra").otherwise("quantity"))


def bands(books: DataFrame, bps: list[int]) -> DataFrame:
    """K7: depth by side within each band around the mid, and imbalance; empty sides make no mid."""
    m = best(books).where("bid IS NOT NULL AND ask IS NOT NULL").select("instrument", "at_seq", (F.col("bid") + F.col("ask")).alias("mid2"))
    b = books.join(m, ["instrument", "at_seq"]).withColumn("bps", F.explode(F.array(*[F.lit(x) for x in bps])))
    b = b.where(F.abs(2 * F.col("price") - F.col("mid2")) * 10_000 <= F.col("mid2") * F.col("bps"))
    side = lambda s: F.sum(F.when(F.col("side") == s, F.col("qty")).otherwise(0)).cast("long")
    out = b.groupBy("instrument", "at_seq", "bps").agg(side("bid").alias("bid_qty"), side("ask").alias("ask_qty"))
    return out.withColumn("imbalance", (F.col("bid_qty") - F.col("ask_qty")) / (F.col("bid_qty") + F.col("ask_qty")))


def clusters(books: DataFrame, n: int = 5) -> DataFrame:
    """The n largest levels per side, with the lower median level of the side."""
    key = ["instrument", "at_seq", "side"]
    med = books.groupBy(*key).agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY qty)").cast("long").alias("median_qty"))
    w = W.partitionBy(*key).orderBy(F.desc("qty"), "price")
    return books.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).join(med, key).select(*key, "rank", "price", "qty", "median_qty")
