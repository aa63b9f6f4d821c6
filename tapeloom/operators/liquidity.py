"""Books that begin from snapshots, their trusted windows, and liquidity flow by attribution of level changes to trades."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeloom.functions.shipping import ship
from tapeloom.functions.tables import written
from tapeloom.functions.timing import ID_WIDTH, asof, lagged, numbered, prefix_sum, prefix_sums

BANDS_BPS = (1, 2, 5)
LEVEL = ["instrument", "epoch", "side", "price"]


def snapshot_epochs(snapshots: DataFrame, diffs: DataFrame) -> DataFrame:
    """K2: each diff (instrument, seq, prev_id, ...) behind a snapshot with epoch (its snapshot's id) and whether it is ``live``.

    The first diff behind a snapshot must begin at or before its id, each later one at the id of the diff before. From the first
    that doesn't, no diff of the epoch is live: the book is unknown until the next snapshot. Diffs without a snapshot before them are gone.
    """
    ids = snapshots.select("instrument", "snapshot_id").distinct()
    d = asof(diffs, ids, ["instrument"], "seq", "snapshot_id", {"snapshot_id": "epoch"}, strict=True, width=ID_WIDTH).where("epoch IS NOT NULL")
    d = lagged(written(d, "epochs"), ["instrument", "epoch"], "seq", ["seq"], {"seq": "before"}, ID_WIDTH)
    bad = F.when(F.col("before").isNull(), F.col("prev_id") > F.col("epoch")).otherwise(F.col("prev_id") != F.col("before"))
    d = prefix_sum(written(d.withColumn("bad", bad.cast("long")), "breaks"), ["instrument", "epoch"], "seq", ["seq"], "bad", "breaks", ID_WIDTH, peers=True)
    return d.withColumn("live", F.col("breaks") == 0).drop("before", "bad", "breaks")


def epoch_states(snapshots: DataFrame, epochs: DataFrame) -> DataFrame:
    """K2, K3: per snapshot its state (aligned, too_old, waiting), its live diffs, where its book ends, and its trusted window.

    A book ends at the first diff that isn't live, or else with the next snapshot or after the last diff. Prices beyond the deepest bid and
    ask of the snapshot are unproven.
    """
    price = lambda side: F.when(F.col("side") == side, F.col("price"))
    windows = snapshots.groupBy("instrument", F.col("snapshot_id").alias("epoch")).agg(F.min(price("bid")).alias("trusted_low"), F.max(price("ask")).alias("trusted_high"))
    windows = windows.withColumn("next", F.lead("epoch").over(W.partitionBy("instrument").orderBy("epoch")))  # one row a snapshot
    per = epochs.groupBy("instrument", "epoch").agg(
        F.count_if("live").alias("n_live"), F.min(F.when(~F.col("live"), F.col("seq"))).alias("broken_at"), F.max("seq").alias("last"), F.min_by("live", "seq").alias("first_live")
    )
    out = windows.join(per, ["instrument", "epoch"], "left")
    state = F.when(F.col("last").isNull(), "waiting").when(F.col("first_live"), "aligned").otherwise("too_old")
    end = F.coalesce("broken_at", F.col("next") + 1, F.col("last") + 1, F.col("epoch") + 1)
    return out.select("instrument", "epoch", state.alias("state"), F.coalesce("n_live", F.lit(0)).alias("n_live"), end.alias("end_seq"), "trusted_low", "trusted_high")


def seeded_levels(snapshots: DataFrame, epochs: DataFrame, states: DataFrame) -> DataFrame:
    """K1: lives of levels (instrument, epoch, side, price, qty, valid_from, valid_to), begun from a snapshot and changed by its live diffs.

    Nothing stands between the end of an epoch and the next snapshot. Only aligned snapshots make a book. A window holds one level of one epoch.
    """
    good = states.where("state = 'aligned'").select("instrument", "epoch", "end_seq")
    seeds = snapshots.select("instrument", F.col("snapshot_id").alias("epoch"), F.col("snapshot_id").alias("seq"), "side", "price", "qty")
    every = seeds.unionByName(epochs.where("live").select("instrument", "epoch", "seq", "side", "price", "qty")).join(good, ["instrument", "epoch"])
    w = W.partitionBy(*LEVEL).orderBy("seq")
    every = every.withColumns({"valid_to": F.coalesce(F.lead("seq").over(w), F.col("end_seq")), "old": F.coalesce(F.lag("qty").over(w), F.lit(0))})
    return every.where("qty > 0").select(*LEVEL, "qty", F.col("seq").alias("valid_from"), "valid_to")


def _best(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Best bid and ask before each diff of rows that come by epoch in order; gone prices leave the heaps when they come up."""
    key, books, heaps = None, {}, {}

    def top(side: str, sign: int):
        heap, book = heaps[side], books[side]
        while heap and not book.get(sign * heap[0]):
            heappop(heap)
        return sign * heap[0] if heap else None

    for frame in frames:
        out = []
        for instrument, epoch, seq, side, price, qty, seed in zip(*(frame[c].tolist() for c in ("instrument", "epoch", "seq", "side", "price", "qty", "seed")), strict=True):
            if key != (instrument, epoch):
                key, books, heaps = (instrument, epoch), {"bid": {}, "ask": {}}, {"bid": [], "ask": []}
            if not seed:
                out.append((instrument, epoch, seq, top("bid", -1), top("ask", 1), books[side].get(price, 0)))
            books[side][price] = qty
            if qty:
                heappush(heaps[side], -price if side == "bid" else price)
        if out:
            yield pd.DataFrame(out, columns=["instrument", "epoch", "seq", "bid", "ask", "old"]).astype({"bid": "Int64", "ask": "Int64"})


def frames_before(snapshots: DataFrame, epochs: DataFrame, states: DataFrame) -> DataFrame:
    """Live diffs (one level each) with the best bid and ask and the level's quantity before them.

    Epochs are read in order by one task each, as a stream; what it holds is the book, not the epoch's diffs.
    """
    ship(snapshots.sparkSession)
    good = states.where("state = 'aligned'").select("instrument", "epoch")
    seeds = snapshots.select("instrument", F.col("snapshot_id").alias("epoch"), F.col("snapshot_id").alias("seq"), "side", "price", "qty", F.lit(True).alias("seed"))
    live = epochs.where("live").select("instrument", "epoch", "seq", "side", "price", "qty", F.lit(False).alias("seed"))
    every = seeds.unionByName(live).join(good, ["instrument", "epoch"])
    every = every.repartition("instrument", "epoch").sortWithinPartitions("instrument", "epoch", "seq", F.desc("seed"))
    before = every.mapInPandas(_best, "instrument long, epoch long, seq long, bid long, ask long, old long")
    return epochs.where("live").join(before, ["instrument", "epoch", "seq"])


def _attributed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Adds what each step of a level takes from its pending fills, carried ones first; steps come by level in order."""
    key, carried, last = None, 0, None
    for frame in frames:
        matched, unmatched = [], []
        for level, step, removed, fresh in zip(zip(*(frame[c].tolist() for c in LEVEL), strict=True), frame["step"].tolist(), frame["removed"].tolist(), frame["fresh"].tolist(), strict=True):
            if key != level or last != step - 1:
                carried = 0
            from_carried = min(removed, carried)
            from_fresh = min(removed - from_carried, fresh)
            matched.append(from_carried + from_fresh)
            unmatched.append(carried - from_carried)
            key, last, carried = level, step, fresh - from_fresh
        yield frame.assign(matched=matched, unmatched=unmatched).astype({"matched": "int64", "unmatched": "int64"})


def liquidity_flow(frames: DataFrame, trades: DataFrame, states: DataFrame, bands: tuple[int, ...] = BANDS_BPS) -> DataFrame:
    """K8: (instrument, epoch, seq, ts_ms, side, price, band, added, cancelled, filled, inferred) of each change of a level within a band around the mid before it.

    frames: live diffs from frames_before() with ts_ms; trades: instrument, seq, price, qty, aggressor. A buy fills at the ask, a sell at the bid. Trades are
    pending at their price until the next diff of the book, and for one more. A decrease is filled up to what is pending, carried fills first, and cancelled beyond; an
    increase is added. A carried fill that finds no decrease was replenished unseen: it is added, filled and inferred. Prices outside the
    trusted window or the widest band aren't accounted. Snapshots and breaks book nothing and drop what is pending.
    """
    ship(frames.sparkSession)
    f = written(numbered(frames.select(*LEVEL, "seq", "ts_ms", "qty", "bid", "ask", "old"), ["instrument", "epoch"], "seq", ["seq"], "step", ID_WIDTH), "steps")
    steps = f.select("instrument", "epoch", "seq", "step", "ts_ms", "bid", "ask")
    t = trades.select("instrument", F.col("seq").alias("trade_seq"), "price", "qty", F.when(F.col("aggressor") == "buy", "ask").otherwise("bid").alias("side"))
    t = asof(t, steps.select("instrument", "seq", "step", "epoch"), ["instrument"], "trade_seq", "seq", {"step": "step", "epoch": "epoch"}, forward=True, strict=True, width=ID_WIDTH)
    # the book must have been known when the trade came
    t = t.where("step IS NOT NULL").join(states.select("instrument", "epoch", "end_seq"), ["instrument", "epoch"]).where("trade_seq > epoch AND trade_seq < end_seq")
    fresh = t.groupBy(*LEVEL, "step").agg(F.sum("qty").alias("fresh"))
    zero = F.lit(0).cast("long")
    pending = F.explode(F.array(F.struct("step", "fresh"), F.struct((F.col("step") + 1).alias("step"), zero.alias("fresh"))))
    held = fresh.select(*LEVEL, pending.alias("p")).select(*LEVEL, "p.step", "p.fresh", zero.alias("removed"), zero.alias("more"))
    change = f.select(*LEVEL, "step", zero.alias("fresh"), F.greatest(zero, F.col("old") - F.col("qty")).alias("removed"), F.greatest(zero, F.col("qty") - F.col("old")).alias("more"))
    rows = held.unionByName(change)
    rows = rows.groupBy(*LEVEL, "step").agg(F.sum("fresh").alias("fresh"), F.sum("removed").alias("removed"), F.sum("more").alias("more"))
    # accounted or not follows from the mid before the step, as does whether there is such a step
    rows = rows.join(steps, ["instrument", "epoch", "step"]).join(states.select("instrument", "epoch", "trusted_low", "trusted_high"), ["instrument", "epoch"])
    mid2, widest = F.col("bid") + F.col("ask"), max(bands)
    off = F.abs(mid2 - 2 * F.col("price")) * 10_000
    near = F.coalesce((F.col("bid") < F.col("ask")) & (off <= widest * mid2) & F.col("price").between(F.col("trusted_low"), F.col("trusted_high")), F.lit(False))
    rows = rows.withColumns({"near": near, "removed": F.when(near, F.col("removed")).otherwise(0)})
    # all that later steps need goes through the task, so that rows aren't made twice
    dealt = rows.select(*LEVEL, "step", "removed", "fresh", "seq", "ts_ms", "more", "near", F.coalesce(mid2, zero).alias("mid2")).repartition(*LEVEL).sortWithinPartitions(*LEVEL, "step")
    schema = "instrument long, epoch long, side string, price long, step long, removed long, fresh long, seq long, ts_ms long, more long, near boolean, mid2 long, matched long, unmatched long"
    found = dealt.mapInPandas(_attributed, schema).where("near")
    out = found.withColumn("band", F.explode(F.array(*[F.lit(b) for b in bands]))).where(F.abs(F.col("mid2") - 2 * F.col("price")) * 10_000 <= F.col("band") * F.col("mid2"))
    out = out.select(*LEVEL, "seq", "ts_ms", "band", (F.col("more") + F.col("unmatched")).alias("added"), (F.col("removed") - F.col("matched")).alias("cancelled"), (F.col("matched") + F.col("unmatched")).alias("filled"), F.col("unmatched").alias("inferred"))
    return out.where("added > 0 OR cancelled > 0 OR filled > 0")


def flow_minutes(flow: DataFrame, minute_ms: int = 60_000) -> DataFrame:
    """K8: flow per side and band of each minute."""
    minute = (F.col("ts_ms") - F.pmod("ts_ms", F.lit(minute_ms))).alias("minute_ms")
    return flow.groupBy("instrument", minute, "side", "band").agg(*[F.sum(c).alias(c) for c in ("added", "cancelled", "filled", "inferred")])


def flow_windows(minutes: DataFrame, bad: DataFrame, widths: tuple[int, ...] = (5, 15, 60), minute_ms: int = 60_000) -> DataFrame:
    """K9: flow of the last ``widths`` minutes per side and band, at the end of each minute in which the instrument's book had flow or was unknown.

    minutes: flow_minutes(); bad: (instrument, ts_ms) of diffs that no known book could take. partial_start: the window reaches back to the first minute
    with flow or beyond; feed_gap: such a diff lies in it. A window is a difference of two running sums, looked up by time in buckets of days, so
    its length costs nothing, and quiet minutes need no rows.
    """
    sums, key = ["added", "cancelled", "filled", "inferred"], ["instrument", "side", "band"]
    end = (F.col("minute_ms") + minute_ms).alias("end_ms")
    lost = bad.select("instrument", (F.col("ts_ms") - F.pmod("ts_ms", F.lit(minute_ms))).alias("minute_ms")).groupBy("instrument", "minute_ms").agg(F.count("*").alias("lost"))
    minutes, lost = written(minutes, "minutes"), written(lost, "lost")
    kinds = minutes.select("side", "band").distinct()
    ends = minutes.select("instrument", "minute_ms").unionByName(lost.select("instrument", "minute_ms")).distinct().select("instrument", end)
    first = minutes.groupBy("instrument").agg(F.min("minute_ms").alias("first_ms"))
    ends = ends.withColumn("minutes", F.explode(F.array(*[F.lit(w) for w in widths]))).withColumn("from_ms", F.col("end_ms") - F.col("minutes") * minute_ms)
    ends = ends.join(first, "instrument").withColumn("partial_start", F.col("from_ms") <= F.col("first_ms")).drop("first_ms")
    ends = _since(ends, lost.select("instrument", end, "lost"), ["instrument"], ["lost"]).withColumn("feed_gap", F.col("lost") > 0).drop("lost")
    every = ends.join(F.broadcast(kinds))  # two sides and the stated bands
    flow = minutes.select(*key, end, *sums)
    out = _since(every, flow, key, sums).where(" OR ".join(f"{c} > 0" for c in sums))
    return out.select("instrument", "end_ms", "minutes", "side", "band", *sums, "partial_start", "feed_gap")


def _since(ends: DataFrame, rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """``ends`` with the sums of ``values`` of rows after from_ms, up to end_ms."""
    running = written(prefix_sums(rows, keys, "end_ms", ["end_ms"], {v: f"upto_{v}" for v in values}), "running")
    for name in ("end", "from"):
        ends = written(asof(ends, running, keys, f"{name}_ms", "end_ms", {f"upto_{v}": f"{name}_{v}" for v in values}), f"at-{name}")
    zero = F.lit(0)
    took = {v: (F.coalesce(f"end_{v}", zero) - F.coalesce(f"from_{v}", zero)).cast("long") for v in values}
    return ends.withColumns(took).drop(*[f"{n}_{v}" for n in ("end", "from") for v in values])
