"""The auction of a day against the value area of the day before: positions, probes, failures, acceptance, and what follows.

All prices are whole units. The value area holds prices from ``val`` up to but without ``vah``; around each edge lies a
neutral band of ``tolerance_bps`` of that edge.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeloom.functions.shipping import ship
from tapeloom.functions.timing import bucket

DAY_MS, MINUTE_MS = 86_400_000, 60_000
#: Width of the neutral bands in basis points, and closes beyond an edge that accept a probe or retire a failure.
TOLERANCE_BPS, CLOSES = 6, 60
REGIONS = {-1: "below", 0: "in", 1: "above"}
STATUS = (
    "instrument long, day_ms long, bar_ms long, close long, position string, accepted string, origin string, state string, side string, "
    "probe_toward string, probe_since_ms long, probe_closes long, failed_toward string, failed_closes long, failed_at_ms long, closes_back long"
)


def references(areas: DataFrame, bin_size: int, tolerance_bps: int = TOLERANCE_BPS) -> DataFrame:
    """Each day's value area as the next day's reference; valid where it is wider than both edge bands together.

    areas: instrument, day_ms, val, vah as bins, the last one included. A day without trades gives the next none.
    """
    a = areas.select("instrument", (F.col("day_ms") + DAY_MS).alias("day_ms"), (F.col("val") * bin_size).alias("val"), ((F.col("vah") + 1) * bin_size).alias("vah"))
    bands = (F.abs("vah") + F.abs("val")) * tolerance_bps
    return a.withColumn("valid", (F.col("vah") - F.col("val")) * 10_000 > bands)


class _Sides:
    """Where the closes of a day lie: beyond which edge, and whether clear of the bands."""

    def __init__(self, close: np.ndarray, val: int, vah: int, tolerance_bps: int):
        self.side = np.where(close >= vah, 1, np.where(close < val, -1, 0))
        self.high_edge = np.abs(close - vah) * 10_000 <= abs(vah) * tolerance_bps
        self.low_edge = ~self.high_edge & (np.abs(close - val) * 10_000 <= abs(val) * tolerance_bps)
        clear = ~(self.high_edge | self.low_edge)
        self.at = {r: np.flatnonzero(clear & (self.side == r)) for r in REGIONS}
        self.beyond = {r: np.flatnonzero(self.side == r) for r in REGIONS}
        self.n = len(close)

    def first_clear(self, since: int, *regions: int) -> int:
        """The first close from ``since`` on that is clear of the bands in one of the regions; n if none is."""
        hits = [a[k] for a in (self.at[r] for r in regions) if (k := np.searchsorted(a, since)) < len(a)]
        return int(min(hits, default=self.n))

    def nth_beyond(self, since: int, region: int, n: int) -> int:
        """The n-th close from ``since`` on that lies in the region, bands included."""
        a = self.beyond[region]
        k = int(np.searchsorted(a, since)) + n - 1
        return int(a[k]) if k < len(a) else self.n

    def counted(self, since: int, until: int, region: int) -> np.ndarray:
        """How many closes from ``since`` on lie in the region, at each close before ``until``."""
        return np.cumsum(self.side[since:until] == region)


def _walk(s: _Sides, closes: int) -> dict[str, np.ndarray]:
    """The accepted region, probe and failure after each close, found by jumps from one event to the next.

    Between events nothing but counts changes, so a stretch is filled at once: a quiet one lasts until a close is clear in
    another region, a probe until it fails, turns to the third region or has its closes.
    """
    none = 9
    out = {k: np.full(s.n, none, dtype=np.int64) for k in ("probe", "since", "count", "failed", "failed_count", "failed_at", "back")}
    out["accepted"], out["started"] = np.zeros(s.n, dtype=np.int64), np.ones(s.n, dtype=bool)
    accepted, started, at, failure = int(s.side[0]), True, 0, None
    while at < s.n:
        # a quiet stretch; the first close of the day only sets the region
        begin = s.first_clear(at or 1, *(r for r in REGIONS if r != accepted))
        out["accepted"][at:begin], out["started"][at:begin] = accepted, started
        if failure:
            toward, count, moment = failure
            back = s.counted(moment, begin, accepted)
            old = int(np.searchsorted(back, closes)) + moment
            for name, value in (("failed", toward), ("failed_count", count), ("failed_at", moment)):
                out[name][at : min(old, begin)] = value
            out["back"][at : min(old, begin)] = back[at - moment : min(old, begin) - moment]
            failure = None
        at = begin
        while at < s.n:
            toward = int(s.side[at])
            third = -toward - accepted
            fails, turns, done = s.first_clear(at, accepted), s.first_clear(at, third), s.nth_beyond(at, toward, closes)
            end = min(fails, turns, done)
            count = s.counted(at, end, toward)
            out["accepted"][at:end], out["started"][at:end], out["probe"][at:end], out["since"][at:end], out["count"][at:end] = accepted, started, toward, at, count
            at = end
            if end == turns and end < s.n:
                continue
            if end == done and end < s.n:
                accepted, started = toward, False
            elif end < s.n:
                failure = (toward, int(count[-1]), end)
            break
    return out


def day_status(pdf: pd.DataFrame, tolerance_bps: int, closes: int) -> pd.DataFrame:
    """The status after each close of one day, at most a row per minute."""
    pdf = pdf.sort_values("bar_ms", ignore_index=True)
    s = _Sides(pdf["close"].to_numpy(), int(pdf["val"].iloc[0]), int(pdf["vah"].iloc[0]), tolerance_bps)
    walked = _walk(s, closes)
    ends = pdf["bar_ms"].to_numpy() + MINUTE_MS
    probing, failing = walked["probe"] != 9, walked["failed"] != 9
    name = np.vectorize(REGIONS.get, otypes=[object])
    accepted = name(walked["accepted"])
    edge = np.where(s.high_edge, "above", np.where(s.low_edge, "below", None))
    position = np.where(s.high_edge, "high_edge", np.where(s.low_edge, "low_edge", name(s.side)))
    breaking = probing & (walked["probe"] != 0)
    inner = ~breaking & ~failing & (probing | (walked["accepted"] == 0))
    state = np.select(
        [breaking, failing & (walked["failed"] != 0), failing, inner & (edge != None), inner, walked["started"]],  # noqa: E711
        ["breakout", "failed_breakout", "failed_reclaim", "at_value_edge", "inside_value", "outside_value"], "acceptance",
    )
    side = np.where(breaking, name(walked["probe"]), np.where(failing & (walked["failed"] != 0), name(walked["failed"]), np.where(inner, edge, accepted)))
    told = lambda mask, values: pd.Series(np.where(mask, values, 0), dtype="Int64").where(mask)
    return pd.DataFrame({
        "instrument": pdf["instrument"], "day_ms": pdf["day_ms"], "bar_ms": pdf["bar_ms"], "close": pdf["close"], "position": position,
        "accepted": accepted, "origin": np.where(walked["started"], "start", "acceptance"), "state": state, "side": side,
        "probe_toward": np.where(probing, name(walked["probe"]), None), "probe_since_ms": told(probing, ends[np.where(probing, walked["since"], 0)]), "probe_closes": told(probing, walked["count"]),
        "failed_toward": np.where(failing, name(walked["failed"]), None), "failed_closes": told(failing, walked["failed_count"]),
        "failed_at_ms": told(failing, ends[np.where(failing, walked["failed_at"], 0)]), "closes_back": told(failing, walked["back"]),
    })


def statuses(bars: DataFrame, refs: DataFrame, tolerance_bps: int = TOLERANCE_BPS, closes: int = CLOSES) -> DataFrame:
    """The auction's status after each minute close of the days that have a valid reference.

    The day's first close sets the accepted region. A close clear of the bands in another region starts a probe toward it
    or turns one; it fails by a close clear in the accepted region and is accepted by ``closes`` closes beyond the edge.
    A failure is told until as many closes lie back in the accepted region or a probe starts. Every day stands alone and has
    1440 closes at most, so days run in parallel. Bars without trades and days without a valid reference have no row.
    """
    ship(bars.sparkSession)
    b = bars.where("close IS NOT NULL").select("instrument", bucket(F.col("bar_ms"), DAY_MS).alias("day_ms"), "bar_ms", "close")
    j = b.join(refs.where("valid").select("instrument", "day_ms", "val", "vah"), ["instrument", "day_ms"])
    return j.groupBy("instrument", "day_ms").applyInPandas(lambda pdf: day_status(pdf, tolerance_bps, closes), STATUS)


def transitions(status: DataFrame) -> DataFrame:
    """Closes at which the state differs from the one before; the day's first has none before it."""
    w = W.partitionBy("instrument", "day_ms").orderBy("bar_ms")
    s = status.withColumn("was", F.lag("state").over(w)).where("was IS NULL OR was != state")
    return s.select("instrument", "day_ms", "bar_ms", "was", "state", "side", "accepted", "position", "close")


def triggers(changes: DataFrame) -> DataFrame:
    """The transitions that are triggers: a failure in either direction, and acceptance out of a breakout."""
    fact = F.when(F.col("state") == "failed_breakout", "failed_auction").when(F.col("state") == "failed_reclaim", "failed_reclaim")
    fact = fact.when((F.col("state") == "acceptance") & (F.col("was") == "breakout"), "breakout_acceptance")
    return changes.withColumn("trigger", fact).where("trigger IS NOT NULL").select("instrument", "day_ms", "bar_ms", "trigger", "side", "close")


def edge_levels(refs: DataFrame) -> DataFrame:
    """The two edges of each valid reference as levels of their day."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("low"), F.col(k).alias("high")) for k in ("vah", "val")]))
    return refs.where("valid").select("instrument", each.alias("l"), F.col("day_ms").alias("valid_from"), (F.col("day_ms") + DAY_MS).alias("valid_to")).select("instrument", "l.*", "valid_from", "valid_to")


def guides(visits: DataFrame, status: DataFrame, refs: DataFrame, tolerance_bps: int = TOLERANCE_BPS, closes: int = CLOSES) -> DataFrame:
    """At each entry into the zone of an edge, what would decide a probe across it, as prices.

    toward is the region that the probe goes to. Closes in [starts_from, starts_below) start it, those in
    [counts_from, counts_below) count, those in [fails_from, fails_below) fail it; an open end is null. failure and acceptance
    name the triggers of both outcomes, none for an acceptance back into value.
    """
    entered = visits.where("event = 'enter'").select("instrument", "bar_ms", F.col("kind").alias("edge"), F.col("valid_from").alias("day_ms"), "touches")
    g = entered.join(status.select("instrument", "bar_ms", "accepted"), ["instrument", "bar_ms"]).join(refs.where("valid").drop("valid"), ["instrument", "day_ms"])
    outer = F.when(F.col("edge") == "vah", "above").otherwise("below")
    g = g.withColumn("toward", F.when(F.col("accepted") == outer, "in").otherwise(outer))
    val, vah = F.col("val"), F.col("vah")
    g = g.withColumns({f"{c}_band": F.expr(f"abs({c}) * {int(tolerance_bps)} div 10000") for c in ("val", "vah")})

    def clear(region: Column) -> tuple[Column, Column]:
        low = F.when(region == "above", vah + F.col("vah_band") + 1).when(region == "in", val + F.col("val_band") + 1)
        return low, F.when(region == "below", val - F.col("val_band")).when(region == "in", vah - F.col("vah_band"))

    toward, accepted = F.col("toward"), F.col("accepted")
    starts, fails = clear(toward), clear(accepted)
    counts = F.when(toward == "above", vah).when(toward == "in", val), F.when(toward == "below", val).when(toward == "in", vah)
    return g.select(
        "instrument", "day_ms", "bar_ms", "edge", "touches", "val", "vah", "accepted", "toward",
        *[c.alias(f"{n}_{e}") for n, pair in (("starts", starts), ("counts", counts), ("fails", fails)) for e, c in zip(("from", "below"), pair, strict=True)],
        F.when(toward == "in", "failed_reclaim").otherwise("failed_auction").alias("failure"),
        F.when(toward != "in", "breakout_acceptance").alias("acceptance"), F.lit(closes).alias("closes"),
    )
