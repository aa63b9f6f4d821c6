"""The auction against a twin that steps through closes one by one."""

import random

import numpy as np
import pandas as pd
import pytest

from tapeloom.operators import auction as A

MIN, DAY = A.MINUTE_MS, A.DAY_MS


def twin(closes, val, vah, bps, need):
    """(position, accepted, origin, state, side, probe, failure) after each close, by one step a close."""
    out, acc, origin, probe, fail = [], None, "start", None, None
    for i, c in enumerate(closes):
        where = "above" if c >= vah else "below" if c < val else "in"
        edge = "high_edge" if abs(c - vah) * 10_000 <= vah * bps else "low_edge" if abs(c - val) * 10_000 <= val * bps else None
        end = (i + 1) * MIN
        if acc is None:
            acc = where
        elif edge is None and where != acc and (probe is None or probe[0] != where):
            probe, fail = [where, end, 1], None
        elif edge is None and where == acc and probe:
            fail, probe = [probe[0], probe[2], end, 1], None
        elif probe:
            probe[2] += where == probe[0]
        elif fail:
            fail[3] += where == acc
        if probe and probe[2] >= need:
            acc, origin, probe, fail = probe[0], "acceptance", None, None
        if fail and fail[3] >= need:
            fail = None
        if probe and probe[0] != "in":
            state, side = "breakout", probe[0]
        elif fail and not probe:
            state, side = ("failed_reclaim", acc) if fail[0] == "in" else ("failed_breakout", fail[0])
        elif probe or acc == "in":
            state, side = ("at_value_edge", "above" if edge == "high_edge" else "below") if edge else ("inside_value", None)
        else:
            state, side = ("acceptance" if origin == "acceptance" else "outside_value"), acc
        out.append((edge or where, acc, origin, state, side, *(probe or [None] * 3), *(fail or [None] * 4)))
    return out


def day(closes, val, vah):
    n = len(closes)
    return pd.DataFrame({"instrument": 1, "day_ms": 0, "bar_ms": np.arange(n) * MIN, "close": closes, "val": val, "vah": vah})


def rows(pdf):
    cols = ["position", "accepted", "origin", "state", "side", "probe_toward", "probe_since_ms", "probe_closes", "failed_toward", "failed_closes", "failed_at_ms", "closes_back"]
    return [tuple(None if pd.isna(v) else v for v in r) for r in pdf[cols].astype(object).itertuples(index=False)]


@pytest.mark.parametrize("need", [1, 2, 3, 7, 60])
def test_random_days_equal_the_twin(need):
    rng, seen = random.Random(need), set()
    for _ in range(150):
        val, vah = 100_000, 100_000 + rng.choice([500, 2_000])
        c, closes = rng.randint(val - 600, vah + 600), []
        for _ in range(rng.randint(1, 300)):
            c += rng.choice([-400, -90, -30, 0, 0, 30, 90, 400]) + (100_500 - c) // 12
            closes.append(c)
        got = rows(A.day_status(day(closes, val, vah).sample(frac=1, random_state=1), 6, need))
        assert got == twin(closes, val, vah, 6, need)
        seen |= {r[3] for r in got}
    assert {"inside_value", "at_value_edge", "outside_value"} <= seen
    if 1 < need < 10:
        assert seen == {"breakout", "failed_breakout", "failed_reclaim", "at_value_edge", "inside_value", "outside_value", "acceptance"}


def test_bands_are_neutral_but_count():
    """Closes inside the band of the upper edge neither start nor fail a probe; those beyond the edge count."""
    got = rows(A.day_status(day([100_500, 101_050, 102_000, 100_950, 101_050, 101_000, 100_999], 100_000, 101_000), 6, 5))
    assert [r[0] for r in got] == ["in", "high_edge", "above", "high_edge", "high_edge", "high_edge", "high_edge"]
    assert [r[7] for r in got] == [None, None, 1, 1, 2, 3, 3]
    assert [r[3] for r in got] == ["inside_value", "at_value_edge"] + ["breakout"] * 5


def test_sixty_closes_accept():
    got = rows(A.day_status(day([100_500] + [102_000] * 60, 100_000, 101_000), 6, A.CLOSES))
    assert [r[3] for r in got] == ["inside_value"] + ["breakout"] * 59 + ["acceptance"] and got[-1][1:3] == ("above", "acceptance")


def test_references_need_width_and_the_day_before(spark):
    areas = spark.createDataFrame([(1, 0, 100_000, 100_120), (1, DAY, 100_000, 100_119), (2, 0, 5, 5)], "instrument long, day_ms long, val long, vah long")
    got = {(r.instrument, r.day_ms): (r.val, r.vah, r.valid) for r in A.references(areas, 1).collect()}
    assert got == {(1, DAY): (100_000, 100_121, True), (1, 2 * DAY): (100_000, 100_120, False), (2, DAY): (5, 6, True)}


def test_days_stand_alone_and_empty_tables_give_none(spark):
    refs = spark.createDataFrame([(1, 0, 100_000, 101_000, True), (1, DAY, 100_000, 101_000, True), (2, 0, 100_000, 100_010, False)], "instrument long, day_ms long, val long, vah long, valid boolean")
    bars = spark.createDataFrame([(1, 0, 102_000), (1, MIN, None), (1, 2 * MIN, 100_500), (1, DAY, 100_500), (2, 0, 100_500), (3, 0, 100_500)], "instrument long, bar_ms long, close long")
    got = [(r.bar_ms, r.accepted, r.state) for r in A.statuses(bars, refs).orderBy("bar_ms").collect()]
    assert got == [(0, "above", "outside_value"), (2 * MIN, "above", "inside_value"), (DAY, "in", "inside_value")]
    changes = A.transitions(A.statuses(bars, refs))
    assert [(r.bar_ms, r.was) for r in changes.orderBy("bar_ms").collect()] == [(0, None), (2 * MIN, "outside_value"), (DAY, None)]
    assert A.statuses(bars.where("false"), refs).count() == 0


def test_guides_state_the_rules_as_prices(spark):
    refs = spark.createDataFrame([(1, 0, 100_000, 101_000, True)], "instrument long, day_ms long, val long, vah long, valid boolean")
    visits = spark.createDataFrame([(1, 0, "vah", 0, "enter", 1), (1, MIN, "vah", 0, "leave", 1), (1, MIN, "val", 0, "enter", 1)], "instrument long, bar_ms long, kind string, valid_from long, event string, touches long")
    status = spark.createDataFrame([(1, 0, "in"), (1, MIN, "below")], "instrument long, bar_ms long, accepted string")
    one, two = A.guides(visits, status, refs).orderBy("bar_ms").collect()
    assert (one.toward, one.starts_from, one.starts_below, one.counts_from, one.counts_below) == ("above", 101_061, None, 101_000, None)
    assert (one.fails_from, one.fails_below, one.failure, one.acceptance) == (100_061, 100_940, "failed_auction", "breakout_acceptance")
    assert (two.toward, two.starts_from, two.starts_below, two.counts_from, two.counts_below) == ("in", 100_061, 100_940, 100_000, 101_000)
    assert (two.fails_from, two.fails_below, two.failure, two.acceptance) == (None, 99_940, "failed_reclaim", None)
    assert "in" == A.REGIONS[0] and np.sign(A.CLOSES) == 1
