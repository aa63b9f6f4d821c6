"""Folds that SQL doesn't tell, against plain Python twins."""

import random

import numpy as np
import pandas as pd

from tapeloom.operators import labels, profile, structure
from tapeloom.sources.tape import trades
from tests.conftest import SF


def twin_value_area(q, area=0.7):
    n, total = len(q), sum(q)
    best = max(q)
    poc = min((i for i in range(n) if q[i] == best), key=lambda i: (abs(2 * i - (n - 1)), i))
    lo = hi = poc
    while sum(q[lo : hi + 1]) < area * total:
        left = q[lo - 1] if lo else None
        right = q[hi + 1] if hi + 1 < n else None
        if right is None or (left is not None and left > right):
            lo -= 1
        elif left is None or right > left:
            hi += 1
        else:
            lo, hi = lo - 1, hi + 1
    return poc, lo, hi


def test_value_area(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for day in range(40):
        q = [rng.choice([0, 1, 1, 2, 3, 5, 5, 9]) for _ in range(rng.randint(1, 30))]
        q[0], q[-1] = q[0] or 1, q[-1] or 1
        rows += [(1, day, b, x) for b, x in enumerate(q)]
        want[day] = twin_value_area(q)
    df = spark.createDataFrame(rows, "instrument long, day_ms long, bin long, qty long")
    got = {r.day_ms: (r.poc, r.val, r.vah) for r in profile.value_area(df).collect()}
    assert got == want


def test_point_of_control_ties(spark):
    df = spark.createDataFrame([(1, 0, b, q) for b, q in enumerate([5, 1, 5, 5, 1])], "instrument long, day_ms long, bin long, qty long")
    assert profile.point_of_control(df).first()["poc"] == 2


def test_prominence_of_peaks():
    found = profile.peaks(np.array([1.0, 5.0, 2.0, 4.0, 4.0, 3.0, 9.0]))
    assert [(i, j) for i, j, _ in found] == [(1, 1), (3, 4), (6, 6)]
    assert [p for _, _, p in found] == [3.0, 1.0, 9.0]


def test_thinning_is_greedy(spark):
    rng = random.Random(5)
    rows = [(1, "h", i, rng.randint(0, 3000), 100) for i in range(200)]
    df = spark.createDataFrame(rows, "instrument long, horizon string, event_seq long, decision_ms long, horizon_ms long")
    got = {r.event_seq: r.clear for r in labels.thinned(df, ["instrument", "horizon"]).collect()}
    free = None
    for _, _, i, t, span in sorted(rows, key=lambda r: (r[3], r[2])):
        ok = free is None or t >= free
        free = t + span if ok else free
        assert got[i] == ok


def test_capped_registry_keeps_the_cap(spark):
    rows = [(1, "high", b, 10 + b, None if b % 3 else b + 2) for b in range(12)]
    df = spark.createDataFrame([(a, s, b, k, sw) for a, s, b, k, sw in rows], "instrument long, side string, bar_ms long, known_bar_ms long, swept_bar_ms long")
    out = structure.capped_registry(df, 4).toPandas()
    assert len(out) == 12 and (out["end"] == "active").sum() <= 4


def test_labels_never_read_the_past(spark):
    """Changing every trade up to the decision leaves the touches after it as they are."""
    t = trades(spark, SF).toPandas()
    cut = int(t.ts_ms.median())
    lab = pd.DataFrame([(i, -1, "h", cut, cut + 86_400_000, 30_000_000_000, 10_000_000_000, 20_000_000_000) for i in range(4)], columns=["instrument", "event_seq", "horizon", "decision_ms", "end_ms", "upper", "lower", "reference"])
    other = t.assign(price=t.price.where(t.ts_ms > cut, 49_000_000_000))
    from tapeloom.operators.bars import time_bars

    def run(pdf):
        df = spark.createDataFrame(pdf)
        out = labels.first_touch(spark.createDataFrame(lab), time_bars(df, 3_600_000), df, 3_600_000)
        return sorted(map(str, out.select("instrument", "up_at", "down_at", "max_price", "min_price").collect()))

    assert run(t[t.ts_ms != cut]) == run(other[other.ts_ms != cut])
