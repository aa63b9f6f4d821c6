"""Labels on a tape with many trades an hour."""

import random

from tapeloom.operators import labels as L
from tapeloom.operators.bars import time_bars

H = 3_600_000


def dense(seed=3, n=6000, hours=5):
    rnd, price, out = random.Random(seed), 10_000, []
    for i, ts in enumerate(sorted(rnd.randrange(hours * H) for _ in range(n))):
        price += rnd.randint(-9, 9)
        out.append((i % 2, ts, 7 * i, price, 1, "buy"))
    return out


def asked(tape, seed=4):
    """Labels of any width, that end at any time, at the bounds of bars too."""
    rnd, out = random.Random(seed), []
    for k in range(60):
        i, ts, trade_id, price, *_ = rnd.choice(tape)
        wide = rnd.choice([20, 80, 300, 900])
        end = rnd.choice([ts + rnd.randrange(1, 4 * H), (ts // H + 2) * H, ts + 60_000, ts - ts % 60_000 + 60_000])
        out.append((i, trade_id, f"h{k}", ts, end, price + wide, price - wide, price))
    return out


def frames(spark, tape, asked):
    t = spark.createDataFrame(tape, "instrument long, ts_ms long, trade_id long, price long, qty long, aggressor string")
    lab = spark.createDataFrame(asked, "instrument long, event_seq long, horizon string, decision_ms long, end_ms long, upper long, lower long, reference long")
    return lab, time_bars(t, H), t


def test_touches_and_extremes_equal_a_walk_over_all_trades(spark):
    tape = dense()
    labels = asked(tape)
    got = {r.horizon: r for r in L.first_touch(*frames(spark, tape, labels), H).collect()}
    assert len(got) == len(labels)
    for i, seq, horizon, start, end, upper, lower, _ in labels:
        inside = [(ts, n, p) for j, ts, n, p, *_ in tape if j == i and (ts, n) > (start, seq) and ts < end]
        first = lambda hit: min(((ts, n) for ts, n, p in inside if hit(p)), default=None)  # noqa: B023, E731
        r = got[horizon]
        assert (r.up_at and tuple(r.up_at)) == first(lambda p: p >= upper) and (r.down_at and tuple(r.down_at)) == first(lambda p: p <= lower)  # noqa: B023
        assert (r.max_price, r.min_price) == (max((p for *_, p in inside), default=None), min((p for *_, p in inside), default=None))


def test_a_label_meets_the_trades_of_minutes_not_of_hours(spark):
    tape = dense()
    labels = asked(tape)
    met = L.trades_met(*frames(spark, tape, labels), H)[2].groupBy("horizon").count().toPandas()
    minutes = {}
    for i, ts, *_ in tape:
        minutes[i, ts // 60_000] = minutes.get((i, ts // 60_000), 0) + 1
    # 600 trades of an instrument in an hour
    assert 0 < met["count"].max() <= 4 * max(minutes.values()) < 100
