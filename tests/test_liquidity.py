import random

import pytest

from tapeloom.operators import liquidity as Q

MID = 1_000_000


def tape(seed, n=500):
    """A book's stream: (kind, seq, side, price, qty, prev_id); snapshots are of the true book, some diffs get lost."""
    rnd, book, out, prev = random.Random(seed), {}, [], 0
    for seq in range(1, n):
        side, k = rnd.choice(["bid", "ask"]), rnd.randint(0, 3)
        price = MID - 100 * (k + 1) if side == "bid" else MID + 100 * k
        roll = rnd.random()
        if roll < 0.5:
            out.append(("trade", seq, side, price, rnd.randint(1, 30), None))
            continue
        qty = rnd.choice([0, rnd.randint(1, 50), rnd.randint(1, 50)])
        book[side, price] = qty
        if rnd.random() > 0.02:
            out.append(("diff", seq, side, price, qty, prev))
        prev = seq
        if rnd.random() < 0.03:
            out += [("snapshot", seq, s, p, q, None) for (s, p), q in sorted(book.items()) if q]
    return out


def plain(events, bands=Q.BANDS_BPS):
    """The rules, event by event: (epoch, seq, side, price, band) -> (added, cancelled, filled, inferred)."""
    out, book, pending, epoch, last, low, high, at = {}, None, {}, None, None, None, None, 0
    while at < len(events):
        kind, seq, side, price, qty, prev = events[at]
        if kind == "snapshot":
            rows = [e for e in events[at:] if e[0] == "snapshot" and e[1] == seq]
            at += len(rows)
            book, pending, epoch, last = {(s, p): q for _, _, s, p, q, _ in rows}, {}, seq, None
            bids, asks = [p for (s, p) in book if s == "bid"], [p for (s, p) in book if s == "ask"]
            low, high = min(bids, default=None), max(asks, default=None)
            continue
        at += 1
        if book is None:
            continue
        if kind == "trade":
            fresh, carried = pending.get((side, price), (0, 0))
            pending[side, price] = (fresh + qty, carried)
            continue
        if (prev > epoch) if last is None else (prev != last):
            book, pending = None, {}
            continue
        last = seq
        bids, asks = [p for (s, p), q in book.items() if s == "bid" and q], [p for (s, p), q in book.items() if s == "ask" and q]
        framed = bids and asks and max(bids) < min(asks)
        m = max(bids) + min(asks) if framed else None

        def near(p, bps):
            return framed and low is not None and high is not None and low <= p <= high and abs(m - 2 * p) * 10_000 <= bps * m

        def book_flow(s, p, values):
            for b in bands:
                if near(p, b) and any(values):
                    key = (epoch, seq, s, p, b)
                    out[key] = tuple(x + y for x, y in zip(out.get(key, (0, 0, 0, 0)), values, strict=True))

        old, taken = book.get((side, price), 0), {}
        if near(price, max(bands)):
            fresh, carried = pending.get((side, price), (0, 0))
            removed = max(0, old - qty)
            a = min(removed, carried)
            b = min(removed - a, fresh)
            taken[side, price] = (a, b)
            book_flow(side, price, (max(0, qty - old), removed - a - b, a + b, 0))
        for (s, p), (fresh, carried) in list(pending.items()):
            a, b = taken.get((s, p), (0, 0))
            if carried - a and near(p, max(bands)):
                book_flow(s, p, (carried - a, 0, carried - a, carried - a))
            pending[s, p] = (0, fresh - b)
        pending = {k: v for k, v in pending.items() if v[1]}
        book[side, price] = qty
    return out


def tables(spark, events):
    rows = lambda kind: [(1, *e[1:5], e[5], 1000 * e[1]) for e in events if e[0] == kind]
    schema = "instrument long, seq long, side string, price long, qty long, prev_id long, ts_ms long"
    snapshots = spark.createDataFrame(rows("snapshot"), schema).withColumnRenamed("seq", "snapshot_id").drop("prev_id", "ts_ms")
    trades = spark.createDataFrame(rows("trade"), schema).selectExpr("instrument", "seq", "price", "qty", "if(side = 'ask', 'buy', 'sell') AS aggressor")
    return snapshots, spark.createDataFrame(rows("diff"), schema), trades


@pytest.mark.parametrize("seed", [1, 2])
def test_flow_equals_the_rules(spark, seed):
    events = tape(seed)
    snapshots, diffs, trades = tables(spark, events)
    epochs = Q.snapshot_epochs(snapshots, diffs).cache()
    states = Q.epoch_states(snapshots, epochs).cache()
    frames = Q.frames_before(snapshots, epochs, states).cache()
    got = Q.liquidity_flow(frames, trades, states).collect()
    found = {(r.epoch, r.seq, r.side, r.price, r.band): (r.added, r.cancelled, r.filled, r.inferred) for r in got}
    expected = plain(events)
    assert found == expected and len(found) == len(got)
    assert sum(v[3] for v in found.values()) and sum(v[2] > v[3] for v in found.values())


def test_every_change_of_a_level_is_conserved(spark):
    snapshots, diffs, trades = tables(spark, tape(4))
    epochs = Q.snapshot_epochs(snapshots, diffs).cache()
    states = Q.epoch_states(snapshots, epochs).cache()
    frames = Q.frames_before(snapshots, epochs, states).cache()
    change = {(r.epoch, r.seq, r.side, r.price): r.qty - r.old for r in frames.collect()}
    for r in Q.liquidity_flow(frames, trades, states).where("band = 5").collect():
        assert r.added - r.cancelled - r.filled == change.get((r.epoch, r.seq, r.side, r.price), 0)


def test_levels_are_absent_from_a_break_to_the_next_snapshot(spark):
    schema = "instrument long, seq long, side string, price long, qty long, prev_id long"
    snapshots = spark.createDataFrame([(1, 10, "bid", 99, 5), (1, 10, "ask", 101, 5), (1, 30, "bid", 98, 7), (1, 50, "bid", 97, 1)], "instrument long, snapshot_id long, side string, price long, qty long")
    diffs = spark.createDataFrame([(1, 12, "bid", 99, 0, 9), (1, 14, "ask", 102, 3, 12), (1, 20, "ask", 103, 3, 16), (1, 22, "ask", 101, 9, 20), (1, 35, "bid", 98, 0, 33)], schema)
    epochs = Q.snapshot_epochs(snapshots, diffs)
    states = {r.epoch: r for r in Q.epoch_states(snapshots, epochs).collect()}
    assert [(states[e].state, states[e].end_seq, states[e].n_live) for e in (10, 30, 50)] == [("aligned", 20, 2), ("too_old", 35, 0), ("waiting", 51, 0)]
    assert (states[10].trusted_low, states[10].trusted_high) == (99, 101) and states[30].trusted_high is None
    lives = Q.seeded_levels(snapshots, epochs, Q.epoch_states(snapshots, epochs)).collect()
    assert sorted((r.side, r.price, r.qty, r.valid_from, r.valid_to) for r in lives) == [("ask", 101, 5, 10, 20), ("ask", 102, 3, 14, 20), ("bid", 99, 5, 10, 12)]
