import random

import numpy as np
import pandas as pd
import pytest

from tapeloom.functions.sorting import sorted_blocks
from tapeloom.streaming import keyed_state as K

SCHEMA = "instrument long, at long, ts_ms long, kind long, trade_id long, price long"


def tape(n, seed, late=0.2):
    rnd, out, ts = random.Random(seed), [], 1_704_067_200_000
    for i in range(n):
        ts += rnd.choice([0, 1, 500, 60_000, 9_000_000])
        kind = int(rnd.random() < 0.1)
        out.append((0, ts + (rnd.choice([1000, 40_000, 3_000_000]) if rnd.random() < late else 0), ts, kind, i, None if kind else rnd.randint(1, 50)))
    return sorted(out, key=lambda r: (r[1], r[4]))


def folded(rows, parts, hold=30_000):
    s, held, out = K.State(), [], []
    for part in parts(rows):
        s = K.processed(s, held, [r[2:] for r in part], hold, out, 0)
    return s, sorted(held), out


def test_state_does_not_depend_on_batches():
    rows, rnd = tape(800, 1), random.Random(2)

    def cut(rs):
        at = 0
        while at < len(rs):
            n = rnd.randint(1, 60)
            yield rs[at : at + n]
            at += n

    assert folded(rows, lambda r: [r]) == folded(rows, cut)


class Kept:
    """What a state variable of Spark does for the processor."""

    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    put, clear = update, lambda self: self.update(None)


def test_a_large_trigger_is_taken_in_blocks():
    rows = tape(40_000, 7)
    frame = pd.DataFrame(rows, columns=["instrument", "at", "ts_ms", "kind", "trade_id", "price"]).sample(frac=1, random_state=1)
    frame["price"] = frame["price"].astype("Int64").fillna(K.NO_PRICE).astype("int64")
    frame["given"] = None
    p = K.TapeState(30_000)
    p.state, p.held = Kept(), Kept()
    got = list(p.handleInputRows((0,), (frame[i : i + 1000] for i in range(0, len(frame), 1000)), None))
    s, held, out = folded(rows, lambda r: [r])
    assert max(map(len, got)) < 2.5 * 8192 < len(out)
    assert [r[3] for r in out] == [None if pd.isna(v) else v for f in got for v in f["trade_id"]]
    assert p.state.value == tuple(s) and sorted(p.held.value) == held


@pytest.mark.parametrize("n, run", [(0, 10), (5, 10), (1000, 10), (1000, 400), (1000, 2000)])
def test_spilled_runs_merge_in_order(n, run):
    data = np.random.default_rng(n).integers(0, 50, (n, 3))
    data[:, 2] = np.arange(n)
    got = list(sorted_blocks((data[i : i + 7] for i in range(0, n, 7)), 3, run, 16))
    assert all(len(b) <= 16 for b in got)
    every = np.concatenate([*got, np.empty((0, 3), "int64")])
    assert [tuple(r[:2]) for r in every] == sorted(tuple(r[:2]) for r in data) and sorted(every[:, 2]) == list(range(n))


def test_every_row_is_released_late_or_held():
    rows = tape(800, 3)
    s, held, out = folded(rows, lambda r: [r])
    late = [o for o in out if o[1] == "late_event"]
    assert late and s.n + len(late) + len(held) == len(rows)
    times = [o[2] for o in out if o[1] == "trade"]
    assert times == sorted(times) and {o[3] for o in late}.isdisjoint(o[3] for o in out if o[1] == "trade")


def test_first_changed_event_shows_in_the_checkpoints():
    rows = tape(500, 4, late=0)
    changed = [r if r[4] != 250 else (*r[:5], (r[5] or 0) + 1) for r in rows]
    a, b = ([o for o in folded(x, lambda r: [r])[2] if o[1] == "checkpoint"] for x in (rows, changed))
    first = next(x for x, y in zip(a, b, strict=True) if x[14] != y[14])
    before = [x for x in a if x[2] < first[2]]
    assert all(x[14] == y[14] for x, y in zip(before, b, strict=False)) and first[13] >= 251 > (before[-1][13] if before else 0)


def test_a_stream_goes_on_where_it_ended(spark, tmp_path):
    rows = tape(300, 5)
    files, found = str(tmp_path / "in"), []
    for k in range(3):
        spark.createDataFrame(rows[100 * k : 100 * k + 100], SCHEMA).coalesce(1).write.mode("append").parquet(files)
        got = K.run_keyed(spark.readStream.schema(SCHEMA).parquet(files), str(tmp_path / "s"), 30_000)
        found.append(got.count())
    s, held, out = folded(rows, lambda r: [r])
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, out)) and found[0] < found[2]
    waiting = sorted(tuple(r)[1:] for r in K.still_held(spark, str(tmp_path / "s")).collect())
    assert waiting == held


def test_warm_start_of_an_instrument_without_trades_today(spark, tmp_path):
    rows = [r for r in tape(200, 6, late=0)]
    cut = rows[120][2]
    events = spark.createDataFrame(rows, SCHEMA)
    files = str(tmp_path / "in")
    events.where(f"ts_ms >= {cut}").coalesce(1).write.parquet(files)
    live = spark.readStream.schema(SCHEMA).parquet(files)
    got = K.run_keyed(live, str(tmp_path / "w"), 30_000, K.history_state(events.where(f"ts_ms < {cut}"))).where("kind = 'trade'")
    whole = [o for o in folded(rows, lambda r: [r])[2] if o[1] == "trade" and o[2] >= cut]
    assert sorted(tuple(r)[2:12] for r in got.collect()) == sorted(o[2:12] for o in whole)
