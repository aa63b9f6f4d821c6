"""Rows that are used several times are made once."""

import shutil

from tapeloom.operators import liquidity as Q
from tapeloom.operators import trade_outcomes as X
from tapeloom.operators.bars import time_bars
from tapeloom.sources.tape import gaps, trades
from tests.conftest import SF
from tests.test_dense_tape import dense
from tests.test_liquidity import tables, tape

H = 3_600_000


def leaves(df):
    """How often a plan reads tables, and how often rows that were given by Python."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan.count("Relation ["), plan.count("LogicalRDD [") + plan.count("LocalRelation [")


def test_events_are_parsed_once_and_again_when_they_change(spark, tmp_path):
    shutil.copy(f"{SF}/events.parquet", tmp_path / "events.parquet")
    d = str(tmp_path)
    first, n = trades(spark, d).inputFiles(), trades(spark, d).count()
    assert first == gaps(spark, d).inputFiles() and not any(f.endswith("events.parquet") for f in first)
    e = spark.read.parquet(f"{SF}/events.parquet")
    e.limit(10).coalesce(1).write.mode("overwrite").parquet(f"{d}/events.parquet")
    assert trades(spark, d).inputFiles() != first and trades(spark, d).count() <= 10 < n


def test_flow_reads_its_frames_and_trades_once(spark):
    snapshots, diffs, t = tables(spark, tape(5))
    epochs = Q.snapshot_epochs(snapshots, diffs)
    states = Q.epoch_states(snapshots, epochs)
    frames = Q.frames_before(snapshots, epochs, states)
    flow = Q.liquidity_flow(frames, t, states)
    assert str(flow._jdf.queryExecution().optimizedPlan()).count("MapInPandas") == 1
    assert leaves(epochs)[1] == 0
    windows = Q.flow_windows(Q.flow_minutes(flow), diffs.select("instrument", "ts_ms"))
    plan = str(windows._jdf.queryExecution().optimizedPlan())
    assert "MapInPandas" not in plan and plan.count("Relation [") <= 2


def test_exits_find_their_entries_once(spark):
    rows = dense(n=800)
    t = spark.createDataFrame(rows, "instrument long, ts_ms long, trade_id long, price long, qty long, aggressor string")
    decisions = spark.createDataFrame(
        [(i, k, "x", ts, "buy", p - 50, p + 100, None) for k, (i, ts, _, p, *_) in enumerate(rows[::40])],
        "instrument long, event_seq long, trigger string, decision_ms long, side string, stop long, target long, reason string",
    )
    entries = X.entered(decisions, t, 250, H)
    out = X.exited(entries, time_bars(t, H), t, 2 * H, H)
    # the tape behind the last look-up is all that is left of the plan's given rows
    assert leaves(out)[1] <= 2
    for r in out.collect():
        after = sorted((ts, n, p) for i, ts, n, p, *_ in rows if i == r.instrument and (ts, n) > (r.entry_ms, r.entry_id))
        hit = next(((ts, "target" if p >= r.target else "stop") for ts, _, p in after if ts < r.entry_ms + 2 * H and not r.stop < p < r.target), None)
        assert r.exit_by == (hit[1] if hit else "time")
        look = hit[0] + 1 if hit else r.entry_ms + 2 * H
        assert (r.exit_ms, r.exit_price) == next(((ts, p) for ts, _, p in after if ts >= look), (None, None))
