"""One instrument's running state as a stateful stream: order, late rows, checkpoints, and a warm start from history."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tapeloom.functions.shipping import ship
from tapeloom.functions.sorting import sorted_blocks
from tapeloom.functions.timing import bucket, lagged, numbered, prefix_sum
from tapeloom.sources.tape import DAY_MS

CHECKPOINT_MS = 10_000
#: Running sums of hashes stay below this.
SPACE = 1 << 60
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class State(NamedTuple):
    """What is kept of an instrument between its events: counts, the last trade, the book's epoch and where prices stand to the day before."""

    high_ms: int = -1
    n: int = 0
    hash: int = 0
    last_id: int | None = None
    last_ms: int | None = None
    last_price: int | None = None
    epoch: int = 0
    day_ms: int | None = None
    day_high: int | None = None
    day_low: int | None = None
    ref_high: int | None = None
    ref_low: int | None = None
    region: str = "none"
    run: int = 0


_LONGS = [f for f in State._fields if f != "region"]
STATE = ", ".join(f"{f} {'string' if f == 'region' else 'long'}" for f in State._fields)
#: Stands for no price on the way to Python, which would make fractions of a column with nulls.
NO_PRICE = -(1 << 63)
ARRIVAL = ["at", "trade_id", "ts_ms", "kind", "price"]
HELD = "ts_ms long, kind long, trade_id long, price long"
OUT = (
    "instrument long, kind string, ts_ms long, trade_id long, price long, prev_id long, epoch long, day_ms long, ref_high long, ref_low long, region string, run long, "
    "seen_ms long, n long, stream_hash long, state_hash string"
)
_NAMES = [c.split()[0] for c in OUT.split(", ")]


def row_hash(n: int, ts_ms: int, trade_id: int, price: int | None) -> int:
    return int(hashlib.sha256(f"{n}|{ts_ms}|{trade_id}|{'' if price is None else price}".encode()).hexdigest()[:12], 16)


def state_hash(s: State) -> str:
    return hashlib.sha256("|".join("" if v is None else str(v) for v in (s.last_id, s.epoch, s.day_ms, s.ref_high, s.ref_low, s.region, s.run)).encode()).hexdigest()


def advance(s: State, ts_ms: int, kind: int, trade_id: int, price: int | None) -> State:
    """The state after one event in order: a feed gap (kind 1) begins an epoch, a trade moves everything else."""
    s = s._replace(n=s.n + 1, hash=(s.hash + row_hash(s.n + 1, ts_ms, trade_id, price)) % SPACE, last_ms=ts_ms)
    if kind:
        return s._replace(epoch=s.epoch + 1)
    day = ts_ms - ts_ms % DAY_MS
    if day != s.day_ms:
        s = s._replace(day_ms=day, ref_high=s.day_high, ref_low=s.day_low, day_high=price, day_low=price, region="", run=0)
    region = "none" if s.ref_high is None else "above" if price > s.ref_high else "below" if price < s.ref_low else "inside"
    run = s.run + 1 if region == s.region else 1
    return s._replace(last_id=trade_id, last_price=price, day_high=max(s.day_high, price), day_low=min(s.day_low, price), region=region, run=run)


def processed(s: State, held: list[tuple], arrivals: Iterable[tuple], hold_ms: int, rows: list[tuple], instrument: int) -> State:
    """Takes ``arrivals`` (ts_ms, kind, trade_id, price) in the order of their arrival, releases what is older than the hold in the order of time.

    ``held`` is a heap of what waits, ``rows`` takes the output: a row for each released trade, for each late event, and for
    each closed stretch of CHECKPOINT_MS in which something was released.
    """
    for ts, kind, trade_id, price in arrivals:
        if ts < s.high_ms - hold_ms:
            rows.append((instrument, "late_event", ts, trade_id, price, *[None] * 7, s.high_ms, None, None, None))
            continue
        heappush(held, (ts, kind, trade_id, price))
        s = s._replace(high_ms=max(s.high_ms, ts))
        while held and held[0][0] < s.high_ms - hold_ms:
            event = heappop(held)
            if s.last_ms is not None and s.last_ms // CHECKPOINT_MS < event[0] // CHECKPOINT_MS:
                end = (s.last_ms // CHECKPOINT_MS + 1) * CHECKPOINT_MS
                rows.append((instrument, "checkpoint", end, *[None] * 10, s.n, s.hash, state_hash(s)))
            before, s = s, advance(s, *event)
            if not event[1]:
                rows.append((instrument, "trade", event[0], event[2], event[3], before.last_id, s.epoch, s.day_ms, s.ref_high, s.ref_low, s.region, s.run, *[None] * 4))
    return s


class TapeState(StatefulProcessor):
    """M7: the state of one instrument in Spark's state store; M2: late rows come out as rows of their own; M8: begins from given states."""

    def __init__(self, hold_ms: int) -> None:
        self.hold_ms = hold_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", STATE)
        self.held = handle.getListState("held", HELD)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        s = State(*self.state.get()) if self.state.exists() else State()
        held = sorted(tuple(r) for r in self.held.get()) if self.held.exists() else []
        given: list[str] = []

        def events() -> Iterator[np.ndarray]:
            for chunk in rows:
                given.extend(chunk["given"].dropna())
                yield chunk.loc[chunk["given"].isna(), ARRIVAL].to_numpy("int64")

        blocks = sorted_blocks(events(), len(ARRIVAL))
        for text in given:
            s = State(**json.loads(text))
        for block in blocks:
            found: list[tuple] = []
            arrivals = ((ts, kind, trade_id, None if price == NO_PRICE else price) for _, trade_id, ts, kind, price in block.tolist())
            s = processed(s, held, arrivals, self.hold_ms, found, int(key[0]))
            if found:
                yield pd.DataFrame(found, columns=_NAMES, dtype=object).astype({c: "Int64" for c in _NAMES if c not in ("kind", "region", "state_hash")})
        self.state.update(tuple(s))
        if held:
            self.held.put([tuple(h) for h in held])
        else:
            self.held.clear()

    def close(self) -> None:
        pass


def with_given(arrivals: DataFrame, path: str, initial: DataFrame | None) -> DataFrame:
    """``arrivals`` and, ahead of them, the states of ``initial`` as rows of their own (column given).

    Spark's own initial state holds all rows of a key in the first trigger. The states are a second source, in a folder that
    every run on ``path`` has, as a query's sources can't change; only the first run writes it.
    """
    spark = arrivals.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/given")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        states = spark.createDataFrame([], f"instrument long, {STATE}") if initial is None else initial
        states.select("instrument", F.to_json(F.struct(*State._fields), {"ignoreNullFields": "false"}).alias("given")).write.parquet(f"{path}/given")
    states = spark.readStream.schema("instrument long, given string").parquet(f"{path}/given")
    zero = F.lit(0).cast("long")
    rows = arrivals.select("instrument", *ARRIVAL[:-1], F.coalesce("price", F.lit(NO_PRICE)).alias("price"), F.lit(None).cast("string").alias("given"))
    return rows.unionByName(states.select("instrument", *[zero.alias(c) for c in ARRIVAL], "given"))


def run_keyed(arrivals: DataFrame, path: str, hold_ms: int, initial: DataFrame | None = None) -> DataFrame:
    """Runs TapeState over a stream (instrument, at, ts_ms, kind, trade_id, price) until all there is has been read; returns its rows.

    Rows of one micro-batch are taken by ``at``, the order of their arrival; a task sorts an instrument's rows with spilled runs and holds
    a block of them. What is younger than the hold stays in the state for the next run on ``path``, which goes on where this one ended.
    ``initial`` counts in the first run on ``path``.
    """
    spark = arrivals.sparkSession
    ship(spark)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        out = with_given(arrivals, path, initial).groupBy("instrument").transformWithStateInPandas(TapeState(hold_ms), OUT, "Append", "None")
        q = out.writeStream.format("parquet").option("checkpointLocation", f"{path}/_state").outputMode("append").trigger(availableNow=True).start(f"{path}/rows")
        q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(OUT).parquet(f"{path}/rows")


def still_held(spark: SparkSession, path: str) -> DataFrame:
    """The rows that wait in the state of a run on ``path``: instrument, ts_ms, kind, trade_id, price."""
    state = spark.read.format("statestore").option("stateVarName", "held").option("flattenCollectionTypes", "true").load(f"{path}/_state")
    return state.select(F.col("key.instrument").alias("instrument"), "list_element.*")


def history_rows(events: DataFrame) -> DataFrame:
    """The same trades' rows from a batch table of events (instrument, ts_ms, kind, trade_id, price), all of them in order and in time.

    Each event has the columns of State after it. Days and their ranges are few rows; the rest is lags and prefix sums in buckets of days.
    """
    order = ["ts_ms", "kind", "trade_id"]
    e = prefix_sum(events, ["instrument"], "ts_ms", order, "kind", "epoch")
    e = numbered(e, ["instrument"], "ts_ms", order, "n")
    t = e.where("kind = 0").withColumn("day_ms", bucket(F.col("ts_ms"), DAY_MS))
    t = lagged(t, ["instrument"], "ts_ms", order, {"trade_id": "prev_id"})
    days = t.groupBy("instrument", "day_ms").agg(F.max("price").alias("day_high"), F.min("price").alias("day_low"))
    days = lagged(days, ["instrument"], "day_ms", ["day_ms"], {"day_high": "ref_high", "day_low": "ref_low"}, 1024 * DAY_MS)
    t = t.join(days.drop("day_high", "day_low"), ["instrument", "day_ms"])
    region = F.when(F.col("ref_high").isNull(), "none").when(F.col("price") > F.col("ref_high"), "above").when(F.col("price") < F.col("ref_low"), "below").otherwise("inside")
    t = t.withColumn("region", region)
    t = lagged(t, ["instrument", "day_ms"], "ts_ms", order, {"region": "p"}).withColumn("new", F.when(F.col("p") == F.col("region"), 0).otherwise(1))
    t = prefix_sum(t, ["instrument", "day_ms"], "ts_ms", order, "new", "stretch")
    return numbered(t, ["instrument", "day_ms", "stretch"], "ts_ms", order, "run").drop("p", "new", "stretch")


def history_state(events: DataFrame) -> DataFrame:
    """M8: the columns of State per instrument after all ``events``, by aggregation; the hash of the stream is that of no events."""
    rows = history_rows(events)
    last = rows.groupBy("instrument").agg(F.max_by(F.struct("trade_id", "price", "day_ms", "ref_high", "ref_low", "region", "run"), F.struct("ts_ms", "trade_id")).alias("t"))
    day = rows.groupBy("instrument", "day_ms").agg(F.max("price").alias("day_high"), F.min("price").alias("day_low"))
    every = events.groupBy("instrument").agg(F.max("ts_ms").alias("high_ms"), F.count("*").alias("n"), F.sum("kind").cast("long").alias("epoch"))
    s = every.join(last, "instrument", "left").withColumn("day_ms", F.col("t.day_ms")).join(day, ["instrument", "day_ms"], "left")
    return s.select(
        "instrument", "high_ms", "n", F.lit(0).cast("long").alias("hash"), F.col("t.trade_id").alias("last_id"), F.col("high_ms").alias("last_ms"), F.col("t.price").alias("last_price"), "epoch",
        "day_ms", "day_high", "day_low", F.col("t.ref_high").alias("ref_high"), F.col("t.ref_low").alias("ref_low"), F.coalesce("t.region", F.lit("none")).alias("region"), F.coalesce("t.run", F.lit(0)).cast("long").alias("run"),
    )
