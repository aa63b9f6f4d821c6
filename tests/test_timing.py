"""Bucketed windows and searches against plain windows and loops, with buckets of a few rows."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeloom.functions.timing import lagged, max_before, numbered
from tapeloom.operators.stats import episodes, runs
from tapeloom.operators.structure import sweeps, touches


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(5)
    got = [(k % 2, r.randrange(60), k, r.choice([None, *range(9)])) for k in range(120)]
    return spark.createDataFrame([*got, (7, 3, 500, 1)], "key long, t long, id long, v long")


def both(one, two):
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))


@pytest.mark.parametrize("width", [1, 5, 1000])
def test_windows_equal_plain_ones(rows, width):
    order, w = ["t", "id"], W.partitionBy("key").orderBy("t", "id")
    both(
        lagged(rows, ["key"], "t", order, {"v": "pv", "t": "pt"}, width),
        rows.withColumns({"pv": F.lag("v").over(w), "pt": F.lag("t").over(w)}),
    )
    both(
        max_before(rows, ["key"], "t", order, "v", "m", width),
        rows.withColumn("m", F.max("v").over(w.rowsBetween(W.unboundedPreceding, -1))),
    )
    both(numbered(rows, ["key"], "t", order, "n", width), rows.withColumn("n", F.row_number().over(w).cast("long")))


def test_equal_rows_share_a_chain(spark):
    t = spark.createDataFrame([(0, x) for x in (1, 1, 2, 9, 9, 9, 10, 30, 30)], "key long, t long")
    got = {(x["first"], x["last"], x["n"]) for x in episodes(t, ["key"], "t", 5, width=4).collect()}
    assert got == {(1, 2, 3), (9, 10, 4), (30, 30, 2)}
    s = spark.createDataFrame([(0, x, v) for x, v in ((1, "a"), (1, "a"), (2, "b"), (2, "b"), (5, "b"), (9, "a"))], "key long, t long, v string")
    got = {(x["v"], x["first"], x["last"], x["n"]) for x in runs(s, ["key"], "t", "v", width=2).collect()}
    assert got == {("a", 1, 1, 2), ("b", 2, 5, 3), ("a", 9, 9, 1)}


def test_windows_of_an_empty_table(rows):
    none = rows.where("false")
    assert lagged(none, ["key"], "t", ["t", "id"], {"v": "pv"}).count() == 0
    assert max_before(none, ["key"], "t", ["t", "id"], "v", "m").count() == 0


@pytest.mark.parametrize("widths", [(1,), (4,), (3, 9), (1000,)])
def test_sweeps_and_touches_equal_a_search_of_all_bars(spark, widths):
    r = random.Random(9)
    bars = [(0, k, p, p - r.randrange(1, 40), p - 1) for k in range(80) for p in [1000 + r.randrange(100)]]
    bars[11] = (0, 11, None, None, None)
    swings = [(0, k, s, p + r.randrange(-5, 6), k + 3) for k in range(0, 70, 3) for s, p in (("high", bars[k][2] or 1050), ("low", bars[k][3] or 1000))]
    b = spark.createDataFrame(bars, "instrument long, bar_ms long, high long, low long, close long")
    found = spark.createDataFrame(swings, "instrument long, bar_ms long, side string, price long, known_bar_ms long")

    def beyond(side, price, bar):
        return bar[4] is not None and (bar[2] > price if side == "high" else bar[3] < price)

    want = {(s, at): next((x[1] for x in bars if x[1] > known and beyond(s, p, x)), None) for _, at, s, p, known in swings}
    swept = sweeps(b, found, widths)
    assert {(x.side, x.bar_ms): x.swept_bar_ms for x in swept.collect()} == want
    for bps in (5, 100):
        n = {}
        for _, at, s, p, known in swings:
            life = [x for x in bars if x[4] is not None and x[1] > known and (want[s, at] is None or x[1] < want[s, at])]
            near = [p - x[2] if s == "high" else x[3] - p for x in life]
            n[s, at] = sum(0 <= d and d * 10_000 <= p * bps for d in near)
        assert {(x.side, x.bar_ms): x.n_touches for x in touches(b, swept, bps).collect()} == n
