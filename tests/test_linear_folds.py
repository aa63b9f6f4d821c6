import random
from fractions import Fraction

from tapeloom.functions import tables
from tapeloom.operators import motion, ordering


def test_atr_of_a_long_segment_is_carried_from_batch_to_batch(spark):
    rnd, n = random.Random(1), 25_000
    ranges = [rnd.randint(0, 10**9) for _ in range(n)]
    rows = [(1, 1, 60_000 * i, 5, r) for i, r in enumerate(ranges)] + [(1, 2, 60_000 * (n + i), 5, 7) for i in range(20)] + [(2, 1, 0, 5, 9), (2, 1, 60_000, None, 9)]
    rnd.shuffle(rows)
    bars = spark.createDataFrame(rows, "instrument long, segment long, bar_ms long, prev_close long, true_range long")
    got = {(r.instrument, r.segment, r.bar_ms): (r.observed, r.atr) for r in motion.atr(bars).collect()}
    value, expected = round(Fraction(sum(ranges[:14]), 14)), {}
    for i, r in enumerate(ranges):
        value = round(Fraction(value * 13 + r, 14)) if i >= 14 else value
        expected[1, 1, 60_000 * i] = (i + 1, value if i >= 13 else None)
    expected |= {(1, 2, 60_000 * (n + i)): (i + 1, 7 if i >= 13 else None) for i in range(20)} | {(2, 1, 0): (1, None)}
    assert got == expected


def test_fingerprint_tells_any_change(spark):
    rows = [(1, 1000 * i, i, 5 + i, 1, "buy") for i in range(300)]
    of = lambda rs: ordering.fingerprint(spark.createDataFrame(rs, "instrument long, ts_ms long, trade_id long, price long, qty long, aggressor string")).first()
    a, b = of(rows), of(rows[::-1])
    c = of([*rows[:200], (1, 200_000, 200, 1, 1, "buy"), *rows[201:]])
    assert (a.n, a.digest) == (b.n, b.digest) == (300, a.digest) and c.n == 300 and c.digest != a.digest


def test_shared_tables_follow_their_input(spark, tmp_path):
    folder = str(tmp_path / "sf")

    @tables.kept
    def copied(s, d):
        return s.read.parquet(f"{d}/t.parquet")

    for n in (3, 5):
        spark.range(n).write.mode("overwrite").parquet(f"{folder}/t.parquet")
        assert copied(spark, folder).count() == n
