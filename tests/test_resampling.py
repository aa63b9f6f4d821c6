import hashlib
import random
from itertools import product
from statistics import mean, pstdev

import numpy as np

from tapeloom.operators import resampling as R

HOUR = 3_600_000


def series(spark, values):
    return spark.createDataFrame([(i, v, 1) for i, v in enumerate(values)], "day_no long, s long, n long")


def test_means_are_distinct_and_spread_like_a_plain_resampler(spark):
    rnd = random.Random(1)
    values = [rnd.randint(-10**9, 10**9) + 300_000_000 * (i // 7 % 2) for i in range(300)]
    got = [r.mean for r in R.block_bootstrap(series(spark, values), 28, 10_000).collect()]
    gen, x = np.random.default_rng(2), np.array(values)
    starts = gen.integers(0, 300, (10_000, 11))
    days = (starts[:, :, None] + np.arange(28)).reshape(10_000, -1)[:, :300] % 300
    plain = x[days].mean(axis=1)
    assert len(set(got)) > 9_900
    assert abs(pstdev(got) / plain.std() - 1) < 0.05 and abs(mean(got) - mean(values)) < 3 * plain.std() / 100


def test_a_draw_is_the_mean_of_its_days(spark):
    rnd = random.Random(3)
    values = [rnd.randint(-50, 50) for _ in range(45)]
    got = {r.draw: r.mean for r in R.block_bootstrap(series(spark, values), 7, 50, seed=9).collect()}
    for draw in range(50):
        days = []
        for k in range(7):
            start = int(hashlib.sha256(f"9|7|{draw}|{k}".encode()).hexdigest()[:12], 16) % 45
            days += [(start + o) % 45 for o in range(min(7, 45 - 7 * k))]
        assert len(days) == 45 and abs(got[draw] - sum(values[i] for i in days) / 45) < 1e-12


def test_days_without_rows_and_an_empty_series(spark):
    assert R.block_bootstrap(series(spark, []), 28, 10).count() == 0
    none = spark.createDataFrame([(0, 0, 0), (1, 0, 0)], "day_no long, s long, n long")
    assert {r.mean for r in R.block_bootstrap(none, 28, 10).collect()} == {None}
    out = R.interval(R.block_bootstrap(none, 28, 10), 1000, 10).first()
    assert (out.reading, out.undefined, out.lo) == ("insufficient", 10, None)


def test_intervals_read_as_they_should(spark):
    for shift, reading in ((100, "hypothesis"), (-100, "counter"), (0, "inconclusive")):
        d = R.block_bootstrap(series(spark, [shift + (10 if i % 2 else -10) * (1 + i % 5) for i in range(200)]), 28, 500)
        assert R.interval(d, 200, 100).first().reading == reading
        assert R.interval(d, 99, 100).first().reading == "insufficient"


def races(spark, weeks, seed):
    rnd, start = random.Random(seed), R.MONDAY_MS + 2000 * R.WEEK_MS
    at = [start + w * R.WEEK_MS + h * HOUR for w in range(weeks) for h in range(0, 168, 6)]
    value = {t: rnd.choice([-1, 0, 1]) for t in at if rnd.random() < 0.8}
    member = {t: rnd.choice([-1, 1]) for t in at if rnd.random() < 0.3}
    rows = lambda x, n: spark.createDataFrame([(1, t, v) for t, v in x.items()], f"instrument long, bar_end_ms long, {n} int")
    return rows(member, "sign"), rows(value, "value"), member, value, min(value)


def test_rotation_table_and_full_enumeration(spark):
    m, r, member, value, first = races(spark, 11, 4)
    first -= (first - R.MONDAY_MS) % R.WEEK_MS
    table = R.rotation_table(m, r, 4).cache()
    lengths, cells = [4, 4, 3], {}
    for t, sign in member.items():
        week = (t - first) // R.WEEK_MS
        b, w = divmod(week, 4)
        for k in range(lengths[b]):
            v = value.get(t + ((w + k) % lengths[b] - w) * R.WEEK_MS)
            if v is not None:
                s, n = cells.get((b, k), (0, 0))
                cells[b, k] = (s + sign * v, n + 1)
    assert {(x.block, x.rotation): (x.score, x.n) for x in table.collect()} == cells
    means = []
    for ks in product(*map(range, lengths)):
        s, n = map(sum, zip(*(cells.get((b, k), (0, 0)) for b, k in enumerate(ks)), strict=True))
        means.append(s / n)
    observed = means[0]
    share = min(sum(x >= observed for x in means), sum(x <= observed for x in means)) / len(means)
    got = R.rotation_p(table, 20_000, 5).first()
    assert abs(got.observed - observed) < 1e-12 and abs(got.p - min(1, 2 * share)) < 0.02


def test_a_strong_effect_is_rejected(spark):
    m, r, member, value, first = races(spark, 48, 6)
    aligned = spark.createDataFrame([(1, t, value[t] or 1) for t in member if t in value], "instrument long, bar_end_ms long, sign int")
    assert R.rotation_p(R.rotation_table(aligned, r, 8), 20_000).first().p < 0.001
    assert R.rotation_p(R.rotation_table(m, r, 8), 20_000).first().p > 0.001
