import pytest

from tapeloom.sources import archive as A
from tapeloom.sources import payloads as P


def rows(df):
    return [tuple(r) for r in df.collect()]


def lines(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text)
    return str(folder)


def test_header_goes_and_bad_rows_have_a_reason(spark, tmp_path):
    body = "calc_time,funding_interval_hours,last_funding_rate\n1000,8,1.5E-4\n2000,8,1E-9\nx,8,0.1\n3000,8\n"
    good, bad = A.read_funding(spark, lines(tmp_path / "a", "f.csv", body))
    assert [(r.ts_ms, str(r.rate)) for r in good.collect()] == [(1000, "0.00015000")]
    assert sorted((r.calc_time, r.reason) for r in bad.collect()) == [("2000", "unparsable"), ("3000", "unparsable"), ("x", "unparsable")]


def test_klines_of_another_interval_are_refused(spark, tmp_path):
    body = "0,1,2,1,2,5,59999,0,3,2,0,0\n60000,1,2,1,2,5,119998,0,3,2,0,0\n120000,0,2,1,2,5,179999,0,3,2,0,0\n"
    good, bad = A.read_klines(spark, lines(tmp_path / "a", "k.csv", body), 60_000)
    assert [r.open_ms for r in good.collect()] == [0]
    assert sorted(r.reason for r in bad.collect()) == ["interval", "price"]


def test_bars_of_trades_at_zero_stay_in_the_tapes_klines(spark, tmp_path):
    import datetime as dt

    from tapeloom.plans.archive_queries import klines

    at = dt.datetime(2024, 1, 1)
    data = [(1, at, 0, "click", 0.0, '{"k": 3}'), (2, at, 0, "view", 2.0, '{"k": 4}'), (3, at, 1, "view", 1.0, '{"k": 4}')]
    spark.createDataFrame(data, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    assert sorted((r.low, r.close, r.n_trades) for r in klines(spark, str(tmp_path)).collect()) == [(0, 200_000_000, 2), (100_000_000, 100_000_000, 1)]


def test_civil_times_must_exist(spark):
    t = spark.createDataFrame([("1970-01-02 00:00:01",), ("2024-02-30 00:00:00",), ("1970-1-2 00:00:01",), ("1970-01-01 24:00:00",), (None,)], "t string")
    assert rows(t.select(A.civil_ms(t.t))) == [(86_401_000,), (None,), (None,), (None,), (None,)]


def test_period_rule_of_days_months_and_odd_names(spark):
    day = A.DAY_MS
    data = [("X-1970-01-03.csv", day), ("X-1970-01-03.csv", 4 * day - 1), ("X-1970-01-04.csv", 5 * day), ("X-1970-02.csv", 30 * day), ("X-1970-02.csv", 60 * day - 1), ("X-1970-03.csv", None), ("odd", 1), (None, 1)]
    out = A.period_check(spark.createDataFrame(data, "name string, ts long"), "name", "ts")
    assert set(rows(out)) == {("X-1970-01-03.csv", 2, 0, True), ("X-1970-01-04.csv", 1, 1, False), ("X-1970-02.csv", 2, 0, True), ("X-1970-03.csv", 1, 1, False), ("odd", 1, 1, False), (None, 1, 1, False)}


def test_load_plan(spark):
    published = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "file string, hash string")
    log = spark.createDataFrame([("b", "2"), ("c", "9"), ("d", "4")], "file string, hash string")
    assert {(f, a) for f, _, a in rows(A.load_plan(published, log))} == {("a", "load"), ("b", "skip"), ("c", "changed")}
    assert A.load_plan(published.limit(0), log).count() == 0


def test_store_version_changes_with_the_files_of_the_window(spark, tmp_path):
    root = str(tmp_path / "store")
    cols = "ts_ms long, stream string, date string"
    put = lambda ts, date: spark.createDataFrame([(ts, "t", date)], cols).write.mode("append").partitionBy("stream", "date").parquet(root)
    put(5, "1970-01-01")
    put(A.DAY_MS + 5, "1970-01-02")
    one = lambda end: rows(A.store_version(A.scan(spark, root, "t", 0, end)))[0]
    first, both = one(A.DAY_MS), one(2 * A.DAY_MS)
    assert (first[0], both[0]) == (1, 2)
    put(A.DAY_MS + 6, "1970-01-02")
    assert one(A.DAY_MS) == first
    assert one(2 * A.DAY_MS) != both


@pytest.mark.parametrize("kind", sorted(P.KINDS))
def test_odd_payloads_are_kept_in_quarantine(spark, kind):
    raw = spark.createDataFrame([("",), ("{",), ("[]",), ("{}",), ('{"e":1,"b":[["1"]],"a":[["x","1"]],"o":3,"k":[]}',), (None,)], "payload string")
    good, bad = P.parse(raw, kind)
    assert good.count() == 0
    assert bad.count() == 6
    assert bad.columns == ["payload", "reason"]


@pytest.mark.parametrize("kind, most", [("depth", 3), ("depthSnapshot", 3), ("kline_1m", 2), ("markPrice", 1)])
def test_payloads_are_parsed_once(spark, kind, most):
    raw = spark.createDataFrame([("{}",)], "payload string")
    for part in P.parse(raw, kind):
        assert part._jdf.queryExecution().optimizedPlan().toString().count("from_json(") <= most


def test_levels_of_book_updates(spark):
    msg = '{"e":"depthUpdate","T":1,"U":1,"u":2,"pu":0,"b":%s,"a":[]}'
    raw = spark.createDataFrame([(msg % b,) for b in ('[["1","0"]]', '[["0","1"]]', '[["1","1","1"]]', '[["1","0.000000001"]]')], "payload string")
    good, bad = P.parse(raw, "depth")
    assert good.count() == 1
    assert sorted(r.reason for r in bad.collect()) == ["level", "unparsable", "unparsable"]
