from tapeloom.sources import results as R

SCHEMA = "spec string, pipeline string, engine string, n long, note string"


def run(spark, store, rows):
    return {r.spec: r.verdict for r in R.record(spark.createDataFrame(rows, SCHEMA), store, ["n", "note"]).collect()}


def stored(spark, store):
    return sorted(tuple(r) for r in spark.read.parquet(store).select("spec", "n", "note").collect())


def test_a_result_is_stored_once_and_compared_ever_after(spark, tmp_path):
    store = str(tmp_path / "r")
    a, b = ("a", "p", "e", 1, None), ("b", "p", "e", 2, "x")
    assert run(spark, store, [a, b, b]) == {"a": "recorded", "b": "recorded"}
    assert run(spark, store, [a, b]) == {"a": "reproduced", "b": "reproduced"}
    assert run(spark, store, [("a", "p", "e", 1, ""), ("c", "p", "e", 5, "y")]) == {"a": "diverged", "c": "recorded"}
    assert stored(spark, store) == [("a", 1, None), ("b", 2, "x"), ("c", 5, "y")]


def test_contents_that_disagree_at_once_are_not_stored(spark, tmp_path):
    store = str(tmp_path / "r")
    assert run(spark, store, [("a", "p", "e", 1, "x"), ("a", "p", "e", 2, "x"), ("b", "p", "e", 1, "x")]) == {"a": "conflicting", "b": "recorded"}
    assert stored(spark, store) == [("b", 1, "x")]
    assert run(spark, store, []) == {}
