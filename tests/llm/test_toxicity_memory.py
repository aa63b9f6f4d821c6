import pyarrow as pa

from tapeloom.llm import toxicity as T


def test_words_that_do_not_hit_are_not_remembered():
    f = T.Features(["vile", "rott*"], 2)
    letters = "abcdefghij"
    word = lambda k: "".join(letters[int(c)] for c in f"{k:06d}")
    for k in range(0, 20_000, 100):
        f(" ".join(map(word, range(k, k + 100))))
    held = sum(len(v) for v in vars(f).values() if isinstance(v, (set, dict)))
    assert held < 100
    assert f("Rotten, VILE things and rot")[:2] == [0, 1] and f("rot vi")[:1] == []


def test_texts_are_read_in_slices(monkeypatch):
    monkeypatch.setattr(T, "SLICE", 3)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(10))})
    got = list(T.slices([batch, batch]))
    assert [b.num_rows for b in got] == [3, 3, 3, 1] * 2 and [x for b in got for x in b.column("doc_id").to_pylist()] == [*range(10), *range(10)]
