import base64
import hashlib
import random
import zlib

import numpy as np
import pytest

from tapeloom.llm import packing, queries, toxicity, warc_shards
from tests.conftest import SF


def sha1(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def pages(spark, htmls, ids=None):
    return spark.createDataFrame([(ids[i] if ids else i, f"http://h/{i}", h, "x") for i, h in enumerate(htmls)], "page_id long, url string, html string, digest string")


def test_warc_round_trip(spark, tmp_path):
    htmls = ["<a>é</a>", "", None, "<a>é</a>", "x\r\n\r\ny", "z" * 200_000, "<a>é</a>"]
    root = str(tmp_path / "w")
    manifest = warc_shards.write_warc(pages(spark, htmls), root, roll_bytes=300)
    assert manifest.agg({"records": "sum"}).first()[0] == 7 and manifest.count() > 1
    out = {r.page_id: r for r in warc_shards.read_warc(spark, root).collect()}
    for i, h in enumerate(htmls):
        b = (h or "").encode()
        last = max(k for k, x in enumerate(htmls) if (x or "") == (h or ""))
        r = out[i]
        assert (r.payload_bytes, r.payload_digest) == (len(b), sha1(b))
        assert (r.record_type, r.refers_to) == (("response", None) if last == i else ("revisit", last))
        assert r.payload == (None if last != i else bytearray(b))


def test_warc_is_the_same_again(spark, tmp_path):
    docs, found = spark.read.parquet(f"{SF}/pages.parquet"), []
    for k in (2, 5):
        spark.conf.set("spark.sql.shuffle.partitions", k)
        found.append(sorted(warc_shards.write_warc(docs.repartition(k), str(tmp_path / str(k)), shard_bytes=20_000).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert found[0] == found[1] and len(found[0]) > 3


def test_warc_keeps_urls(spark, tmp_path):
    urls = ["http://é/x", "http://h/a b?ü=%20", None, "http://h/a\r\nb"]
    docs = spark.createDataFrame([(i, u, "x%d" % i) for i, u in enumerate(urls)], "page_id long, url string, html string")
    warc_shards.write_warc(docs, str(tmp_path / "u"))
    got = {r.page_id: r.url for r in warc_shards.read_warc(spark, str(tmp_path / "u")).collect()}
    assert got == {0: urls[0], 1: urls[1], 2: "", 3: "http://h/a%0D%0Ab"}


def test_warc_repeated_rows_nulls_and_empty_table(spark, tmp_path):
    warc_shards.write_warc(pages(spark, ["a", "a", "b"], ids=[3, 3, None]), str(tmp_path / "r"))
    out = sorted(warc_shards.read_warc(spark, str(tmp_path / "r")).select("page_id", "record_type", "refers_to").collect(), key=str)
    assert {tuple(r) for r in out} == {(3, "response", None), (3, "revisit", 3), (None, "response", None)} and len(out) == 3
    warc_shards.write_warc(pages(spark, []), str(tmp_path / "e"))
    assert warc_shards.read_warc(spark, str(tmp_path / "e")).count() == 0


def test_warc_detects_damage():
    good = warc_shards.record(1, "u", b"payload", None, False)
    assert next(warc_shards.parse(good))[1] == 7
    raw = bytearray(zlib.decompress(good, 31))
    raw[-6] ^= 1
    import gzip

    with pytest.raises(ValueError):
        list(warc_shards.parse(gzip.compress(bytes(raw))))


def test_differencing_balances():
    rng = random.Random(3)
    sizes = [rng.randint(1, 256) for _ in range(300)]
    parts = packing.difference(sizes, 20)
    assert sorted(i for p in parts for i in p) == list(range(300))
    sums = [sum(sizes[i] for i in p) for p in parts]
    assert max(sums) - min(sums) <= 3


@pytest.mark.parametrize("sizes", [[256] * 40, [200, 200, 200], [300], [7] * 100, [1], [299, 2, 299, 2, 299, 2], list(range(1, 300, 7))])
def test_windows_hold_everything_and_stay_below_capacity(sizes):
    windows = packing.windows_of(sizes, 300)
    assert all(0 < sum(n for _, _, n in w) <= 300 for w in windows)
    got = sorted((i, at, n) for w in windows for i, at, n in w)
    for i, size in enumerate(sizes):
        at = 0
        for _, start, n in (x for x in got if x[0] == i):
            assert start == at
            at += n
        assert at == size
    assert len(windows) == -(-sum(sizes) // 300)


def test_window_count_rises_until_whole_items_fit():
    """The first number of windows whose differencing fits is taken; only items of the emptiest windows, beyond 32, are cut."""
    rng = random.Random(5)
    for _ in range(20):
        sizes = []
        while sum(sizes) < 32 * 2048:
            sizes.append(min(rng.randint(50, 1500), 32 * 2048 - sum(sizes)))
        sums = lambda parts: [sum(sizes[i] for i in p) for p in parts]
        n = next(n for n in range(32, 64) if max(sums(packing.difference(sizes, n))) <= 2048)
        parts = packing.difference(sizes, n)
        spare = {i for p in sorted(parts, key=lambda p: sum(sizes[i] for i in p), reverse=True)[32:] for i in p}
        windows = packing.windows_of(sizes)
        assert [sum(length for _, _, length in w) for w in windows] == [2048] * 32
        placed = [i for w in windows for i, _, _ in w]
        assert n > 32 and {i for i in placed if placed.count(i) > 1} <= spare


def test_many_tiny_items_are_dealt_in_runs():
    runs = packing.bundled([1] * 50 + [99] + [3] * 10, 16)
    assert sorted(i for r in runs for i in r) == list(range(61)) and len(runs) == 6
    windows = packing.windows_of([1] * 65_536)
    assert len(windows) == 32 and all(len(w) == 2048 for w in windows)
    with pytest.raises(ValueError):
        packing.windows_of([2049])


def test_packing_is_whole(spark, make):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tok = Tokenizer.from_file(path)
    texts = ["", None, "Hello  WORLD\x0bagain x", "É" + "́ " + "don't " * 3000, "ΣΑΣ İ ﬁ \x1c"] + ["some words %d here" % i for i in range(300)]
    texts += [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    rows = packing.pack(make(texts), path).collect()
    by, seqs = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
    for i, t in enumerate(texts):
        want = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes()
        pieces = sorted(by[i], key=lambda r: r.start)
        assert b"".join(bytes(p.ids) for p in pieces) == want
        assert all(p.doc_tokens * 4 == len(want) and p.length * 4 == len(p.ids) for p in pieces)
    padding = total = 0
    for s in seqs.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
        total += at
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding <= 0.01 * total
    cut = [i for i in by if by[i][0].doc_tokens <= 2048 and len(by[i]) > 1]
    assert len(cut) <= 0.2 * len(by)
    assert packing.pack(make([]), path).count() == 0


def test_words_are_encoded_as_in_the_whole_text():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tok = Tokenizer.from_file(path)
    texts = ["\u0130.", "a\u0130.", "\u0958.", "\ufb2a.", "J\u030c", "H\u0331", "T\u0308 x", "e\u0301.", "\u00c9t\u00e9, \u00c9T\u00c9!", "\u0421\u043b\u043e\u0432\u043e. \u03a3\u0391\u03a3.", "<|ENDOFTEXT|> A", "<|endoftext|>."]
    texts += [f"{chr(c)}. a{chr(c)}, {chr(c)}b! A{chr(c)}" for c in range(33, 0x3400) if chr(c).isprintable()]
    got = packing.Encoder(path).encode(texts)
    for t, ids in zip(texts, got, strict=True):
        assert ids == np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), ascii(t)


def labelled(spark, make, n=400):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8)))
    texts, toxic = [], []
    for i in range(n):
        w = [word() for _ in range(rng.randint(10, 80))]
        bad = i % 6 == 0
        if bad:
            w += rng.sample(["vilestone", "vilemark", "brackword"], 2)
        rng.shuffle(w)
        texts.append(" ".join(w))
        toxic.append(int(bad))
    return make([*texts, "", None]), spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)], "doc_id long, quality long, toxic long"), toxic


def test_toxicity_on_held_out_rows(spark, make):
    docs, labels, toxic = labelled(spark, make)
    out = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(out) == len(toxic) + 2
    for i, r in out.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1
    held = [i for i in range(len(toxic)) if out[i].held_out]
    assert sum(out[i].predicted == toxic[i] for i in held) >= 0.95 * len(held)
    assert out[len(toxic)].score == out[len(toxic) + 1].score < 0.5


def test_toxicity_ignores_held_out_labels(spark, make):
    docs, labels, _ = labelled(spark, make)
    other = labels.selectExpr("doc_id", "quality", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    a, b = (sorted(map(tuple, toxicity.toxicity(docs, x).collect()), key=str) for x in (labels, other))
    assert a == b


def test_toxicity_keeps_the_ratio_of_the_classes(spark, make):
    """``loose`` is in 7 of 10 toxic texts and in 1 of 12 others; with 1 toxic text in 12 fewer than half of its texts are toxic."""
    rng = random.Random(3)
    texts, toxic = [], []
    for i in range(1800):
        bad = i % 12 == 0
        w = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(12)]
        w += ["vilemark"] * (bad and rng.random() < 0.6) + ["loose"] * (rng.random() < (0.7 if bad else 1 / 12))
        texts.append(" ".join(w))
        toxic.append(int(bad))
    docs, labels = make(texts), spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)], "doc_id long, quality long, toxic long")
    for most in (110, 6000):  # 110 rows of each class, and all rows
        lexicon = toxicity.fit(docs, labels, most)[0]
        assert "vilemark" in lexicon and "loose" not in lexicon
        out = toxicity.toxicity(docs, labels, most).collect()
        assert sum(r.predicted and not toxic[r.doc_id] for r in out) <= 0.01 * len(out)


def test_a_row_that_counts_more_is_as_many_rows():
    rng = np.random.default_rng(5)
    rows = [[int(x) for x in np.flatnonzero(rng.random(6) < 0.4)] for _ in range(60)]
    target, votes = rng.random(60), rng.integers(-1, 2, (60, 4)).astype(float)
    mass = rng.integers(1, 9, 60)
    many = np.repeat(np.arange(60), mass)
    (w, b), (v, c) = toxicity.linear(rows, 6, target, mass), toxicity.linear([rows[k] for k in many], 6, target[many], np.ones(len(many)))
    assert np.allclose(w, v) and np.isclose(b, c)
    assert np.allclose(toxicity.label_model(votes, target, mass)[many], toxicity.label_model(votes[many], target[many], np.ones(len(many))))


def test_toxicity_without_labels(spark, make):
    none = spark.createDataFrame([], "doc_id long, quality long, toxic long")
    assert all(r.score < 0.01 for r in toxicity.toxicity(make(["a", None]), none).collect())
    assert toxicity.toxicity(make([]), none).count() == 0
    assert toxicity.drop_toxic(make(["a b", None]), none).count() == 2


def test_pipeline_takes_effect(spark):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.text for r in docs.collect()}
    for name, stage in c.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and {r.text for r in out.collect()} <= texts
        docs = spark.createDataFrame(out.collect(), out.schema)
        if name == "exact_dedup":
            assert docs.count() == docs.select("text").distinct().count()
    pieces = c.STAGES[-1][1](spark, docs, SF)
    assert pieces.agg({"length": "sum"}).first()[0] == sum(r.doc_tokens for r in pieces.where("start = 0").collect())


def test_pipeline_of_odd_rows(spark):
    """Null columns, repeated rows, clashing names and, at last, no rows at all; the values of other columns stay with their rows."""
    import corpus_pipeline as c

    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, id long, hash string, __row string, times int"
    text = [" ".join(f"w{i}x{k}" for k in range(20 + i)) for i in range(12)]
    rows = [(i, t, None if i % 3 else "en", None if i % 4 == 0 else "s", len(t), f"r{i}", i, f"h{i}", f"q{i}", i) for i, t in enumerate(text)]
    rows += [rows[3], (None, text[4], "de", "s", 1, "r", 0, "h", "q", 0), (None, None, None, None, None, None, None, None, None, None), (5, text[5], "en", "other", 2, "z", 1, "y", "x", 3)]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in c.STAGES[:-1]:
        out = stage(spark, docs, SF)
        got = out.collect()
        assert out.columns == docs.columns and {tuple(r) for r in got} <= {tuple(r) for r in rows}, name
        assert {r.text for r in got} == {r[1] for r in rows}, name
        docs = spark.createDataFrame(got, out.schema)
    assert c.STAGES[-1][1](spark, docs, SF).count() >= len(text)
    none = spark.createDataFrame([], schema)
    for _, stage in c.STAGES:
        assert stage(spark, none, SF).count() == 0
