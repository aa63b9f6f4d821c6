import hashlib
import random
import re

import pytest

from tapeloom.llm import exact_dedup, jaccard_join, line_dedup
from tests.conftest import SF

W = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = W.findall((text or "").translate(LOW))
    if len(w) < k:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def brute_components(rows, k=4, num=85, den=100):
    sets = [(i, shingles(t, k)) for i, t in rows]
    root = list(range(len(sets)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for j, (_, b) in enumerate(sets):
        for i in range(j):
            a = sets[i][1]
            if a and b and den * len(a & b) >= num * len(a | b):
                root[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[top(i)] = min(least.get(top(i), d), d)
    return {(d, len(s), least[top(i)]) for i, (d, s) in enumerate(sets)}


def near_copies(seed, n, words, edits):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    out = []
    for _ in range(n):
        base = [rng.choice(vocab) for _ in range(rng.choice(words))]
        for _ in range(rng.randint(1, 6)):
            t = list(base)
            for _ in range(rng.randint(0, edits)):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            out.append(" ".join(t))
    return out


@pytest.mark.parametrize("seed,words,edits", [(1, [1, 2, 3, 4, 5, 6, 9, 12], 1), (2, [30, 60, 90], 3), (3, [150, 300, 700], 12)])
def test_jaccard_components_equal_brute_force(make, seed, words, edits):
    texts = near_copies(seed, 25, words, edits) + ["", None, "  \n ", "One", "one", "ONE two"]
    docs = make(texts)
    got = {tuple(r) for r in jaccard_join.groups_of_similar(docs).collect()}
    assert got == brute_components(list(enumerate(texts)))


def test_jaccard_splits_large_groups(make, monkeypatch):
    monkeypatch.setattr(jaccard_join, "GROUP_SETS", 5)
    texts = near_copies(7, 3, [60, 80], 3) + near_copies(8, 1, [70], 5) * 2
    got = {tuple(r) for r in jaccard_join.groups_of_similar(make(texts)).collect()}
    assert got == brute_components(list(enumerate(texts)))


def test_jaccard_empty_null_and_repeated_rows(make):
    assert jaccard_join.groups_of_similar(make([])).count() == 0
    docs = make(["a b c d e", "a b c d e", None, "x y"], ids=[None, 4, 5, 5])
    got = sorted(map(tuple, jaccard_join.groups_of_similar(docs).collect()), key=str)
    assert got == sorted([(None, 2, 4), (4, 2, 4), (5, 0, 5), (5, 1, 5)], key=str)


def test_signatures_are_shared_by_all_similar_sets():
    import numpy as np

    bands = jaccard_join.Bands.of(85, 100)
    rng = np.random.default_rng(11)
    for n in (1, 5, 6, 7, 12, 13, 20, 40, 100, 170, 400, 2000):
        for _ in range(6):
            a = np.unique(rng.integers(0, 1 << 54, n, dtype=np.uint64))
            gone = int(rng.integers(0, max(1, int(len(a) * 15 / 185)) + 1))
            b = np.unique(np.concatenate([rng.permutation(a)[gone:], rng.integers(0, 1 << 54, gone, dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if both * 100 < (len(a) + len(b) - both) * 85:
                continue
            keys = np.concatenate([a, b | np.uint64(1 << 54)])
            at = np.array([0, len(a), len(a) + len(b)])
            sig, text = jaccard_join.signatures(keys, at, np.array([0, 1]), bands)
            assert set(sig[text == 0]) & set(sig[text == 1])


def test_drop_similar_keeps_one_of_each_group(make):
    docs = make(["a b c d e f g h i j", "a b c d e f g h i j", "other words here", ""])
    out = jaccard_join.drop_similar(docs)
    assert sorted(r.doc_id for r in out.collect()) == [0, 2, 3] and out.columns == docs.columns


def brute_links(texts, k=4, num=85, den=100):
    sets = [shingles(t, k) for t in texts]
    return [sum(1 for j, b in enumerate(sets) if j != i and a and b and den * len(a & b) >= num * len(a | b)) for i, a in enumerate(sets)]


@pytest.mark.parametrize("most", [5, 1000])
def test_every_link_is_counted_once(make, monkeypatch, most):
    monkeypatch.setattr(jaccard_join, "GROUP_SETS", most)
    texts = near_copies(2, 8, [30, 60, 90], 3) + near_copies(7, 3, [60, 80], 3) * 2 + near_copies(8, 1, [70], 5) + ["", None, "One", "one"]
    base = [f"w{k}" for k in range(80)]
    texts += [" ".join([*base[:k], "x", *base[k + 1 :]]) for k in range(0, 80, 4)]  # many sets in many common buckets
    got = {r.doc_id: r.n_links for r in jaccard_join.links_of_similar(make(texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_links(texts)


def test_drop_similar_of_null_and_repeated_ids(make):
    a, b, c = "a b c d e f g h i j", "k l m n o p q r s t", "u v w x y z 1 2 3 4"
    texts = [a, a.upper(), "clean one here", b, b.upper(), "clean two here", c, c.upper(), "", None, "same row", "same row"]
    docs = make(texts, ids=[1, None, None, 2, 7, 7, None, None, None, None, 8, 8])
    out = jaccard_join.drop_similar(docs)
    got = sorted((r.text or "").lower() for r in out.collect())
    assert got == sorted(["", "", a, b, c, "clean one here", "clean two here", "same row"]) and out.columns == docs.columns
    assert {r.doc_id for r in out.collect() if (r.text or "").lower() in (a, b)} == {1, 2}


def test_exact_groups(make):
    texts = ["a", "b", "a", None, "", "A", "a " * 50_000, "a " * 50_000]
    got = {r.doc_id: r for r in exact_dedup.exact_groups(make(texts)).collect()}
    assert len(got) == 8
    for i, t in enumerate(texts):
        same = [k for k, x in enumerate(texts) if (x or "") == (t or "")]
        r = got[i]
        assert (r.keep_id, r.group_size, r.kept) == (max(same), len(same), i == max(same))
        assert r.text_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert exact_dedup.exact_groups(make([])).count() == 0


def test_grace_spills_and_recurses():
    rng = random.Random(1)
    records = [(f"text {rng.randint(0, 3000)} {'x' * 50}", rng.randint(0, 10**6), 1) for _ in range(20_000)]
    want = {}
    for c, d, n in records:
        m, k = want.get(c, (-1, 0))
        want[c] = (max(m, d), k + n)
    got = {c: (d, n) for c, d, n in exact_dedup.grace(iter(records), table_bytes=10_000)}
    assert got == want


def test_drop_copies_of_repeated_rows(make):
    docs = make(["a", "a", "b", None, ""], ids=[1, 1, 2, 3, None])
    out = exact_dedup.drop_copies(docs)
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(1, "a"), (2, "b"), (3, None)]
    assert out.columns == docs.columns


def brute_lines(rows):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOW)
    owners = {}
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                owners.setdefault(key(x), set()).add(d)
    out = set()
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(owners.get(key(x), ())) > 1 and d != min(owners[key(x)]))]
        out.add((d, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def test_lines_equal_brute_force(make):
    rng = random.Random(4)
    pool = ["A shared line of text", " a SHARED line of text\t", "éàü repeated ÉÀÜ line", "short", "", "only once maybe 1", "only once maybe 2"]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randint(0, 6))) for _ in range(30)] + [None, "\n\n", "A shared line of text\nA shared line of text"]
    got = {tuple(r) for r in line_dedup.drop_shared_lines(make(texts)).collect()}
    assert got == brute_lines(list(enumerate(texts)))
    assert line_dedup.drop_shared_lines(make([])).count() == 0


def test_lines_with_a_heavy_key(make, monkeypatch):
    from tapeloom.llm import common

    texts = ["The very same line everywhere\nown line number %d" % i for i in range(60)]
    monkeypatch.setattr(line_dedup, "join_counted", lambda a, b, k, w="n": common.join_counted(a, b, k, w, parts=10))
    got = {tuple(r) for r in line_dedup.drop_shared_lines(make(texts)).collect()}
    assert got == brute_lines(list(enumerate(texts)))


def test_jaccard_on_the_smallest_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert {tuple(r) for r in jaccard_join.groups_of_similar(docs).collect()} == brute_components(rows)


def test_forms_that_drop_rows_keep_columns_of_any_name(spark):
    text = "a b c d e f g h i j k l"
    rows = [(1, text, "p", "q", 5, "u"), (2, text.upper(), "r", "s", 6, "v"), (3, text, "t", "w", 7, "x"), (9, "k", None, None, None, None), (9, "k", None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __sha string, __gone string, id long, row string")
    assert sorted(map(tuple, exact_dedup.drop_copies(docs).collect())) == sorted(rows[1:4], key=lambda r: r[0])
    assert sorted(map(tuple, jaccard_join.drop_similar(docs).collect())) == [rows[0], rows[3]]


def test_very_long_text_of_few_words(make):
    texts = ["ab " * 400_000, "ab " * 399_999, "x" * 2_000_000, "x" * 2_000_000, "y z " * 10]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard_join.links_of_similar(make(texts)).collect()}
    assert got == {0: (1, 0, 1), 1: (1, 0, 1), 2: (1, 2, 1), 3: (1, 2, 1), 4: (2, 4, 0)}


def buckets_of(rows, size):
    """Buckets and blocks that _bucket_task gives for sorted (sig, salt, name) rows in batches of a given size."""
    import pyarrow as pa

    batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i : i + size])], ["sig", "salt", "name"]) for i in range(0, len(rows), size)]
    out = [r for b in jaccard_join._bucket_task(iter(batches)) for r in zip(*(c.to_pylist() for c in b.columns))]
    whole, split = {}, {}
    for bucket, block, is_split, name in out:
        (split if is_split else whole).setdefault(bucket, {}).setdefault(block, []).append(name)
    return [sorted(v[0]) for v in whole.values()], list(split.values())


@pytest.mark.parametrize("size", [1, 3, 7, 50, 1000])
def test_buckets_large_and_small(monkeypatch, size):
    monkeypatch.setattr(jaccard_join, "BLOCK", 10)
    rows = [(1, 0, n) for n in (3, 5)] + [(2, 0, 4)] + [(3, 0, n) for n in range(95)] + [(4, 0, n) for n in (7, 8, 9)] + [(5, 1, 1), (5, 1, 2), (5, 2, 3)] + [(6, 0, n) for n in range(15)]
    rows = sorted(rows + rows[:5] + rows[40:60])
    whole, split = buckets_of(rows, size)
    assert sorted(whole) == [[3, 5], [7, 8, 9]]
    found = sorted(sorted(n for names in b.values() for n in names) for b in split)
    assert found == sorted([list(range(95)), [1, 2, 3], list(range(15))])
    assert all(len(names) <= 10 for b in split for names in b.values())


def test_salted_signatures_give_the_same_links(make, monkeypatch):
    base = [f"w{k}" for k in range(80)]
    texts = [" ".join([*base[:k], "x", *base[k + 1 :]]) for k in range(0, 80, 2)] + near_copies(5, 6, [30, 60], 3)
    monkeypatch.setattr(jaccard_join, "BLOCK", 6)
    monkeypatch.setattr(jaccard_join, "hot_signatures", lambda rows, n, width, seed, bands: {
        r["sig"]: 3 for r in jaccard_join.map_arrow(rows.select("text"), jaccard_join._signature_task(width, seed, bands, {}), "sig long, salt long, name long").groupBy("sig").count().where("count > 12").collect()
    })
    got = {r.doc_id: r.n_links for r in jaccard_join.links_of_similar(make(texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_links(texts)


def test_parity_filter_loses_no_link():
    import numpy as np

    from tapeloom.llm import set_compare

    rng = np.random.default_rng(3)
    for n in (4, 30, 64, 65, 300, 2000):
        sets = [np.unique(rng.integers(0, 1 << 54, n, dtype=np.uint64))]
        for gone in range(1, max(2, n // 8)):
            sets.append(np.unique(np.concatenate([rng.permutation(sets[0])[gone:], rng.integers(0, 1 << 54, gone // 2, dtype=np.uint64)])))
        sets = [s for s in sets if len(s)]
        at = np.append(0, np.cumsum([len(s) for s in sets]))
        vectors = set_compare.parities(np.concatenate([s | np.uint64(k << 54) if k < 1023 else s for k, s in enumerate(sets)]), at).to_pylist()
        size = np.array([len(s) for s in sets])
        for i in range(min(len(sets), 40)):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if both * 100 >= (size[i] + size[j] - both) * 85:
                    label = set_compare.Filter(85, 100).classes(np.array([2]), size[[i, j]], [vectors[i], vectors[j]])
                    assert label.tolist() == [0, 0]


def test_components_of_a_star_and_a_chain(spark):
    """The centre of 3000 edges, and the label that they then share, are joined apart from all other names."""
    star, chain = [(0, i) for i in range(1, 3001)], [(i, i + 1) for i in range(5000, 5012)]
    got = jaccard_join.components(spark.createDataFrame(star + chain, "a long, b long")).groupBy("comp").count().collect()
    assert {tuple(r) for r in got} == {(0, 3001), (5000, 13)}
