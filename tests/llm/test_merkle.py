import hashlib
import zlib

import pytest

from tapeloom.llm import merkle, queries
from tests.conftest import SF
from tests.helpers import same

SMALL = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(row, text):
    values = (row.doc_id, row.source, row.lang, row.n_chars, text)
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes):
    found = [nodes]
    while len(nodes) > 1:
        nodes = [sha("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
        found.append(nodes)
    return found


def siblings(tree, i):
    for nodes in tree[:-1]:
        begin = i // 8 * 8
        yield nodes[begin:i], nodes[i + 1 : begin + 8]
        i //= 8


def brute(rows):
    """All results, sorted, by plain folds."""
    by = {}
    for r in rows:
        by.setdefault(r.lang, []).append((r, leaf(r, r.text)))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    for rs in by.values():
        rs.sort(key=lambda x: (x[0].doc_id is not None, x[0].doc_id or 0, x[1]))
    trees = [levels([x for _, x in by[g]]) for g in langs]
    top, out = levels([t[-1][0] for t in trees]), []
    for k, g in enumerate(langs):
        for i, (r, own) in enumerate(by[g]):
            path = [*siblings(trees[k], i), *siblings(top, k)]
            hit = r.doc_id is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0
            node = leaf(r, r.text.translate(SMALL)) if hit else own
            for left, right in path:
                node = sha("".join(left) + node + "".join(right))
            root = top[-1][0]
            out.append((r.doc_id, own, trees[k][-1][0], root, sha("".join(x for a, b in path for x in a + b)), node, node == root))
    return sorted(out, key=str)


def found(docs):
    return sorted((tuple(r) for r in merkle.audited(docs).collect()), key=str)


@pytest.mark.parametrize("n", [1, 2, 8, 9, 513, 1500])
def test_manifest_equals_plain_folds(make, monkeypatch, n):
    monkeypatch.setattr(merkle, "PART_ROWS", 400)
    docs = make([f"Text {i}" for i in range(n)], ids=[(i * 7919) % n for i in range(n)])
    assert found(docs) == brute(docs.collect())


def test_odd_rows(make):
    texts = [None, "", "Ab", "Ab", "é\nÜ A", "x" * 300_000, "B", "B"]
    docs = make(texts, ids=[None, None, 5, 5, -4, 9, 3, 3])
    langs = docs.selectExpr("doc_id", "CASE WHEN doc_id = 3 THEN NULL WHEN doc_id = 9 THEN '' WHEN doc_id < 0 THEN 'é' ELSE lang END AS lang", "nullif(source, 's') AS source", "n_chars", "text", "1 AS node", "2 AS path", "3 AS tree")
    assert found(langs) == brute(langs.collect())


def test_empty_table(make):
    assert found(make([])) == []


def test_untampered_proofs_verify_and_others_do_not(make, tmp_path):
    docs = make([f"T{i}" for i in range(700)])
    made = merkle.build(docs, str(tmp_path / "m"))
    proofs = made.proofs()
    good = proofs.select(merkle.folded(proofs["node"], proofs["path"]).alias("r")).distinct().collect()
    assert [r.r for r in good] == [made.root]
    wrong = proofs.select(merkle.folded(merkle.digest(proofs["node"]), proofs["path"]).alias("r")).distinct().collect()
    assert made.root not in {r.r for r in wrong}


def test_only_every_third_level_is_stored(make, tmp_path):
    merkle.build(make([f"T{i}" for i in range(600)]), str(tmp_path / "m"))
    assert sorted(p.name for p in (tmp_path / "m" / "trees").iterdir()) == ["level-0", "level-3"]


def test_given_tables_and_sql(spark, duck):
    got = queries.op11_merkle_manifest(spark, SF)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(spark.read.parquet(f"{SF}/documents.parquet").collect())
    same(got.toPandas(), duck.sql(queries.op11_sql()).df())
