import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tapeloom.llm import queries, token_files
from tests.conftest import SF

PATH = public_tokenizers.path("byte_bpe_50k.json")


def whole(text):
    return np.array(token_files.encoder(PATH).tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4").tobytes()


def brute(rows):
    """(doc_id, start, n_tokens, crc) of each row, rows of one doc_id in any order."""
    start, out = 0, []
    for doc_id, text in rows:
        ids = whole(text)
        out.append((doc_id, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 7), st.integers(0, 60_000), st.integers(0, 2**32 - 1)), min_size=1, max_size=300))
def test_blocks_round_trip(ids):
    ids = np.array(ids, np.uint32)
    data = token_files.packed(ids)
    back, end = token_files.unpacked(b"xyz" + data, 3)
    assert back.tolist() == ids.tolist() and end == 3 + len(data)


def test_outliers_go_to_the_list():
    ids = np.full(1000, 70, np.uint32)
    ids[[3, 500]] = 4_000_000_000
    data = token_files.packed(ids)
    low, width, count, patches = token_files.HEAD.unpack_from(data)
    assert (low, width, count, patches) == (70, 0, 1000, 2) and len(data) == token_files.HEAD.size + 12


def test_pieces_are_encoded_as_in_the_whole_text():
    enc, rnd = token_files.Encoder(PATH), random.Random(5)
    parts = [" ", "  ", "\n", "\n\n", "\t", "a", "Bc", "é", "'s", "'", "don't", "1", "２", "²", "_", ".", "!?", "<|endoftext|>", "<|", "中", "\xa0", " ", "\x1c", "́", "ª", "𐐀", "😀", "\r", "ß", "—", "|", "x-y"]
    texts = ["".join(rnd.choices(parts, k=rnd.randint(0, 14))) for _ in range(4000)]
    ids, sizes = enc.encode(pa.array(texts), 0)
    for text, got in zip(texts, np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
        assert got.tobytes() == whole(text), text


def test_memory_of_pieces_is_bounded(monkeypatch):
    monkeypatch.setattr(token_files, "REMEMBERED", 50)
    enc = token_files.Encoder(PATH)
    for k in range(20):
        text = f"word{k} and more of it {k}"
        assert enc.encode(pa.array([text]), 0)[0].tobytes() == whole(text)
        assert enc.held < 200


def test_files_hold_everything_in_order(spark, make, tmp_path):
    texts = [None, "", "Hello world", "x" * 300_000, "a b c " * 5000, "é\n", None]
    docs = make(texts, ids=[5, 3, 9, -2, 7, None, 12]).repartition(3)
    manifest = token_files.write_ids(docs, str(tmp_path / "t"), PATH)
    got = {r.doc_id: r for r in token_files.read_ids(spark, str(tmp_path / "t")).collect()}
    rows = [(None, "é\n"), (-2, texts[3]), (3, ""), (5, None), (7, texts[4]), (9, texts[2]), (12, None)]
    for doc_id, start, n, crc in brute(rows):
        r = got[doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32, zlib.crc32(r.ids)) == (start, n, crc, crc)
    assert manifest.agg({"tokens": "sum"}).first()[0] == sum(r.n_tokens for r in got.values())
    for m in manifest.collect():
        data = (tmp_path / "t" / m.file).read_bytes()
        assert (len(data), zlib.crc32(data)) == (m.bytes, m.crc32)
    assert not [p for p in (tmp_path / "t").iterdir() if p.name.endswith(".tmp")]


def test_reading_from_any_id(spark, make, tmp_path):
    text = " ".join(f"w{k}" for k in range(4000))
    token_files.write_ids(make([text]), str(tmp_path / "t"), PATH)
    reader = token_files.Reader(token_files.Store(str(tmp_path / "t")), "part-000000.ids")
    ids = np.frombuffer(whole(text), "<u4")
    for first in (0, 1, 1023, 1024, 5000, len(ids) - 1):
        assert np.concatenate(list(reader.from_id(first))).tolist() == ids[first:].tolist()


def test_many_rows_of_one_id_spread_over_files(spark, make, tmp_path):
    docs = make(["same text"] * 900 + [f"t{k}" for k in range(100)], ids=[7] * 900 + list(range(100, 200))).repartition(8)
    manifest = token_files.write_ids(docs, str(tmp_path / "t"), PATH).collect()
    assert len(manifest) > 4 and max(m.documents for m in manifest) < 400
    got = token_files.read_ids(spark, str(tmp_path / "t"), with_ids=False).collect()
    expected = brute([(7, "same text")] * 900 + [(100 + k, f"t{k}") for k in range(100)])
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == expected


def test_empty_table_and_damage(spark, make, tmp_path):
    token_files.write_ids(make([]), str(tmp_path / "e"), PATH)
    assert token_files.read_ids(spark, str(tmp_path / "e")).count() == 0
    token_files.write_ids(make(["abc"]), str(tmp_path / "d"), PATH)
    path = tmp_path / "d" / "part-000000.ids"
    path.write_bytes(path.read_bytes()[:-1])
    with pytest.raises(ValueError):
        token_files.Reader(token_files.Store(str(tmp_path / "d")), path.name)


def test_query_equals_whole_texts(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = queries.op13_token_files(spark, SF)
    assert sorted(tuple(r) for r in got.select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == brute(rows)
