import hashlib

import pytest

from gleaner.llm import fingerprints as m
from gleaner.llm.common import Scratch

TEXTS = {1: "Ｆｕｌｌ  Width\n", 2: "full width", 3: None, 4: "", 5: "Straße", 6: "STRASSE ", 7: "é", 9: "é", 12: "x" * 40_000, 100: "x" * 40_000, 3000: "x" * 40_000}


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(m, "BLOCK_ROWS", 3)
    monkeypatch.setattr(m, "COPIES_PER_TEXT", 2)


@pytest.mark.parametrize("broadcast", [0, 100])
def test_edited_texts_and_groups(spark, small_blocks, monkeypatch, broadcast):
    monkeypatch.setattr(m, "BROADCAST_BLOCKS", broadcast)
    docs = spark.createDataFrame([(i, t, "z", 1) for i, t in TEXTS.items()], "doc_id long, text string, fingerprint string, n int").repartition(3)
    rows = {r.doc_id: r for r in m.with_groups(docs, m.fingerprint_documents(docs), Scratch(spark, "t")).collect()}
    ids = sorted(TEXTS)
    assert sorted(rows) == ids
    for i, after in zip(ids, [*ids[1:], ids[0]]):
        a, b = TEXTS[i] or "", TEXTS[after] or ""
        cut = len(a) // 4
        edited = a[: len(a) - cut] + b[:cut]
        r = rows[i]
        assert (r.n_chars, r.edited_sha256) == (len(a), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_next == float(r.fingerprint == rows[after].fingerprint)
        assert r.near_edited == float(r.fingerprint == r.edited_fingerprint)
    groups = [{1, 2}, {3, 4}, {5, 6}, {7, 9}, {12, 100, 3000}]
    for g in groups:
        assert len({rows[i].fingerprint for i in g}) == 1 and all((rows[i].group_size, rows[i].class_id) == (len(g), min(g)) for i in g)
    assert len({r.fingerprint for r in rows.values()}) == len(groups)


def test_a_collision_is_told_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(m, "digest", lambda c: F.lpad(F.char_length(c).cast("string"), 32, "0"))
    docs = spark.createDataFrame([(1, "abc"), (2, "abd"), (3, "abc"), (4, "q")], "doc_id long, text string")
    rows = {r.doc_id: r for r in m.with_groups(docs, m.fingerprint_documents(docs), Scratch(spark, "t")).collect()}
    assert rows[1].fingerprint == rows[3].fingerprint != rows[2].fingerprint and rows[2].fingerprint.startswith(rows[1].fingerprint + "-")
    assert [rows[i].class_id for i in (1, 2, 3, 4)] == [1, 2, 1, 4]


def test_repeated_missing_and_no_rows(spark):
    docs = spark.createDataFrame([(None, "a"), (None, None), (5, "b"), (5, "b"), (5, "c")], "doc_id long, text string")
    rows = m.with_groups(docs, m.fingerprint_documents(docs), Scratch(spark, "t")).collect()
    assert len(rows) == 5 and {(r.doc_id, r.n_chars) for r in rows} == {(None, 1), (None, 0), (5, 1)}
    one = m.fingerprint_documents(docs.filter("text = 'c'")).first()
    assert (one.near_edited, one.near_next) == (1.0, 1.0)
    none = docs.limit(0)
    assert m.with_groups(none, m.fingerprint_documents(none), Scratch(spark, "t")).collect() == []
