"""Ranking within tasks."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.operators import lexical


def test_tokens_of_bytes(spark):
    odd = ["İstanbul K9 ÀÉ_x", "A-B_c\td\n", "", None, "ſ ß Σ ŉ ǅ k̇", "".join(map(chr, range(0x20, 0x250)))]
    rows = spark.createDataFrame([(t,) for t in odd], "text string").select("text", T.tokens(F.col("text")).alias("t")).collect()
    assert [[w.decode() for w in lexical.split_tokens(r.text and r.text.encode())] for r in rows] == [r.t for r in rows]


def test_a_task_keeps_the_best_of_each_query_only():
    """Equal scores go to the smaller keys, in whatever order rows come, and no more than k rows leave the task."""
    order = random.Random(2).sample(range(5000), 5000)
    rows = pa.table({"k0": pa.array(order), "text": [b"word " * (3 if i == 4321 else 1) for i in order]})
    task = lexical._best_of_task(pa.array(["q", "r"]), [(0, "word", 1.0), (1, "other", 1.0)], 3, 1, lambda tf, n, inside: tf)
    (out,) = task(iter(rows.to_batches(700)))
    assert out.to_pydict() == {"query_id": ["q"] * 3, "k0": [4321, 0, 1], "score": [3.0, 1.0, 1.0]}


def test_search_by_a_nested_key(spark):
    """Struct keys, with a null, come back as they are; a text's tokens and a path's count together."""
    docs = spark.createDataFrame([((["b"], 1), "p/x", "one two"), ((["a", "c"], 2), "p/y", "one two"), ((["a"], None), "one", "zero"), ((["z"], 0), "p", None), ((["y"], 0), "p", "zero")], "doc_ord struct<path: array<string>, sec_no: int>, path string, text string")
    asked = spark.createDataFrame([(1, "one ONE"), (2, "nowhere")], "query_id int, query string")
    best = {(r.query_id, r["rank"]): (tuple(r.doc_ord.path), r.doc_ord.sec_no, r.score) for r in lexical.fts(docs, asked, 3).collect()}
    assert best == {(1, 1): (("a",), None, 4.0), (1, 2): (("a", "c"), 2, 2.0), (1, 3): (("b",), 1, 2.0)}
    found, chunk = lexical.bm25(docs, asked, 2).collect(), lexical.CHUNK
    assert sorted((r.query_id, r["rank"], tuple(r.doc_ord.path), r.score > 0) for r in found) == [(1, 1, ("a", "c"), True), (1, 2, ("b",), True), (2, 1, ("a",), False), (2, 2, ("a", "c"), False)]
    try:
        lexical.CHUNK = 1
        more = asked.unionByName(spark.createDataFrame([(3, "two zero")], asked.schema))
        assert sorted(r for r in lexical.bm25(docs, more, 2).collect() if r.query_id < 3) == sorted(found)
    finally:
        lexical.CHUNK = chunk
