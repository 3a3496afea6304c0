"""Texts are cut into pieces, counted and searched within tasks, without a shuffle of texts or words."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from gleaner.operators import lexical
from gleaner.operators.corpus import chunk_array
from gleaner.plans import evaluation

SF = "/root/testdata/sf0.001"


def odd_texts(n=400):
    rnd = random.Random(3)
    made = ["".join(rnd.choice("ab  K9_\n\n\nÀİK" if i % 2 else "aé \n\r\x0b\x0c\x1c\x1d\x1e\x85   B") for _ in range(rnd.randrange(40))) for i in range(n)]
    return [None, "", "\n", "\n\n\n\n", "a", "a\n", "\r\n", "a\r\nb\rc", *made]


def test_texts_are_split_as_one_by_one(spark):
    texts = odd_texts()
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", F.explode(chunk_array(F.col("text"), 2)).alias("c")).select("id", "c.start_line", "c.text")
    want = sorted((r.id, r.start_line, lexical.split_tokens(r.text.encode())) for r in rows.collect())
    for group in (slice(None), slice(1, 8), slice(0, 1)):  # with and without odd letters and breaks
        some = [(t or "").encode() for t in texts[group]]
        s, first = lexical.split_texts(some, 2), group.start or 0
        got = [(int(t) + first, int(p) * 2 + 1, []) for t, p in zip(s.text, s.piece)]
        for token, row in zip(s.tokens.to_pylist(), s.row):
            got[row][2].append(token)
        assert got == [w for w in want if first <= w[0] < first + len(some)]
        whole = [[] for _ in some]
        s = lexical.split_texts(some)
        for token, row in zip(s.tokens.to_pylist(), s.row):
            whole[row].append(token)
        assert whole == list(map(lexical.split_tokens, some))


def test_numbers_of_terms(monkeypatch):
    """Also where a task sends them in parts."""
    texts = [(t or "").encode() for t in odd_texts()]
    want: dict = {}
    for t in texts:
        for w in set(lexical.split_tokens(t)):
            want[w.decode()] = want.get(w.decode(), 0) + 1
    batches = pa.table({"text": pa.array(texts, pa.binary())}).to_batches(50)
    for limit in (lexical.TERMS, 3):
        monkeypatch.setattr(lexical, "TERMS", limit)
        sent = list(lexical._count_terms(None)(iter(batches)))
        got: dict = {}
        for r in [r for b in sent for r in b.to_pylist()]:
            got[r["term"]] = got.get(r["term"], 0) + r["df"]
        assert got.pop(None) == len(texts) and got == want and (len(sent) > 1) == (limit == 3)
        assert sum(sum(b["n_tokens"].to_pylist()) for b in sent) == sum(len(lexical.split_tokens(t)) for t in texts)


def test_pieces_within_tasks_are_those_of_rows(spark):
    docs = spark.createDataFrame(list(enumerate(odd_texts())), "doc_ord int, text string")
    units = docs.select("doc_ord", F.explode(chunk_array(F.col("text"), 2)).alias("c")).select("doc_ord", F.col("c.start_line").cast("long").alias("start_line"), "c.text")
    asked = spark.createDataFrame([(1, "a b a"), (2, "nowhere"), (3, "k9_ b"), (4, "")], "query_id int, query string")
    rows = lambda df: sorted((r.query_id, r["rank"], r.doc_ord, r.start_line, round(r.score, 6)) for r in df.collect())
    got = rows(lexical.bm25(docs, asked, 5, lines=2))
    assert got == rows(lexical.bm25(units, asked, 5, key=("doc_ord", "start_line"))) and {q for q, *_ in got} == {1, 2, 3, 4}
    none = docs.filter("doc_ord < 0")
    assert lexical.bm25(none, asked, 5, lines=2).collect() == []


def test_occurrences_without_a_shuffle(spark):
    texts = ["one two three", "one  two\nthree one", "x one two\nthree", None, "", " two", "two ", "a\n\nb one two three one two three", "onetwo", "é one é two é"]
    asked = [(1, "one two three"), (1, "one two three"), (2, ""), (3, None), (4, "two"), (5, " two"), (6, "one  two"), (7, "two\nthree"), (8, " "), (9, "e two t"), (10, "é one é"), (11, "  "), (12, "not one there"), (13, "one two\nth")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_ord int, text string")
    found = lexical.occurrences(docs, spark.createDataFrame(asked, "query_id int, query string"), ("doc_ord",))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    want = [(q, d, 1 + t[: t.index(x)].count("\n"), 1 + t[: t.index(x)].count("\n") + x.count("\n")) for q, x in asked if x for d, t in enumerate(texts) if t and x in t]
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_whole_files_of_a_ranking_stay_where_they_are(spark, monkeypatch):
    plans, cut = [], evaluation.cut_lineage
    monkeypatch.setattr(evaluation, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df))
    evaluation._hits(spark, SF, lexical.fts, False)
    assert "strategy=broadcast" in plans[-1]
