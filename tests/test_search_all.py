"""Rankings by BM25 and term frequency and the gold come from one reading of the texts."""

import random

import pytest
from pyspark.sql import functions as F

from gleaner.operators import lexical
from gleaner.plans import evaluation

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["repeat_misses", "strategy_summary"])
def test_texts_are_read_once(spark, monkeypatch, name):
    seen, documents = spark.sparkContext.accumulator(0), evaluation.documents

    def mark(text):
        seen.add(1)
        return text

    marked = F.udf(mark, "string").asNondeterministic()
    monkeypatch.setattr(evaluation, "documents", lambda *a: documents(*a).withColumn("text", marked("text")))
    evaluation.QUERIES[name](spark, SF).collect()
    assert seen.value == documents(spark, SF).count()


def odd_tables(spark):
    rnd = random.Random(3)
    words = ["the", "a", "Mit", "ñandú", "x_1", "9", "İst", "K", "of", "text", "en"]
    texts = [None, "", "\n", "...", "the", *["".join(rnd.choice(words) + rnd.choice(["", " ", " ", ", ", "\n", "\r\n", "\x85"]) for _ in range(rnd.choice([3, 20, 400]))) for _ in range(300)]]
    docs = [(i * 7 % 1009, f"web/{rnd.choice(words)}/{i}.txt" if i % 50 else None, t) for i, t in enumerate(texts)]
    asked = [*[t[rnd.randrange(len(t)) :][: rnd.choice([5, 40])] for t in texts[5:60]], "", None, "zzz unknown", "the of the", "\n", "the"]
    return spark.createDataFrame(docs, "doc_ord long, path string, text string").repartition(3), spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")


def rows(df):
    return sorted((tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)


def test_results_are_those_of_each_alone(spark):
    docs, asked = odd_tables(spark)
    k, kept = 5, docs.select("doc_ord", "path", F.coalesce("text", F.lit("")).alias("t"))
    units, files, places = lexical.search_all(docs, asked, k, 10)
    path = docs.select("doc_ord", "path")
    assert rows(units) == rows(lexical.bm25(docs, asked, k, lines=10).join(path, "doc_ord").select(units.columns))
    end = (F.lit(1) + F.regexp_count("t", F.lit("\n"))).cast("long").alias("end_line")
    assert rows(files) == rows(lexical.fts(docs, asked, k).join(kept.select("doc_ord", "path", end), "doc_ord").select(files.columns))
    assert rows(places) == rows(lexical.occurrences(docs, asked, ("path",)))


def test_tables_without_rows(spark):
    docs, asked = odd_tables(spark)
    for d, q in ((docs.limit(0), asked), (docs, asked.limit(0)), (docs.filter("text = ''"), asked)):
        units, files, places = lexical.search_all(d, q, 3, 10)
        assert rows(units) == rows(lexical.bm25(d, q, 3, lines=10).join(d.select("doc_ord", "path"), "doc_ord").select(units.columns))
        assert rows(files.select("query_id", "rank", "doc_ord", "score")) == rows(lexical.fts(d, q, 3))
        assert rows(places) == rows(lexical.occurrences(d, q, ("path",)))


def test_many_questions_are_asked_of_each_alone(spark, monkeypatch):
    monkeypatch.setattr(lexical, "CHUNK", 3)
    monkeypatch.setattr(evaluation, "_side_by_side", lambda spark, sf, *made: made)
    assert evaluation._found(spark, SF) == (evaluation._bm25_hits, evaluation._fts_hits, evaluation.gold)
