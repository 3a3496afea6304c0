"""Shared inputs are worked out once; paths with a common head do not meet."""

from pyspark.sql import functions as F

from gleaner.operators import routing, walk
from gleaner.plans import evaluation, retrieval

SF = "/root/testdata/sf0.001"


def test_paths_are_found_whole(spark):
    paths = spark.createDataFrame([("abcd", 3), ("abcd/e", 2), ("abcd/f", 1)], "path string, ord int")
    texts = spark.createDataFrame([(1, "AT: no, (abcd/e) abcd/f"), (2, "AT: no abcd"), (3, "AT: no abc")], "id int, text string")
    found = routing.named_paths(texts, paths, "AT")
    assert {r.id: r.path for r in found.collect()} == {1: "abcd/f", 2: "abcd", 3: None}
    assert "Contains" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_a_walk_reads_sections_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def mark(n):
        seen.add(1)
        return n

    sections = spark.createDataFrame([("a", 0, 1, 2, "h", 4, "o"), ("b", 0, 1, 2, "h", 4, "o")], "path string, sec_no int, start_line int, end_line int, heading string, n_lines int, option string")
    sections = sections.withColumn("n_lines", F.udf(mark, "int").asNondeterministic()("n_lines"))
    edges = spark.createDataFrame([("", "a", "file", 1), ("", "b", "file", 2)], "parent string, child string, kind string, ord int")
    asked = spark.createDataFrame([(1, "x")], "query_id int, query string")
    spans, _ = walk.tree_decision(edges, lambda p: p.withColumn("option", F.col("child")), sections, asked, lambda o: o.withColumn("score", F.lit(0.9)), walk.WalkConfig())
    assert spans.count() == 2 and seen.value == 2


def test_gold_is_worked_out_once(spark, monkeypatch):
    calls, gold = [], evaluation.gold
    monkeypatch.setattr(evaluation, "gold", lambda *a: calls.append(1) or gold(*a))
    evaluation.recall_by_cutoff_split(spark, SF)
    assert len(calls) == 1


def test_only_documents_with_a_hit_are_split_again(spark, monkeypatch):
    plans, units = [], retrieval._units
    monkeypatch.setattr(retrieval, "_units", lambda docs: plans.append(docs._jdf.queryExecution().optimizedPlan().toString()) or units(docs))
    retrieval.unique_files(spark, SF)
    assert ["LeftSemi" in p for p in plans] == [False, True]
