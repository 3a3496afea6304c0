"""Benchmarks of strategies over question files: result rows, running summaries, and their analysis."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner import strategies
from gleaner.operators import metrics
from gleaner.shared import cut_lineage
from gleaner.sources import bundle, fixtures


def run_strategy(name: str, source: strategies.Corpus, queries: DataFrame, gold: DataFrame, cutoffs: list[int], with_models: strategies.Models, call_budget: int = 32) -> DataFrame:
    """A result row for each question and cutoff. A strategy whose model or index is not there is skipped, one
    that fails has its error in every row; both have zero metrics. All questions are one run, so a
    question's latency is its share of it."""
    strategy = strategies.get(name)
    absent = (strategy.needs and getattr(with_models, strategy.needs) is None) or (strategy.track == "warm" and source.vectors is None)
    error, began = None, time.perf_counter()
    hits = queries.sparkSession.createDataFrame([], "query_id string, rank int, path string, start_line int, end_line int")
    if not absent:
        try:
            hits = cut_lineage(strategies.retrieve(name, source, queries, max(cutoffs), with_models, call_budget).select("query_id", "rank", "path", "start_line", "end_line"))
        except Exception as e:  # noqa: BLE001  one strategy's failure is a result, not the end of the benchmark
            error = str(e)[:500]
    share = 1000 * (time.perf_counter() - began) / max(1, queries.count())
    rows = metrics.metrics_at(queries, hits, gold, cutoffs)
    return rows.withColumns({"strategy": F.lit(name), "track": F.lit(strategy.track), "skipped": F.lit(bool(absent)), "error": F.lit(error).cast("string"), "latency_ms": F.lit(round(share, 3)), "input_tokens": F.lit(0).cast("long"), "cost_usd": F.lit(0.0)})


def bench(spark: SparkSession, root: str, questions: str, names: list[str], cutoffs: list[int], out: str, with_models: strategies.Models = strategies.Models(), call_budget: int = 32) -> DataFrame:
    """Runs strategies over a question file. Result rows go to ``out``/results as JSON lines, one part for each
    strategy; after each the means so far are written anew to ``out``/summary. Returns the summary."""
    source = strategies.Corpus(bundle.load(spark, root))
    asked = fixtures.load_fixtures(spark, questions)
    problems = metrics.check_gold(asked, source.concepts.select("path", "n_lines"))
    if bad := problems.limit(5).collect():
        raise ValueError("; ".join(f"{r.query_id}: {r.problem}" for r in bad))
    queries = cut_lineage(asked.select(F.col("id").alias("query_id"), "query"))
    gold = cut_lineage(fixtures.load_gold(spark, questions))
    for i, name in enumerate(names):
        rows = run_strategy(name, source, queries, gold, cutoffs, with_models, call_budget)
        rows.coalesce(1).write.mode("append" if i else "overwrite").json(f"{out}/results")
        best = metrics.in_order(metrics.strategy_summary(results(spark, out).filter(F.col("k") == max(cutoffs))))
        best.coalesce(1).write.mode("overwrite").json(f"{out}/summary")
    return spark.read.json(f"{out}/summary")


def results(spark: SparkSession, out: str) -> DataFrame:
    """The result rows of a benchmark."""
    levels = ", ".join(f"{level}_{n} double" for level in ("span", "line", "file") for n in ("recall", "precision", "f1"))
    return spark.read.schema(f"query_id string, k int, {levels}, strategy string, track string, skipped boolean, error string, latency_ms double, input_tokens long, cost_usd double").json(f"{out}/results")


def analyze(spark: SparkSession, out: str, questions: str, threshold: float = 0.5) -> dict[str, DataFrame]:
    """Of a benchmark's rows: the summary in order, recall by cutoff, persistent and intermittent misses over
    cutoffs, and the questions below a threshold."""
    rows = results(spark, out)
    scored, top = rows.filter("not skipped and error is null"), rows.agg(F.max("k")).first()[0]
    return {
        "summary": metrics.in_order(metrics.strategy_summary(rows.filter(F.col("k") == top))).orderBy("place"),
        "recall": metrics.recall_by_cutoff(scored, fixtures.load_gold(spark, questions)).orderBy("strategy", "k"),
        "repeats": metrics.repeat_misses(scored).orderBy("strategy"),
        "misses": metrics.misses(scored.filter(F.col("k") == top), threshold).select("strategy", "query_id", "span_recall", "latency_ms"),
    }
