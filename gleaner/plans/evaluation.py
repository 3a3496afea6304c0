"""Queries of the evaluation: gold spans by containment, metrics, and their aggregates."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators import lexical, metrics
from gleaner.operators.agents import event_usage
from gleaner.shared import cut_lineage, shared_folder
from gleaner.shipping import ship

from .retrieval import _QTERMS, _UNITS, K, _bm25, _fts
from .tables import DOCUMENTS, documents, questions, read

CUTOFFS = [1, 2, 4, 8]


def gold(spark: SparkSession, sf: str) -> DataFrame:
    """query_id, path, start_line, end_line: where a question's text stands in a document."""
    return cut_lineage(lexical.occurrences(documents(spark, sf), questions(spark, sf), ("path",)))


def _hits(spark: SparkSession, sf: str, search, units: bool) -> DataFrame:
    """Ranked spans: units of ten lines for BM25, whole files for term frequency."""
    docs = documents(spark, sf)
    if not units:
        # a cut ranking has its own small size, so it is sent to the texts, which stay where they are
        found = docs.join(F.broadcast(cut_lineage(search(docs, questions(spark, sf), K))), "doc_ord")
        return cut_lineage(found.select("query_id", "rank", "path", F.lit(1).cast("long").alias("start_line"), (F.lit(1) + F.regexp_count("text", F.lit("\n"))).cast("long").alias("end_line")))
    found = search(docs, questions(spark, sf), K, lines=10)
    # a cut ranking is small and read by every metric, so it is worked out once
    return cut_lineage(found.join(docs.select("doc_ord", "path"), "doc_ord").select("query_id", "rank", "path", "start_line", (F.col("start_line") + 9).alias("end_line")))


def _bm25_hits(spark: SparkSession, sf: str) -> DataFrame:
    return _hits(spark, sf, lexical.bm25, True)


def _fts_hits(spark: SparkSession, sf: str) -> DataFrame:
    return _hits(spark, sf, lexical.fts, False)


def _side_by_side(spark: SparkSession, sf: str, *made: Callable[[SparkSession, str], DataFrame]) -> list[DataFrame]:
    """What each gives of the tables, worked out at once: where the last tasks of one leave cores idle, those of
    another run."""
    ship(spark)
    shared_folder(spark)
    with ThreadPoolExecutor(len(made)) as pool:
        return [job.result() for job in [pool.submit(inheritable_thread_target(spark)(f), spark, sf) for f in made]]


def gold_spans(spark: SparkSession, sf: str) -> DataFrame:
    return gold(spark, sf)


def span_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.span_metrics(questions(spark, sf), *_side_by_side(spark, sf, _bm25_hits, gold))


def line_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.line_metrics(questions(spark, sf), *_side_by_side(spark, sf, _bm25_hits, gold))


def file_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.file_metrics(questions(spark, sf), *_side_by_side(spark, sf, _bm25_hits, gold))


def metrics_at_cutoffs(spark: SparkSession, sf: str) -> DataFrame:
    out = metrics.metrics_at(questions(spark, sf), *_side_by_side(spark, sf, _bm25_hits, gold), CUTOFFS)
    return out.withColumn("k", F.col("k").cast("long"))


def _found(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ranked spans of both strategies and the gold, from one reading of the texts where the questions are few enough."""
    asked = questions(spark, sf)
    if asked.count() > lexical.CHUNK:
        return tuple(_side_by_side(spark, sf, _bm25_hits, _fts_hits, gold))
    units, files, places = lexical.search_all(documents(spark, sf), asked, K, 10)
    spans = lambda hits, start, end: cut_lineage(hits.filter("doc_ord is not null").select("query_id", "rank", "path", start.cast("long").alias("start_line"), end.cast("long").alias("end_line")))
    return spans(units, F.col("start_line"), F.col("start_line") + 9), spans(files, F.lit(1), F.col("end_line")), places


def _results(spark: SparkSession, sf: str, spans: DataFrame | None = None) -> DataFrame:
    """Scored rows of two strategies at each cutoff; some failed or skipped by a rule. spans: the gold, if it is there already."""
    bm25, fts, found = _found(spark, sf)
    spans = found if spans is None else spans
    out = None
    for name, hits in (("bm25", bm25), ("fts", fts)):
        rows = metrics.metrics_at(questions(spark, sf), hits, spans, CUTOFFS).withColumn("strategy", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    q = F.col("query_id")
    return out.withColumns({"skipped": q % 17 == 0, "error": F.when(q % 13 == 0, "failed"), "track": F.when(q % 2 == 0, "cold").otherwise("warm"), "latency_ms": (q * 7 % 50).cast("double"), "input_tokens": q * 3, "cost_usd": q * 0.001, "k": F.col("k").cast("long")})


def strategy_summary(spark: SparkSession, sf: str) -> DataFrame:
    out = metrics.strategy_summary(_results(spark, sf).filter(F.col("k") == K))
    return out.select("strategy", "n", *[F.round(c, 6).alias(c) for c in ("span_recall", "file_recall", "span_f1", "latency_ms", "input_tokens", "cost_usd")], "track", "n_skipped", "n_errors")


def recall_by_cutoff_split(spark: SparkSession, sf: str) -> DataFrame:
    spans = gold(spark, sf)
    out = metrics.recall_by_cutoff(_results(spark, sf, spans), spans)
    return out.select("strategy", "k", *[F.round(c, 6).alias(c) for c in ("span_recall", "file_recall", "single", "multi")])


def repeat_misses(spark: SparkSession, sf: str) -> DataFrame:
    """The cutoffs stand for repeats."""
    return metrics.repeat_misses(_results(spark, sf))


def misses(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.misses(_results(spark, sf).filter(F.col("k") == K), 0.5).select("strategy", "query_id", "span_recall", "latency_ms")


def agent_usage(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of conversations as an agent's event stream: JSON lines are made of them and parsed back."""
    rows = read(spark, sf, "conversations")
    size = F.char_length("text").cast("long")
    message = F.struct(F.col("role").alias("role"), F.struct(size.alias("input"), (size % 5).alias("cacheRead"), (size % 7).alias("output"), (size % 3).alias("totalTokens"), F.struct((size * 0.5).alias("total")).alias("cost")).alias("usage"))
    kind = F.when(F.col("turn") % 3 == 1, "tool_execution_start").otherwise("message_end")
    line = F.to_json(F.struct(kind.alias("type"), message.alias("message")))
    return event_usage(rows.select(F.col("conv_id").alias("run_id"), F.when(F.col("turn") % 4 == 3, "{broken").otherwise(line).alias("line")))


QUERIES = {f.__name__: f for f in (gold_spans, span_metrics, line_metrics, file_metrics, metrics_at_cutoffs, strategy_summary, recall_by_cutoff_split, repeat_misses, misses, agent_usage)}

_GOLD = "gold AS (SELECT query_id, path, 1 + length(p) - length(replace(p, chr(10), '')) AS start_line, 1 + length(p) - length(replace(p, chr(10), '')) + length(query) - length(replace(query, chr(10), '')) AS end_line FROM (SELECT query_id, path, query, substring(text, 1, instr(text, query) - 1) AS p FROM docs, questions WHERE query <> '' AND contains(text, query)))"
_BM25_HITS = "SELECT query_id, rank, path, start_line, start_line + 9 AS end_line FROM bm25 JOIN docs USING (doc_ord)"
_BASE = f"WITH {DOCUMENTS}, {_QTERMS}, {_UNITS}, {_bm25('units', K)}, {_GOLD}"
_ONE = f"{_BASE}, hits AS (SELECT 'x' AS strategy, *, 1 AS k FROM ({_BM25_HITS})), qk AS (SELECT 'x' AS strategy, query_id, 1 AS k FROM questions), gk AS (SELECT *, 1 AS k FROM gold)"
_KS = f"""{_BASE}, {_fts(K)}, ks AS (SELECT CAST(unnest({CUTOFFS}) AS BIGINT) AS k),
all_hits AS (SELECT 'bm25' AS strategy, * FROM ({_BM25_HITS}) UNION ALL SELECT 'fts', query_id, rank, path, 1, 1 + length(text) - length(replace(text, chr(10), '')) FROM fts JOIN docs USING (doc_ord)),
hits AS (SELECT h.*, k FROM all_hits h, ks WHERE rank <= k), qk AS (SELECT s AS strategy, query_id, k FROM questions, ks, (SELECT unnest(['bm25', 'fts']) AS s)), gk AS (SELECT gold.*, k FROM gold, ks)"""


def _rates(name: str, found: str, n_gold: str, right: str, n_hits: str) -> str:
    rate = lambda a, b: f"CASE WHEN {n_gold} = 0 AND {n_hits} = 0 THEN 1.0 WHEN {n_gold} = 0 OR {n_hits} = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) / {b} END"
    return f"CAST({rate(found, n_gold)} AS DOUBLE) AS {name}_recall, CAST({rate(right, n_hits)} AS DOUBLE) AS {name}_precision"


def _f1(name: str, source: str, keys: str = "strategy, query_id, k") -> str:
    return f"SELECT {keys}, {name}_recall, {name}_precision, CASE WHEN {name}_recall + {name}_precision = 0 THEN 0.0 ELSE 2 * {name}_recall * {name}_precision / ({name}_recall + {name}_precision) END AS {name}_f1 FROM {source}"


_SPAN = f"""span_n AS (SELECT strategy, query_id, k, (SELECT count(*) FROM gk g WHERE g.query_id = q.query_id AND g.k = q.k) AS ng, (SELECT count(*) FROM hits h WHERE h.strategy = q.strategy AND h.query_id = q.query_id AND h.k = q.k) AS nh,
  (SELECT count(*) FROM gk g WHERE g.query_id = q.query_id AND g.k = q.k AND EXISTS (SELECT 1 FROM hits h WHERE h.strategy = q.strategy AND h.query_id = g.query_id AND h.k = g.k AND h.path = g.path AND h.start_line <= g.end_line AND g.start_line <= h.end_line)) AS fg,
  (SELECT count(*) FROM hits h WHERE h.strategy = q.strategy AND h.query_id = q.query_id AND h.k = q.k AND EXISTS (SELECT 1 FROM gk g WHERE h.query_id = g.query_id AND h.k = g.k AND h.path = g.path AND h.start_line <= g.end_line AND g.start_line <= h.end_line)) AS rh FROM qk q),
span_r AS (SELECT strategy, query_id, k, {_rates('span', 'fg', 'ng', 'rh', 'nh')} FROM span_n), span AS ({_f1('span', 'span_r')})"""


def _sets(name: str, hits: str, gold_: str, on: str) -> str:
    return f"""{name}_h AS ({hits}), {name}_g AS ({gold_}),
{name}_n AS (SELECT strategy, query_id, k, (SELECT count(*) FROM {name}_g g WHERE g.query_id = q.query_id AND g.k = q.k) AS ng, (SELECT count(*) FROM {name}_h h WHERE h.strategy = q.strategy AND h.query_id = q.query_id AND h.k = q.k) AS nh,
  (SELECT count(*) FROM {name}_h h JOIN {name}_g g ON h.query_id = g.query_id AND h.k = g.k AND {on} WHERE h.strategy = q.strategy AND h.query_id = q.query_id AND h.k = q.k) AS c FROM qk q),
{name}_r AS (SELECT strategy, query_id, k, {_rates(name, 'c', 'ng', 'c', 'nh')} FROM {name}_n), {name} AS ({_f1(name, name + '_r')})"""


_LINE = _sets("line", "SELECT DISTINCT strategy, query_id, k, path, unnest(range(start_line, end_line + 1)) AS line FROM hits", "SELECT DISTINCT query_id, k, path, unnest(range(start_line, end_line + 1)) AS line FROM gk", "h.path = g.path AND h.line = g.line")
_FILE = _sets("file", "SELECT DISTINCT strategy, query_id, k, path FROM hits", "SELECT DISTINCT query_id, k, path FROM gk", "h.path = g.path")
_RESULTS = f"""{_KS}, {_SPAN}, {_FILE},
results AS (SELECT strategy, query_id, k, span_recall, span_f1, file_recall, query_id % 17 = 0 AS skipped, CASE WHEN query_id % 13 = 0 THEN 'failed' END AS error, CASE WHEN query_id % 2 = 0 THEN 'cold' ELSE 'warm' END AS track,
  CAST(query_id * 7 % 50 AS DOUBLE) AS latency_ms, query_id * 3 AS input_tokens, query_id * 0.001 AS cost_usd FROM span JOIN file USING (strategy, query_id, k))"""
_MEAN = lambda c: f"round(coalesce(avg(CASE WHEN ok THEN CAST({c} AS DOUBLE) END), 0), 6) AS {c}"

ORACLE_SQL = {
    "gold_spans": f"WITH {DOCUMENTS}, {_QTERMS}, {_GOLD} SELECT * FROM gold",
    "span_metrics": f"{_ONE}, {_SPAN} SELECT query_id, span_recall, span_precision, span_f1 FROM span",
    "line_metrics": f"{_ONE}, {_LINE} SELECT query_id, line_recall, line_precision, line_f1 FROM line",
    "file_metrics": f"{_ONE}, {_FILE} SELECT query_id, file_recall, file_precision, file_f1 FROM file",
    "metrics_at_cutoffs": f"{_KS}, {_SPAN}, {_LINE}, {_FILE} SELECT * EXCLUDE (strategy) FROM span JOIN line USING (strategy, query_id, k) JOIN file USING (strategy, query_id, k) WHERE strategy = 'bm25'",
    "strategy_summary": f"""{_RESULTS}, r AS (SELECT *, NOT skipped AND error IS NULL AS ok FROM results WHERE k = {K})
SELECT strategy, count(*) FILTER (WHERE ok) AS n, {', '.join(_MEAN(c) for c in ('span_recall', 'file_recall', 'span_f1', 'latency_ms', 'input_tokens', 'cost_usd'))}, string_agg(DISTINCT track, ',' ORDER BY track) FILTER (WHERE ok) AS track,
  count(*) FILTER (WHERE skipped) AS n_skipped, count(*) FILTER (WHERE NOT skipped AND error IS NOT NULL) AS n_errors FROM r GROUP BY strategy""",
    "recall_by_cutoff_split": f"""{_RESULTS}, nf AS (SELECT query_id, count(DISTINCT path) AS f FROM gold GROUP BY 1)
SELECT strategy, k, round(avg(span_recall), 6) AS span_recall, round(avg(file_recall), 6) AS file_recall, round(coalesce(avg(span_recall) FILTER (WHERE f = 1), 0), 6) AS single, round(coalesce(avg(span_recall) FILTER (WHERE f > 1), 0), 6) AS multi FROM results LEFT JOIN nf USING (query_id) GROUP BY strategy, k""",
    "repeat_misses": f"""{_RESULTS} SELECT strategy, count(*) FILTER (WHERE a) AS persistent, count(*) FILTER (WHERE b) AS intermittent FROM (SELECT strategy, query_id, bool_and(span_recall < 1) AS a, bool_or(span_recall < 1) AND bool_or(span_recall = 1) AS b FROM results GROUP BY 1, 2) GROUP BY strategy""",
    "misses": f"{_RESULTS} SELECT strategy, query_id, span_recall, latency_ms FROM results WHERE k = {K} AND span_recall < 0.5",
    "agent_usage": """WITH e AS (SELECT conv_id AS run_id, turn % 3 = 1 AS tool, role, length(text) AS n FROM conversations WHERE turn % 4 <> 3), ids AS (SELECT DISTINCT conv_id AS run_id FROM conversations),
m AS (SELECT *, NOT tool AND role = 'assistant' AS said FROM e)
SELECT ids.run_id, count(*) FILTER (WHERE said AND n % 3 > 0) AS calls, CAST(coalesce(sum(n + n % 5) FILTER (WHERE said), 0) AS BIGINT) AS input, CAST(coalesce(sum(n % 7) FILTER (WHERE said), 0) AS BIGINT) AS output, round(coalesce(sum(n * 0.5) FILTER (WHERE said), 0)::DOUBLE, 6) AS cost, count(*) FILTER (WHERE tool) AS tools
FROM ids LEFT JOIN m USING (run_id) GROUP BY ids.run_id""",
}
