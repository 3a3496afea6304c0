"""Walk queries over the tree of documents, with a scorer that both engines can compute."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators import corpus, walk

from .corpus import _EDGES
from .tables import DOCUMENTS, QUESTIONS, documents, questions

CFG = walk.WalkConfig(top_k=4, call_budget=9, min_probability=0.6, relative_probability=0.8, return_files=True)
OPEN = 0.8


def _score(rows: DataFrame) -> DataFrame:
    """A number from 0 to 1 out of the question's id and the child's path."""
    return rows.withColumn("score", F.conv(F.substring(F.md5(F.concat(F.col("query_id").cast("string"), F.lit(":"), "child")), 1, 4), 16, 10).cast("double") / 65536)


def _decision(spark: SparkSession, sf: str):
    edges = corpus.edges(documents(spark, sf))
    return walk.tree_decision(edges, lambda pairs: pairs.withColumn("option", F.col("child")), None, questions(spark, sf), _score, CFG)


def tree_decision_walk(spark: SparkSession, sf: str) -> DataFrame:
    spans, _ = _decision(spark, sf)
    return spans.select("query_id", F.col("rank").cast("long").alias("rank"), "path")


def tree_decision_stats(spark: SparkSession, sf: str) -> DataFrame:
    _, stats = _decision(spark, sf)
    return stats.select("query_id", F.col("calls").cast("long").alias("calls"), "visited", "truncated")


def _reason(spark: SparkSession, sf: str):
    edges = corpus.edges(documents(spark, sf))
    gate = lambda pairs: _score(pairs).withColumn("opens", F.col("score") >= OPEN)
    pick = lambda files: files.filter(F.md5(F.concat(F.col("query_id").cast("string"), F.lit("."), "path")) >= "4").select("query_id", "path", F.lit(0).alias("sec_no"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"))
    return walk.tree_reason(edges, gate, pick, questions(spark, sf), walk.WalkConfig(top_k=5, call_budget=25))


def tree_reason_walk(spark: SparkSession, sf: str) -> DataFrame:
    spans, _ = _reason(spark, sf)
    return spans.select("query_id", F.col("rank").cast("long").alias("rank"), "path")


def tree_reason_stats(spark: SparkSession, sf: str) -> DataFrame:
    _, stats = _reason(spark, sf)
    return stats.select("query_id", "calls", "truncated")


QUERIES = {f.__name__: f for f in (tree_decision_walk, tree_decision_stats, tree_reason_walk, tree_reason_stats)}

_SCORED = "score AS (SELECT query_id, e.*, CAST(CAST('0x' || substring(md5(CAST(query_id AS VARCHAR) || ':' || child), 1, 4) AS INTEGER) AS DOUBLE) / 65536 AS score, count(*) OVER (PARTITION BY query_id, parent) AS n FROM questions, edges e)"


def _decision_sql() -> str:
    return f"""WITH RECURSIVE {DOCUMENTS}, {QUESTIONS}, {_EDGES.format('docs')}, {_SCORED},
passed AS (SELECT *, row_number() OVER (PARTITION BY query_id, parent ORDER BY round(score, 9) DESC, ord DESC) AS r FROM (SELECT *, max(score) OVER (PARTITION BY query_id, parent) AS best FROM score) WHERE n = 1 OR score >= greatest({CFG.min_probability}, best * {CFG.relative_probability})),
reach AS (SELECT query_id, '' AS path, 'dir' AS kind, CAST([] AS BIGINT[]) AS key FROM questions UNION ALL SELECT p.query_id, p.child, p.kind, list_append(w.key, p.r) FROM reach w JOIN passed p ON p.query_id = w.query_id AND p.parent = w.path WHERE w.kind = 'dir'),
kids AS (SELECT parent AS path, count(*) AS c FROM edges GROUP BY 1),
nodes AS (SELECT query_id, path, key, CASE WHEN kind = 'dir' AND c > 1 THEN CAST(ceil(c / 254.0) AS BIGINT) ELSE 0 END AS calls, CASE WHEN kind = 'file' THEN 1 ELSE 0 END AS emits FROM reach LEFT JOIN kids USING (path)),
sums AS (SELECT *, coalesce(sum(emits) OVER b, 0) AS sb, coalesce(sum(calls) OVER b, 0) AS cb FROM nodes WINDOW b AS (PARTITION BY query_id ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
marks AS (SELECT *, sb >= {CFG.top_k} AS enough, cb >= {CFG.call_budget} OR calls > {CFG.call_budget} - cb AS spent FROM sums),
cuts AS (SELECT *, max(CASE WHEN enough OR spent THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY key) AS stops, coalesce(max(CASE WHEN enough OR spent THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS was FROM marks)"""


_REASON = f"""WITH {DOCUMENTS}, {QUESTIONS}, {_EDGES.format('docs')}, {_SCORED}, open AS (SELECT * FROM score WHERE score >= {OPEN}),
a AS (SELECT query_id, child AS path, 1 + row_number() OVER (PARTITION BY query_id ORDER BY ord) AS pos FROM open WHERE parent = ''),
queued AS (SELECT query_id, 1 + (SELECT count(*) FROM a x WHERE x.query_id = q.query_id) AS total FROM questions q),
b AS (SELECT query_id, child AS path, total + row_number() OVER (PARTITION BY query_id ORDER BY a.pos, ord) AS pos FROM a JOIN open o USING (query_id) JOIN queued USING (query_id) WHERE o.parent = a.path AND a.pos <= 25),
bt AS (SELECT query_id, total + (SELECT count(*) FROM b x WHERE x.query_id = queued.query_id) AS total FROM queued),
c AS (SELECT query_id, child AS path, total + row_number() OVER (PARTITION BY query_id ORDER BY b.pos, ord) AS pos FROM b JOIN open o USING (query_id) JOIN bt USING (query_id) WHERE o.parent = b.path AND b.pos <= 25),
tasks AS (SELECT query_id, 1 AS pos FROM questions UNION ALL SELECT query_id, pos FROM a UNION ALL SELECT query_id, pos FROM b UNION ALL SELECT query_id, pos FROM c)"""

ORACLE_SQL = {
    "tree_decision_walk": f"{_decision_sql()} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY key) AS rank, path FROM cuts WHERE stops = 0 AND emits = 1",
    "tree_decision_stats": f"{_decision_sql()} SELECT query_id, CAST(sum(CASE WHEN stops = 0 THEN calls ELSE 0 END) AS BIGINT) AS calls, count(*) FILTER (WHERE stops = 0) AS visited, bool_or(NOT enough AND spent AND was = 0) AS truncated FROM cuts GROUP BY query_id",
    "tree_reason_walk": f"{_REASON} SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS rank, path FROM c WHERE pos <= 25 AND md5(CAST(query_id AS VARCHAR) || '.' || path) >= '4') WHERE rank <= 5",
    "tree_reason_stats": f"{_REASON} SELECT query_id, count(*) FILTER (WHERE pos <= 25) AS calls, max(pos) > 25 AS truncated FROM tasks GROUP BY query_id",
}
