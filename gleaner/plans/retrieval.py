"""Queries of lexical, vector and fused retrieval, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.operators import fusion, lexical, vector
from gleaner.operators.corpus import chunk_array

from .tables import DOCUMENTS, LINES, QUESTIONS, TOKENS, documents, questions, read

K = 8


def tokenize_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = documents(spark, sf).select("doc_ord", F.explode(T.tokens(F.col("text"))).alias("term"))
    return rows.groupBy("doc_ord", "term").agg(F.count("*").alias("tf"))


def _ranked(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", F.col("rank").cast("long").alias("rank"), "doc_ord", F.round("score", 6).alias("score"))


def _ranked_units(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", F.col("rank").cast("long").alias("rank"), "doc_ord", "start_line", F.round("score", 6).alias("score"))


def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(lexical.bm25(documents(spark, sf), questions(spark, sf), K))


def _units(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_ord", F.explode(chunk_array(F.col("text"), 10)).alias("c"))
    return rows.select("doc_ord", F.col("c.start_line").cast("long").alias("start_line"), F.col("c.text").alias("text"))


UNIT = ("doc_ord", "start_line")


def bm25_topk_section_units(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked_units(lexical.bm25(_units(documents(spark, sf)), questions(spark, sf), K, key=UNIT))


def fts_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(lexical.fts(documents(spark, sf), questions(spark, sf), K))


def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    vectors = read(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_ord"), F.col("embedding").alias("v"))
    asked = vectors.filter("doc_ord % 20 = 0").select(F.col("doc_ord").alias("query_id"), F.col("v").alias("q"))
    return _ranked(vector.vector_search(vectors, asked, K))


def _hits(spark: SparkSession, sf: str, search) -> DataFrame:
    docs = documents(spark, sf)
    found = search(docs, questions(spark, sf), 4 * K)
    return found.join(docs, "doc_ord").select("query_id", "rank", "path", F.substring("text", 1, T.EXCERPT_CHARS).alias("text"))


def unique_files(spark: SparkSession, sf: str) -> DataFrame:
    """The best units' files: several units of a file give one row."""
    docs = documents(spark, sf)
    best = lexical.bm25(_units(docs), questions(spark, sf), 4 * K, key=UNIT)
    # only documents with a hit are split again
    found = docs.join(best.select("doc_ord").distinct(), "doc_ord", "left_semi")
    hits = best.join(_units(found), list(UNIT)).join(found.select("doc_ord", "path"), "doc_ord")
    return fusion.unique_files(hits.select("query_id", "rank", "path", "text"), K).select("query_id", F.col("rank").cast("long").alias("rank"), "path", F.md5("excerpt").alias("excerpt_md5"))


def _rankings(spark: SparkSession, sf: str) -> DataFrame:
    b = fusion.unique_files(_hits(spark, sf, lexical.bm25), K).withColumn("source", F.lit("bm25"))
    f = fusion.unique_files(_hits(spark, sf, lexical.fts), K).withColumn("source", F.lit("fts"))
    return b.unionByName(f)


def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    fused = fusion.rrf(_rankings(spark, sf))
    return fused.select("query_id", F.col("rank").cast("long").alias("rank"), "path", F.round("score", 9).alias("score"))


def _reranked(spark: SparkSession, sf: str) -> DataFrame:
    rankings = _rankings(spark, sf)
    excerpts = rankings.groupBy("query_id", "path").agg(F.max_by("excerpt", "source").alias("excerpt"))  # fts overwrites bm25
    none = spark.createDataFrame([], "path string, summary string")
    pool = fusion.descriptors(fusion.rrf(rankings).filter(F.col("rank") <= 2 * K), none, excerpts).join(questions(spark, sf), "query_id")
    return fusion.rerank(pool, fusion.overlap(F.col("query"), F.col("descriptor")), 2 * K, 6)


def pool_and_rerank_lexical(spark: SparkSession, sf: str) -> DataFrame:
    return _reranked(spark, sf).select("query_id", F.col("rank").cast("long").alias("rank"), "path", F.round("rerank_score", 9).alias("rerank_score"), F.round("score", 9).alias("score"))


def pack_context_greedy(spark: SparkSession, sf: str) -> DataFrame:
    files = _reranked(spark, sf).select("query_id", "rank", "path").join(documents(spark, sf).select("path", "text"), "path")
    packed = fusion.pack_context(files, 6000)
    return packed.select("query_id", F.col("rank").cast("long").alias("rank"), "path", "chars", "included")


def line_numbered_context(spark: SparkSession, sf: str) -> DataFrame:
    block = fusion.blocks(documents(spark, sf))
    return block.select("doc_ord", F.char_length("block").cast("long").alias("chars"), F.md5("block").alias("block_md5"))


def section_preview(spark: SparkSession, sf: str) -> DataFrame:
    found = _hits(spark, sf, lexical.fts).filter("rank <= 3").select("query_id", "rank", "path")
    rows = found.join(documents(spark, sf).select("path", "text"), "path").join(questions(spark, sf), "query_id")
    shown = T.preview(F.col("text"), F.col("query"))
    return rows.select("query_id", F.col("rank").cast("long").alias("rank"), "path", F.char_length(shown).cast("long").alias("chars"), F.md5(shown).alias("preview_md5"))


QUERIES = {f.__name__: f for f in (tokenize_counts, bm25_topk, bm25_topk_section_units, fts_topk, vector_topk, unique_files, rrf_fusion, pool_and_rerank_lexical, pack_context_greedy, line_numbered_context, section_preview)}

_QTERMS = f"{QUESTIONS}, qterms AS (SELECT query_id, term, count(*) AS qn FROM (SELECT query_id, unnest({TOKENS.format('query')}) AS term FROM questions) GROUP BY ALL)"
_UNITS = f"""units AS (SELECT doc_ord, s * 10 + 1 AS start_line, path, array_to_string(l[s * 10 + 1 : s * 10 + 10], '') AS text
  FROM (SELECT doc_ord, path, l, unnest(range(0, (len(l) + 9) // 10)) AS s FROM (SELECT doc_ord, path, {LINES.format('text')} AS l FROM docs)))"""


def _bm25(docs: str, k: int, name: str = "bm25") -> str:
    key = "doc_ord, start_line" if docs == "units" else "doc_ord"
    return f"""{name}_tok AS (SELECT {key}, {TOKENS.format('text')} AS t FROM {docs}),
{name}_n AS (SELECT count(*) AS n, avg(len(t)) AS m FROM {name}_tok),
{name}_post AS (SELECT {key}, any_value(len) AS len, term, count(*) AS tf FROM (SELECT {key}, len(t) AS len, unnest(t) AS term FROM {name}_tok) GROUP BY {key}, term),
{name}_df AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT term, count(*) AS df FROM {name}_post GROUP BY term), {name}_n),
{name}_idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM {name}_df) ELSE raw END AS idf FROM {name}_df),
{name}_s AS (SELECT query_id, {key}, sum(qn * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / m))) AS score
  FROM {name}_post JOIN qterms USING (term) JOIN {name}_idf USING (term), {name}_n GROUP BY ALL HAVING sum(qn * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / m))) > 0),
{name} AS (SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, {key}) AS rank, {key}, round(score, 6) AS score FROM {name}_s) WHERE rank <= {k})"""


def _fts(k: int) -> str:
    return f"""fts_s AS (SELECT query_id, doc_ord, CAST(sum(s) AS DOUBLE) AS score FROM (
    SELECT query_id, doc_ord, qn * tf AS s FROM (SELECT doc_ord, term, count(*) AS tf FROM (SELECT doc_ord, unnest({TOKENS.format('text')}) AS term FROM docs) GROUP BY ALL) JOIN qterms USING (term)
    UNION ALL SELECT query_id, doc_ord, 2 * qn FROM (SELECT doc_ord, unnest(list_distinct({TOKENS.format('path')})) AS term FROM docs) JOIN qterms USING (term)) GROUP BY ALL),
fts AS (SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_ord) AS rank, doc_ord, round(score, 6) AS score FROM fts_s) WHERE rank <= {k})"""


_RANKINGS = f"""{DOCUMENTS}, {_QTERMS}, {_bm25('docs', 4 * K)}, {_fts(4 * K)},
rankings AS (SELECT query_id, source, rank, path, substring(text, 1, 2400) AS excerpt FROM (SELECT *, 'bm25' AS source FROM bm25 UNION ALL SELECT *, 'fts' FROM fts) JOIN docs USING (doc_ord) WHERE rank <= {K}),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, path) AS rank FROM (SELECT query_id, path, sum(1.0 / (60 + rank)) AS score, arg_max(excerpt, source) AS excerpt FROM rankings GROUP BY ALL))"""
_RERANKED = f"""{_RANKINGS},
scored AS (SELECT fused.*, query, len(list_intersect(list_distinct({TOKENS.format('query')}), {TOKENS.format("substring('Path: ' || path || chr(10) || 'Index summary: ' || path || chr(10) || 'Lexical evidence:' || chr(10) || excerpt, 1, 3200)")}))
  / len(list_distinct({TOKENS.format('query')})) AS rerank_score FROM fused JOIN questions USING (query_id) WHERE rank <= {2 * K}),
reranked AS (SELECT * FROM (SELECT query_id, path, score, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY round(rerank_score, 9) DESC, round(score, 9) DESC, path) AS rank FROM scored) WHERE rank <= 6)"""
_NUMBERED = "array_to_string([lpad(CAST(i AS VARCHAR), 5, '0') || ': ' || l[i] for i in range(1, len(l) + 1)], '')"
_BLOCK = f"chr(10) || '===== ' || path || ' =====' || chr(10) || {_NUMBERED}"

ORACLE_SQL = {
    "tokenize_counts": f"WITH {DOCUMENTS} SELECT doc_ord, term, count(*) AS tf FROM (SELECT doc_ord, unnest({TOKENS.format('text')}) AS term FROM docs) GROUP BY ALL",
    "bm25_topk": f"WITH {DOCUMENTS}, {_QTERMS}, {_bm25('docs', K)} SELECT * FROM bm25",
    "bm25_topk_section_units": f"WITH {DOCUMENTS}, {_QTERMS}, {_UNITS}, {_bm25('units', K)} SELECT * FROM bm25",
    "fts_topk": f"WITH {DOCUMENTS}, {_QTERMS}, {_fts(K)} SELECT * FROM fts",
    "vector_topk": f"""SELECT * FROM (SELECT q.vec_id AS query_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) DESC, v.vec_id) AS rank,
  v.vec_id AS doc_ord, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings v, embeddings q WHERE q.vec_id % 20 = 0) WHERE rank <= {K}""",
    "unique_files": f"""WITH {DOCUMENTS}, {_QTERMS}, {_UNITS}, {_bm25('units', 4 * K)},
hits AS (SELECT query_id, rank, path, text, row_number() OVER (PARTITION BY query_id, path ORDER BY rank) AS n FROM bm25 JOIN units USING (doc_ord, start_line)),
firsts AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank, path, text FROM hits WHERE n = 1)
SELECT query_id, rank, path, md5(substring(text, 1, 2400)) AS excerpt_md5 FROM firsts WHERE rank <= {K}""",
    "rrf_fusion": f"WITH {_RANKINGS} SELECT query_id, rank, path, round(score, 9) AS score FROM fused",
    "pool_and_rerank_lexical": f"WITH {_RERANKED} SELECT query_id, rank, path, round(rerank_score, 9) AS rerank_score, round(score, 9) AS score FROM reranked",
    "pack_context_greedy": f"""WITH RECURSIVE {_RERANKED},
sized AS (SELECT query_id, rank, path, length({_BLOCK}) AS chars FROM (SELECT query_id, rank, path, {LINES.format('text')} AS l FROM reranked JOIN docs USING (path))),
packed AS (SELECT query_id, rank, path, chars, true AS included, chars AS used FROM sized WHERE rank = 1
  UNION ALL SELECT s.query_id, s.rank, s.path, s.chars, p.used + s.chars <= 6000, p.used + CASE WHEN p.used + s.chars <= 6000 THEN s.chars ELSE 0 END FROM packed p JOIN sized s ON s.query_id = p.query_id AND s.rank = p.rank + 1)
SELECT query_id, rank, path, chars, included FROM packed""",
    "line_numbered_context": f"WITH {DOCUMENTS} SELECT doc_ord, length(b) AS chars, md5(b) AS block_md5 FROM (SELECT doc_ord, {_BLOCK} AS b FROM (SELECT doc_ord, path, {LINES.format('text')} AS l FROM docs))",
    "section_preview": f"""WITH {DOCUMENTS}, {_QTERMS}, {_fts(3)},
shown AS (SELECT query_id, rank, path, text, [x.s for x in list_filter([{{'s': 'L' || CAST(i AS VARCHAR) || ': ' || string_split(text, chr(10))[i], 'l': lower(string_split(text, chr(10))[i])}} for i in range(1, len(string_split(text, chr(10))) + 1)],
    lambda x: len(list_filter(list_distinct(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}_-]{{3,}}')), lambda t: t NOT IN ('the', 'and', 'for', 'what', 'where', 'how', 'does') AND contains(x.l, t))) > 0)] AS m
  FROM fts JOIN docs USING (doc_ord) JOIN questions USING (query_id)),
out AS (SELECT query_id, rank, path, CASE WHEN length(text) <= 2400 THEN text WHEN len(m) = 0 THEN substring(text, 1, 2400)
  ELSE substring(substring(text, 1, 400) || chr(10) || '...' || chr(10) || array_to_string(m, chr(10)), 1, 2400) END AS p FROM shown)
SELECT query_id, rank, path, length(p) AS chars, md5(p) AS preview_md5 FROM out""",
}
