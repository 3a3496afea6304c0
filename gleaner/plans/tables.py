"""The engine's inputs derived from the synthetic tables: a three-level tree of text files, questions,
gold spans, Markdown made from web pages. Each has a SQL twin with the same columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """doc_ord, path, text."""
    return read(spark, sf, "documents").select(F.col("doc_id").alias("doc_ord"), F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), "text")


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """query_id, query."""
    return read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def markdown(spark: SparkSession, sf: str) -> DataFrame:
    """page_id, path, text: pages with their headings, paragraphs and links as Markdown."""
    text = F.col("html")
    for pattern, to in (("<h1>", "\n# "), ("</?(?:p|ul|li|article|div|nav)[^>]*>", "\n"), ('<a href="([^"]*)">([^<]*)</a>', "[$2]($1)"), ("<[^>]*>", "")):
        text = F.regexp_replace(text, pattern, to)
    return read(spark, sf, "pages").select("page_id", F.format_string("site%d/%d.md", F.col("page_id") % 7, F.col("page_id")).alias("path"), text.alias("text"))


DOCUMENTS = "docs AS (SELECT doc_id AS doc_ord, concat_ws('/', source, lang, concat(CAST(doc_id AS VARCHAR), '.txt')) AS path, text FROM documents)"
QUESTIONS = "questions AS (SELECT item_id AS query_id, text AS query FROM benchmark)"
MARKDOWN = """md AS (SELECT page_id, 'site' || CAST(page_id % 7 AS VARCHAR) || '/' || CAST(page_id AS VARCHAR) || '.md' AS path,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<h1>', chr(10) || '# ', 'g'), '</?(?:p|ul|li|article|div|nav)[^>]*>', chr(10), 'g'),
    '<a href="([^"]*)">([^<]*)</a>', '[\\2](\\1)', 'g'), '<[^>]*>', '', 'g') AS text FROM pages)"""
TOKENS = "regexp_extract_all(lower({0}), '[a-z0-9_]+')"
LINES = "regexp_extract_all({0}, '[^\\n]*\\n|[^\\n]+')"
