"""Question files: JSON lines with blank lines and # comments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "id string, query string, gold array<struct<path:string, start_line:int, end_line:int, text:string>>, kind string, notes string"


def load_fixtures(spark: SparkSession, path: str) -> DataFrame:
    """id, query, gold, kind, notes."""
    lines = spark.read.text(path).select(F.trim("value").alias("line")).filter("line <> '' and not startswith(line, '#')")
    return lines.select(F.from_json("line", SCHEMA).alias("r")).select("r.*")


def load_gold(spark: SparkSession, path: str) -> DataFrame:
    """query_id, path, start_line, end_line; a question without an id goes by its first 40 characters."""
    rows = load_fixtures(spark, path).select(F.coalesce("id", F.substring("query", 1, 40)).alias("query_id"), F.explode("gold").alias("g"))
    return rows.select("query_id", "g.path", "g.start_line", "g.end_line")
