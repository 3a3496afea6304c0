"""Persisted retrieval documents, vectors and a content hash, with a freshness check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators.corpus import concepts, corpus_order, retrieval_docs

BODY_CHARS, EMBED_CHARS = 2000, 8000


def content_hash(tree: DataFrame) -> str:
    """One digest of all paths and texts, whatever their order: the 64 hexadecimal digits of each
    file's hash are summed in four parts, natively, and the sums and the count are hashed."""
    one = F.sha2(F.concat("path", F.lit("\0"), F.sha2("raw", 256)), 256)
    part = lambda i: F.sum(F.conv(F.substring(one, 1 + 16 * i, 15), 16, 10).cast("decimal(38,0)"))
    row = tree.filter("raw is not null").agg(F.count("*").alias("n"), *[part(i).alias(f"p{i}") for i in range(4)])
    return row.select(F.sha2(F.concat_ws(",", "n", *[F.coalesce(F.col(f"p{i}").cast("string"), F.lit("0")) for i in range(4)]), 256).alias("h")).first().h


def build(spark: SparkSession, tree: DataFrame, target: str, embed: Column | None = None, model: str | None = None, force: bool = False) -> bool:
    """Writes docs, vectors (with ``embed``, a column over text cut to EMBED_CHARS) and meta below
    ``target``, unless they are fresh. Whether it wrote."""
    now = content_hash(tree)
    if not force and is_fresh(spark, target, now):
        return False
    docs = retrieval_docs(concepts(tree.filter("kind = 'file' and raw is not null").select("path", "raw")), BODY_CHARS)
    docs = docs.withColumn("order", F.struct(corpus_order(F.col("path")), "sec_no"))
    docs.write.mode("overwrite").parquet(f"{target}/docs")
    if embed is not None:
        read_docs(spark, target).withColumn("text", F.substring("text", 1, EMBED_CHARS)).select("id", embed.alias("vector")).write.mode("overwrite").parquet(f"{target}/vectors")
    meta = spark.createDataFrame([(now, True, embed is not None, model)], "content_hash string, docs boolean, vectors boolean, model string")
    meta.coalesce(1).write.mode("overwrite").parquet(f"{target}/meta")
    return True


def is_fresh(spark: SparkSession, target: str, now: str) -> bool:
    meta = read_meta(spark, target)
    return meta is not None and meta.content_hash == now


def read_meta(spark: SparkSession, target: str):
    """The row of meta, or None."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(f"{target}/meta").first()
    except AnalysisException:
        return None


def read_docs(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(f"{target}/docs")


def read_vectors(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(f"{target}/vectors")
