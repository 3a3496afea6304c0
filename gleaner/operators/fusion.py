"""Fusing rankings, choosing files, packing them into a bounded context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.text import DESCRIPTOR_CHARS, lines, numbered, tokens

RRF = 60


def unique_files(hits: DataFrame, k: int, chars: int = 2400) -> DataFrame:
    """query_id, rank, path, excerpt: the first hit of each path, the first k paths. hits: query_id, rank, path, text."""
    first = hits.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "path").orderBy("rank"))).filter("_n = 1")
    w = Window.partitionBy("query_id").orderBy("rank")
    return first.withColumn("new", F.row_number().over(w)).filter(F.col("new") <= k).select("query_id", F.col("new").alias("rank"), "path", F.substring("text", 1, chars).alias("excerpt"))


def rrf(rankings: DataFrame, constant: int = RRF) -> DataFrame:
    """query_id, rank, path, score: reciprocal rank fusion. rankings: query_id, source, rank, path."""
    fused = rankings.groupBy("query_id", "path").agg(F.sum(1.0 / (constant + F.col("rank"))).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "path")
    return fused.withColumn("rank", F.row_number().over(w))


def descriptors(pool: DataFrame, summaries: DataFrame, excerpts: DataFrame) -> DataFrame:
    """Adds what a scorer reads of each file: path, index summary (the path if none), lexical evidence."""
    joined = pool.join(summaries, "path", "left").join(excerpts, ["query_id", "path"], "left")
    text = F.concat(F.lit("Path: "), "path", F.lit("\nIndex summary: "), F.coalesce("summary", "path"), F.lit("\nLexical evidence:\n"), F.coalesce("excerpt", F.lit("(none)")))
    return joined.withColumn("descriptor", F.substring(text, 1, DESCRIPTOR_CHARS)).drop("summary", "excerpt")


def overlap(query: Column, text: Column) -> Column:
    """The share of distinct query tokens that stand in a text: a deterministic stand-in for a model."""
    q = F.array_distinct(tokens(query))
    return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(q, tokens(text))) / F.size(q))


def rerank(pool: DataFrame, scorer: Column, candidate_k: int, file_k: int) -> DataFrame:
    """Reranks the first candidate_k of each query by ``scorer`` (then fused score, then path), keeps file_k."""
    scored = pool.filter(F.col("rank") <= candidate_k).withColumn("rerank_score", scorer)
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("rerank_score", 9)), F.desc(F.round("score", 9)), "path")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= file_k)


def blocks(files: DataFrame) -> DataFrame:
    """Adds the numbered block of each file's text."""
    return files.withColumn("block", F.concat(F.lit("\n===== "), "path", F.lit(" =====\n"), numbered(lines(F.col("text")))))


def pack_context(files: DataFrame, max_chars: int) -> DataFrame:
    """query_id, rank, path, chars, included: greedy packing in rank order. The first block is always
    kept; a block that does not fit is left out, and later ones may still fit. A query's files are
    few (a cut ranking), so the fold runs over one small array for each query."""
    sized = blocks(files).select("query_id", "rank", "path", F.char_length("block").cast("long").alias("chars"))
    listed = sized.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "path", "chars"))).alias("f"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.expr("cast(array() as array<struct<rank:int,path:string,chars:bigint,included:boolean>>)").alias("out"))

    def step(acc, f):
        fits = (F.size(acc["out"]) == 0) | (acc["used"] + f["chars"] <= max_chars)
        row = F.struct(f["rank"].cast("int").alias("rank"), f["path"].alias("path"), f["chars"].alias("chars"), fits.alias("included"))
        return F.struct((acc["used"] + F.when(fits, f["chars"]).otherwise(F.lit(0).cast("long"))).alias("used"), F.array_append(acc["out"], row).alias("out"))

    packed = listed.select("query_id", F.explode(F.aggregate("f", start, step)["out"]).alias("r"))
    return packed.select("query_id", "r.rank", "r.path", "r.chars", "r.included")
