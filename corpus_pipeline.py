"""The corpus pipeline: quality classifier, near-duplicate removal, repeated-passage removal, packing.

Every stage but the last returns the columns of documents; ``run`` writes each stage's rows to the
shared folder and reads them again, so a lost executor repeats one stage at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import Scratch, numbered
from gleaner.llm.near_dedup import near_duplicates
from gleaner.llm.packing import pack, token_pieces
from gleaner.llm.quality import classify
from gleaner.llm.suffix_dedup import WINDOW, cut_text, repeated_windows
from gleaner.llm.removal import finish

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def kept_whole(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """uid, text (null: empty), lang, source, row: the columns of docs stand in the struct row, so that no
    name of theirs can clash with one of ours."""
    given = lambda c: F.col(f"row.{c}").cast("string") if c in docs.columns else F.lit(None).cast("string")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = whole.select(F.col("row.doc_id").cast("long").alias("doc_id"), F.coalesce("row.text", F.lit("")).alias("text"), given("lang").alias("lang"), given("source").alias("source"), "row")
    return numbered(rows, scratch)[0].withColumnRenamed("_uid", "uid").drop("doc_id")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier keeps.

    A label counts for every row with its id; null or empty texts are scored like any other, very long
    ones whole; rows that repeat an id, or have none, are judged each on their own; an empty table
    gives no rows; other columns are carried along, whatever their names."""
    rows = kept_whole(docs, Scratch(spark, "stage-quality"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").cast("long").alias("labelled"), "quality")
    known = labels.join(rows.select(F.col("row.doc_id").cast("long").alias("labelled"), "uid"), "labelled").select(F.col("uid").alias("doc_id"), "quality")
    kept = classify(rows.select(F.col("uid").alias("doc_id"), "text", "lang", "source"), known, name="stage-quality").filter("keep").select(F.col("doc_id").alias("uid"))
    return rows.join(kept, "uid", "left_semi").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near duplicates (five-word shingles).

    Texts that are null or without words are alike to none; rows that repeat an id, or have none, are
    documents of their own (null ids first, equal ids in the order of their texts); very long texts
    are compared whole; an empty table gives no rows; other columns are carried along."""
    rows = kept_whole(docs, Scratch(spark, "stage-near"))
    kept = near_duplicates(rows.select(F.col("uid").alias("doc_id"), "text"), name="stage-near").filter("kept").select(F.col("doc_id").alias("uid"))
    return rows.join(kept, "uid", "left_semi").select("row.*")


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of repeated 100-byte strings; halves of characters at a cut go too.

    A null text becomes empty; equal texts of several rows stay in the first of them only (null ids
    first, equal ids in the order of their texts); very long texts are searched whole; an empty table
    gives no rows; n_chars, if there, is counted anew, other columns are carried along."""
    scratch = Scratch(spark, "stage-suffix")
    rows = kept_whole(docs, scratch).select("uid", "text", "row")
    gone = repeated_windows(rows.select("uid", "text"), scratch, WINDOW)
    cut = finish(rows, gone, cut_text(WINDOW), "kept string", ["uid", "row"]).withColumn("row", F.col("row").withField("text", F.col("kept")))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("row", F.col("row").withField("n_chars", F.char_length("kept").cast(docs.schema["n_chars"].dataType)))
    return cut.select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All texts, tokenised and packed into sequences of 2048 tokens.

    A null or empty text is a piece of its end token; ids may be null or repeated and are passed on;
    only texts of more than 2048 tokens are cut; an empty table gives no rows; other columns go."""
    return pack(token_pieces(docs, TOKENIZER), Scratch(spark, "stage-packing"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("packing", packing)]

#: Training, fuzzy matching and tokenisation have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return docs
