"""Texts are split once for a row."""

import random

from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.operators import corpus, routing

LINE_PATTERN = f"[^{T.BREAK}]*(?:\\r\\n|[{T.BREAK}])|[^{T.BREAK}]+"


def splits(df) -> int:
    """How often a plan works out the lines of a text."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(")


def odd_texts(spark):
    rnd = random.Random(1)
    made = ["".join(rnd.choice("ab\n\n" if i % 2 else "aé\n\n\r\x0b\x0c\x1c\x1d\x1e\x85  ") for _ in range(rnd.randrange(12))) for i in range(1500)]
    return spark.createDataFrame([(t,) for t in [None, "", "\n", "\n\n", "a", "a\n", "\r\n", *made]], "text string")


def test_lines_are_those_of_the_pattern(spark):
    rows = odd_texts(spark).select(F.col("text"), T.lines(F.col("text")).alias("l"), F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(LINE_PATTERN), F.lit(0)).alias("want"))
    assert rows.filter("l <> want or l is null").count() == 0
    bare = odd_texts(spark).select(T.bare(F.col("text")).alias("b"), F.regexp_replace("text", f"[{T.BREAK}]+$", "").alias("want"))
    assert bare.filter("not b <=> want").count() == 0


def test_units_split_a_text_once(spark):
    df = spark.createDataFrame([("x",)], "text string").filter("text <> 'y'")
    assert splits(df.select(corpus.chunk_array(F.col("text"), 10).alias("c"))) == 1


def test_sections_and_previews_split_a_text_once(spark):
    df = spark.createDataFrame([("x",)], "text string").filter("text <> 'y'")
    assert splits(df.select(corpus.section_array(F.col("text")).alias("c"))) == 1
    option = routing.section_option(F.lit("h"), F.col("text"), F.lit(1), F.lit("t"), F.lit("d"), F.lit("r"), F.lit("where the train"))
    assert splits(df.select(option.alias("o"))) == 1
