"""Event streams of agents: JSON lines to messages, usage and answer spans; lenient JSON."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

EVENT = "type string, message struct<role:string, content:array<struct<type:string, text:string>>, usage:struct<totalTokens:bigint, input:bigint, cacheRead:bigint, output:bigint, cost:struct<total:double>>>"
SPANS = "array<struct<path:string, start_line:int, end_line:int>>"


def events(lines: DataFrame) -> DataFrame:
    """Adds e, the parsed event (null fields where a line is no JSON). lines: run_id, line, and an order if wanted."""
    return lines.withColumn("e", F.from_json("line", EVENT))


def event_usage(lines: DataFrame) -> DataFrame:
    """run_id, calls (assistant messages with tokens), input (cache reads included), output, cost, tools."""
    said = (F.col("e.type") == "message_end") & (F.col("e.message.role") == "assistant")
    use = lambda c: F.coalesce(F.col(f"e.message.usage.{c}"), F.lit(0))
    total = lambda x: F.sum(F.when(said, x).otherwise(0))
    return events(lines).groupBy("run_id").agg(
        F.count_if(said & (use("totalTokens") > 0)).alias("calls"), total(use("input") + use("cacheRead")).alias("input"), total(use("output")).alias("output"),
        F.round(total(use("cost.total")).cast("double"), 6).alias("cost"), F.count_if(F.col("e.type") == "tool_execution_start").alias("tools"),
    )


def first_object(text: str | None) -> dict | None:
    """The first JSON object that can be decoded from a text; fences and prose around it do not matter."""
    decoder = json.JSONDecoder()
    at = (text or "").find("{")
    while at >= 0:
        try:
            value, _ = decoder.raw_decode(text, at)
            if isinstance(value, dict):
                return value
        except json.JSONDecodeError:
            pass
        at = text.find("{", at + 1)
    return None


@F.pandas_udf(StringType())
def json_object(texts: pd.Series) -> pd.Series:
    """first_object of each text, as JSON; null without one."""
    return texts.map(lambda t: json.dumps(found) if (found := first_object(t)) is not None else None)


def answer_spans(lines: DataFrame, files: DataFrame, top_k: int) -> DataFrame:
    """run_id, rank, path, start_line, end_line: the valid spans of each run's last assistant text.
    lines: run_id, seq, line; files: path, n_lines. Unknown paths and ranges outside a file are left out."""
    said = events(lines).filter((F.col("e.type") == "message_end") & (F.col("e.message.role") == "assistant"))
    parts = said.select("run_id", "seq", F.posexplode("e.message.content").alias("i", "part")).filter("part.type = 'text' and part.text <> ''")
    last = parts.groupBy("run_id").agg(F.max_by("part.text", F.struct("seq", "i")).alias("text"))
    spans = last.select("run_id", F.posexplode(F.from_json(json_object("text"), f"spans {SPANS}")["spans"]).alias("pos", "s"))
    spans = spans.select("run_id", "pos", F.regexp_replace("s.path", r"^\./", "").alias("path"), "s.start_line", "s.end_line").join(files, "path")
    good = spans.filter("1 <= start_line and start_line <= end_line and end_line <= n_lines")
    once = good.groupBy("run_id", "path", "start_line", "end_line").agg(F.min("pos").alias("pos"))
    from pyspark.sql import Window

    return once.withColumn("rank", F.row_number().over(Window.partitionBy("run_id").orderBy("pos"))).filter(F.col("rank") <= top_k).drop("pos")
