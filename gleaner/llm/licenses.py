"""Licence scan: ordered signature rules over a text's words, DataFrame functions only.

A rule is (label, gate, needs, tier, regex) over the text's lower-case words joined by single spaces. The
gate is a word that stands in every match, and of each set in needs a match has one word, so a rule
whose gate and needs are not among the text's words is not run, and a text without gates runs none. Every detection is a word interval. Of two that overlap the
one of the better tier stays, of one tier the longer one (so a contained one goes), then the earlier.
Detections are taken in the order of their starts: each meets the one kept last, the worse one goes.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_rules import rules

#: The base phrases and their labels (fixed by the contract of op2).
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MARK = "\x01"
#: The two letters outside of ASCII whose lower case holds an ASCII letter (fixed by Unicode).
KELVIN, DOTTED = "\u212a", "\u0130"


def lowered(text: Column) -> Column:
    """Lower case, which for ASCII letters is that of A-Z alone; null: empty."""
    text = F.coalesce(text, F.lit(""))
    return F.lower(F.when(F.contains(text, F.lit(KELVIN)) | F.contains(text, F.lit(DOTTED)), F.translate(text, KELVIN + DOTTED, "\u0138\u0131")).otherwise(text))


def words_of(text: Column) -> Column:
    """A space, the text's words each followed by a space; a lone space if there are none."""
    return F.concat(F.lit(" "), F.ltrim(F.concat(F.trim(F.regexp_replace(lowered(text), WORD_GAP, " ")), F.lit(" "))))


def _spaces(c: Column) -> Column:
    return (F.char_length(c) - F.char_length(F.replace(c, F.lit(" "), F.lit("")))).cast("long")


def _detections(words: Column, rule: Column) -> Column:
    """The rule's matches as (start word, end word, tier, label)."""
    regex = F.concat(F.lit("(?<= )(?:"), rule["regex"], F.lit(")(?= )"))
    marked = F.split(F.regexp_replace(words, regex, F.lit(f"{MARK}$0")), " ")
    starts = F.filter(F.transform(marked, lambda w, i: F.when(w.startswith(MARK), (i - 1).cast("long"))), lambda x: x.isNotNull())
    return F.zip_with(starts, F.regexp_extract_all(words, regex, F.lit(0)), lambda s, m: F.struct(s.alias("start"), (-(s + _spaces(m) + 1)).alias("neg_end"), rule["tier"].alias("tier"), rule["label"].alias("label")))


def _resolve(found: Column) -> Column:
    """One sweep over the detections by start: (labels, best tier, number kept)."""
    none = F.struct(F.lit(None).cast("long").alias("end"), F.lit(0).cast("long").alias("size"), F.lit(99).alias("tier"), F.lit("").alias("label"))
    zero = F.struct(none.alias("last"), F.array().cast("array<string>").alias("labels"), F.lit(99).alias("best"), F.lit(0).cast("long").alias("kept"))

    def settled(acc: Column) -> list[Column]:
        """What is known once the detection kept last cannot be replaced any more."""
        some = acc["last"]["end"].isNotNull()
        return [
            F.when(some & ~F.array_contains(acc["labels"], acc["last"]["label"]), F.array_append(acc["labels"], acc["last"]["label"])).otherwise(acc["labels"]).alias("labels"),
            F.least(acc["best"], acc["last"]["tier"]).alias("best"),
            (acc["kept"] + some.cast("long")).alias("kept"),
        ]

    def step(acc, d):
        last, end = acc["last"], -d["neg_end"]
        mine = F.struct(end.alias("end"), (end - d["start"]).alias("size"), d["tier"].alias("tier"), d["label"].alias("label"))
        better = (d["tier"] < last["tier"]) | ((d["tier"] == last["tier"]) & (mine["size"] > last["size"]))
        apart = last["end"].isNull() | (d["start"] >= last["end"])
        instead = F.struct(mine.alias("last"), acc["labels"].alias("labels"), acc["best"].alias("best"), acc["kept"].alias("kept"))
        return F.when(apart, F.struct(mine.alias("last"), *settled(acc))).when(better, instead).otherwise(acc)

    return F.aggregate(F.array_sort(found), zero, step, lambda acc: F.struct(*settled(acc)))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs, no shuffle. Null or empty text: no words, no labels, score 0.

    score: 1.0 for a survivor of tier 1 down to 0.6 for tier 5; 0.6 for base phrases alone.
    Ids, also null or repeated ones, are passed through row by row; other columns are ignored, whatever
    their names; very long texts are scanned whole; an empty table gives no rows.
    """
    table = rules()
    words = F.col("words")
    rows = docs.select(F.col(id_col).alias("doc_id"), words_of(F.col(text_col)).alias("words"))
    either = "|".join(p for p, _ in BASE)
    known = {k for _, k, _, _, _ in table}
    # tables go into the plan as one constant each, not as thousands of expressions
    listed_words = lambda words: F.split(F.lit(" ".join(sorted(words))), " ")
    told = listed_words(known.union(*[c for _, _, needs, _, _ in table for c in needs]))
    rows = rows.withColumn("n_words", _spaces(words) - 1)
    rows = rows.withColumn("hits", F.array_intersect(F.split(words, " "), told))
    rows = rows.withColumn("base", F.when(F.contains(words, F.lit(" license ")), F.struct(
        *[F.regexp_count(words, F.lit(f" {p}(?= )")).cast("long").alias(label) for p, label in BASE],
        F.regexp_extract(words, f"(?s)^(.*? )(?:{either}) ", 1).alias("before_first"),
        F.regexp_extract(words, f"(?s)^(.* )(?:{either}) ", 1).alias("before_last"),
    )))
    listed = F.from_json(F.lit(json.dumps([dict(zip(("label", "gate", "needs", "tier", "regex"), r)) for r in table])), "array<struct<label:string,gate:string,needs:array<array<string>>,tier:int,regex:string>>")
    hot = F.filter(listed, lambda r: F.array_contains(F.col("hits"), r["gate"]) & F.forall(r["needs"], lambda c: F.arrays_overlap(c, F.col("hits"))))
    gated = F.arrays_overlap("hits", listed_words(known))
    rows = rows.withColumn("found", F.when(gated, _resolve(F.flatten(F.transform(hot, lambda r: _detections(F.col("words"), r))))))
    count = {label: F.coalesce(F.col(f"base.{label}"), F.lit(0).cast("long")) for _, label in BASE}
    n_base = sum(count.values(), F.lit(0).cast("long"))
    base_labels = F.array_compact(F.array(*[F.when(count[x] > 0, x) for x in sorted(count)]))
    place = lambda c: F.when(n_base > 0, _spaces(F.col(f"base.{c}")) - 1)
    best = F.coalesce("found.best", F.lit(99))
    score = F.when(best <= 5, F.round(1.1 - best * 0.1, 1)).when(n_base > 0, 0.6).otherwise(0.0)
    return rows.select(
        "doc_id", "n_words", n_base.alias("n_base"), place("before_first").alias("first_word"), place("before_last").alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, F.coalesce("found.labels", F.array().cast("array<string>")))), ",").alias("labels"),
        score.cast("double").alias("score"), F.coalesce("found.kept", F.lit(0).cast("long")).alias("n_detections"),
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
