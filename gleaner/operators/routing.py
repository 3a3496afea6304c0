"""What a chooser reads of a directory's children and a file's sections, and how its answers are read."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.text import basename, preview, stem

from .links import index_summaries

#: Titles that an option lists, levels below a child that they come from, characters of a preview.
TOPICS, LEVELS, SECTION_CHARS = 12, 3, 650


def child_summaries(children: DataFrame, indexes: DataFrame) -> DataFrame:
    """Adds summary to children (parent, child): the first line of the parent's index that links to a
    file or directory of that name, or the name itself. indexes: path (the directory), text."""
    said = index_summaries(indexes).select(F.col("dir").alias("parent"), F.col("name").alias("_name"), "summary")
    rows = children.withColumn("_name", basename(F.col("child"))).join(said, ["parent", "_name"], "left")
    return rows.withColumn("summary", F.coalesce("summary", "_name")).drop("_name")


def topics(edges: DataFrame) -> DataFrame:
    """dir, topics: names of the first TOPICS things below each directory, level by level, LEVELS deep.
    Only the first ones of each level go on, so a directory with very much below it is no hot key."""
    step = edges.select(F.col("parent").alias("above"), F.col("child").alias("below"), "ord", F.col("kind") == "dir")
    step = step.toDF("above", "below", "ord", "is_dir")
    level = edges.filter("kind = 'dir'").select(F.col("child").alias("dir"), F.col("child").alias("at"), F.expr("cast(array() as array<int>)").alias("way"))
    found = None
    for _ in range(LEVELS):
        kids = level.join(step, F.col("at") == F.col("above")).select("dir", F.col("below").alias("at"), F.array_append("way", F.col("ord")).alias("way"), "is_dir")
        first = kids.withColumn("_n", F.row_number().over(Window.partitionBy("dir").orderBy("way"))).filter(F.col("_n") <= TOPICS).drop("_n")
        found = first if found is None else found.unionByName(first)
        level = kids.filter("is_dir").drop("is_dir")
    name = F.replace(stem(basename(F.col("at"))), F.lit("-"), F.lit(" "))
    listed = found.groupBy("dir").agg(F.slice(F.array_sort(F.collect_list(F.struct(F.size("way").alias("depth"), "way", name.alias("name")))), 1, TOPICS).alias("t"))
    return listed.select("dir", F.array_join("t.name", ", ").alias("topics"))


def route_options(children: DataFrame, edges: DataFrame, indexes: DataFrame) -> DataFrame:
    """Adds option to children (parent, child, kind): path and index summary, of a directory also what is below."""
    rows = child_summaries(children, indexes).join(topics(edges).withColumnRenamed("dir", "child"), "child", "left")
    text = F.concat("child", F.lit(": "), "summary")
    return rows.withColumn("option", F.when(F.col("kind") == "dir", F.concat(text, F.lit("; subtopics: "), F.coalesce("topics", F.lit("")))).otherwise(text)).drop("summary", "topics")


def section_option(heading: Column, text: Column, start_line: Column, title: Column, description: Column, resource: Column, query: Column) -> Column:
    """A section's heading and preview; the part before the first heading stands for the page's metadata."""
    about = F.concat(F.lit("Metadata for "), title, F.lit(": "), description, F.when(F.coalesce(resource, F.lit("")) != "", F.concat(F.lit("; resource URL: "), resource)).otherwise(""))
    return F.when(heading == "(preamble)", about).otherwise(F.concat(heading, F.lit(": "), F.substring(preview(text, query, start_line), 1, SECTION_CHARS)))


def match_children(answers: DataFrame, children: DataFrame) -> DataFrame:
    """answers (id, parent, returned) with child: the child of that path, else the only one of that name, else null."""
    asked = answers.withColumn("_c", F.regexp_replace(F.trim("returned"), r"^/+|/+$", ""))
    named = children.groupBy("parent", basename(F.col("child")).alias("_c")).agg(F.count("*").alias("_n"), F.min("child").alias("_only")).filter("_n = 1").drop("_n")
    exact = children.select("parent", F.col("child").alias("_c"), F.col("child").alias("_exact"))
    return asked.join(exact, ["parent", "_c"], "left").join(named, ["parent", "_c"], "left").withColumn("child", F.coalesce("_exact", "_only")).drop("_c", "_exact", "_only")


def option_batches(options: DataFrame, max_options: int, max_chars: int, state: Column, *key: str) -> DataFrame:
    """Adds batch (from 0) to options (key columns, ord, option): a request closes before an option that
    would overfill it. state: the characters that every request has besides its options."""
    start = F.struct(F.lit(-1).alias("batch"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("size"), F.expr("cast(array() as array<int>)").alias("out"))

    def step(acc: Column, o: Column) -> Column:
        full = (acc["batch"] < 0) | (acc["n"] == max_options) | (acc["size"] + o["size"] > max_chars)
        batch = acc["batch"] + full.cast("int")
        size = F.when(full, o["state"] + o["size"]).otherwise(acc["size"] + o["size"])
        return F.struct(batch.alias("batch"), F.when(full, 1).otherwise(acc["n"] + 1).alias("n"), size.cast("long").alias("size"), F.array_append(acc["out"], batch).alias("out"))

    one = F.struct("ord", F.char_length("option").cast("long").alias("size"), state.cast("long").alias("state"))
    lists = options.groupBy(*key).agg(F.array_sort(F.collect_list(one)).alias("o"))
    dealt = lists.select(*key, F.explode(F.arrays_zip(F.col("o.ord").alias("ord"), F.aggregate("o", start, step)["out"].alias("batch"))).alias("z")).select(*key, "z.ord", "z.batch")
    return options.join(dealt, [*key, "ord"])


#: Characters by which known paths are looked up in a text.
HEAD = 4


def named_paths(texts: DataFrame, paths: DataFrame, label: str) -> DataFrame:
    """texts (id, text) with path: the known path after the label (or that path with .md), else the first
    known path, in their order, that stands in the text, else null. paths: path (of HEAD characters or
    more), ord. Where a known path's head stands in a text, pieces of the lengths of the paths with this head
    are taken, and an equi-join on the whole piece finds the path: paths with a common head never meet each
    other's texts."""
    said = F.regexp_replace(F.regexp_extract("text", re.escape(label) + r":\s*(\S+)", 1), r"[.,;]+$", "")
    known = paths.select(F.col("path").alias("_k"))
    rows = texts.withColumn("_said", said).join(known, F.col("_said") == F.col("_k"), "left")
    rows = rows.join(known.toDF("_m"), F.concat("_said", F.lit(".md")) == F.col("_m"), "left").withColumn("_named", F.coalesce("_k", F.when(~F.col("_said").endswith(".md"), F.col("_m"))))
    pieces = F.transform(F.sequence(F.lit(1), F.greatest(F.char_length("text") - HEAD + 1, F.lit(1))), lambda i: F.substring("text", i, F.lit(HEAD)))
    size = F.char_length("path")
    heads = paths.groupBy(F.substring("path", 1, HEAD).alias("_h")).agg(F.collect_set(size).alias("_sizes"))
    at = rows.filter("_named is null").select("id", "text", F.posexplode(pieces).alias("_at", "_h")).join(heads, "_h")
    cut = F.filter("_sizes", lambda n: F.col("_at") + n <= F.char_length("text"))
    inside = at.select("id", F.explode(F.transform(cut, lambda n: F.substring("text", F.col("_at") + 1, n))).alias("path")).distinct()
    met = inside.join(paths.select("path", "ord"), "path")
    found = met.groupBy("id").agg(F.min(F.struct("ord", "path")).alias("f")).select("id", F.col("f.path").alias("_inside"))
    return rows.join(found, "id", "left").withColumn("path", F.coalesce("_named", "_inside")).select(*texts.columns, "path")


def field(rows: DataFrame, name: str, *older: str, default=0) -> Column:
    """A result field, or the first older name of it that has a value, or the default."""
    return F.coalesce(*[F.col(c) for c in (name, *older) if c in rows.columns], F.lit(default)).alias(name)
