"""Markdown links, their classification, lint, and directory indexes made from frontmatter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.text import basename, dirname, title_of

#: A link that is no image; a title in quotes after the target is not part of it.
LINK = r"""(?<!!)\[[^\]]*\]\(([^)]+)\)"""
REQUIRED = ("type", "title", "description")
RECOMMENDED = ("tags", "when_to_use", "timestamp")


def resolve(base: Column, href: Column) -> Column:
    """A target relative to the root: null for other schemes and bare fragments; '.' and '..' are
    folded away, also at the end, and never lead above the root."""
    href = F.regexp_replace(F.trim(href), r"""\s+["'][^"']*["']$""", "")
    plain = F.trim(F.substring_index(href, "#", 1))
    whole = F.when(plain.startswith("/"), plain).when(base == "", plain).otherwise(F.concat(base, F.lit("/"), plain))
    step = lambda acc, p: F.when((p == "") | (p == "."), acc).when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, p))
    folded = F.array_join(F.aggregate(F.split(whole, "/"), F.expr("cast(array() as array<string>)"), step), "/")
    outside = href.rlike(r"^(https?://|mailto:|#)") | (plain == "")
    return F.when(outside | (folded == ""), F.lit(None).cast("string")).otherwise(folded)


def links(pages: DataFrame) -> DataFrame:
    """path, ord, target: each page's distinct targets in order of their first link. pages: path, text."""
    rows = pages.select("path", F.posexplode(F.regexp_extract_all("text", F.lit(LINK), F.lit(1))).alias("pos", "href"))
    rows = rows.select("path", "pos", resolve(dirname(F.col("path")), F.col("href")).alias("target")).filter("target is not null")
    first = rows.groupBy("path", "target").agg(F.min("pos").alias("pos"))
    return first.withColumn("ord", F.row_number().over(Window.partitionBy("path").orderBy("pos"))).select("path", "ord", "target")


def classify(found: DataFrame, concept_paths: DataFrame, index_dirs: DataFrame, tree_dirs: DataFrame) -> DataFrame:
    """Adds kind to links: concept, index, dir, or dangling, in this order of precedence.
    concept_paths, index_dirs, tree_dirs: one column ``path`` each."""
    with_md = F.when(F.col("target").endswith(".md"), F.col("target")).otherwise(F.concat("target", F.lit(".md")))
    rows = found.withColumn("_md", with_md)
    for name, known, key in (("_c", concept_paths, "_md"), ("_i", index_dirs, "target"), ("_d", tree_dirs, "target")):
        rows = rows.join(known.select(F.col("path").alias(key), F.lit(True).alias(name)).distinct(), key, "left")
    is_index = (F.col("target") == "index.md") | F.col("target").endswith("/index.md")
    kind = F.when(F.col("_c"), "concept").when(is_index | F.col("_i"), "index").when(F.col("_d"), "dir").otherwise("dangling")
    return rows.select("path", "ord", "target", kind.alias("kind"))


def lint(concepts: DataFrame, indexes: DataFrame, tree_dirs: DataFrame) -> DataFrame:
    """path, level, message. concepts as by operators.corpus.concepts (present: null without frontmatter)."""
    bare = concepts.filter("present is null").select("path", F.lit("error").alias("level"), F.lit("missing YAML frontmatter").alias("message"))
    has = concepts.filter("present is not null")
    missing = None
    for level, keys, what in (("error", REQUIRED, "missing required field: "), ("warning", RECOMMENDED, "missing recommended field: ")):
        gone = F.filter(F.array(*map(F.lit, keys)), lambda k: ~F.array_contains(F.col("present"), k))
        rows = has.select("path", F.lit(level).alias("level"), F.explode(gone).alias("k")).select("path", "level", F.concat(F.lit(what), "k").alias("message"))
        missing = rows if missing is None else missing.unionByName(rows)
    index_path = F.when(F.col("path") == "", F.lit("index.md")).otherwise(F.concat("path", F.lit("/index.md")))
    pages = has.select("path", F.col("raw").alias("text")).unionByName(indexes.select(index_path.alias("path"), "text"))
    kinds = classify(links(pages), concepts.select("path"), indexes.select("path"), tree_dirs)
    dangling = kinds.filter("kind = 'dangling'").select("path", F.lit("error").alias("level"), F.concat(F.lit("dangling link: "), "target").alias("message"))
    return bare.unionByName(missing).unionByName(dangling)


def dir_descriptions(concepts: DataFrame) -> DataFrame:
    """dir, description: of each directory the first description of a concept below it, in the order of path components."""
    above = concepts.filter("description <> ''").select("path", "description", F.explode(F.expr("transform(sequence(1, size(split(path, '/')) - 1), i -> array_join(slice(split(path, '/'), 1, i), '/'))")).alias("dir"))
    return above.groupBy("dir").agg(F.min_by("description", F.split("path", "/")).alias("description"))


def generate_indexes(concepts: DataFrame, edges: DataFrame, root_name: str = "bundle") -> DataFrame:
    """dir, content: an index of each directory's directories and concepts, from titles and descriptions."""
    kids = edges.filter("kind = 'dir'").join(dir_descriptions(concepts).withColumnRenamed("dir", "child"), "child", "left")
    name = basename(F.col("child"))
    line = F.concat(F.lit("* ["), name, F.lit("]("), name, F.lit("/) — "), F.coalesce("description", F.concat(name, F.lit(" concepts"))))
    dirs = kids.groupBy("parent").agg(F.array_sort(F.collect_list(F.struct("child", line.alias("line")))).alias("dirs"))
    said = F.when(F.col("description") == "", F.col("title")).otherwise(F.col("description"))
    entry = F.concat(F.lit("* ["), "title", F.lit("]("), basename(F.col("path")), F.lit(") — "), said)
    files = concepts.groupBy(dirname(F.col("path")).alias("parent")).agg(F.array_sort(F.collect_list(F.struct("path", entry.alias("line")))).alias("files"))
    block = lambda head, c: F.when(F.size(c) > 0, F.concat(F.lit(f"\n\n## {head}\n\n"), F.array_join(c["line"], "\n"))).otherwise("")
    rows = dirs.join(files, "parent", "full")
    own = F.when(F.col("parent") == "", F.lit(root_name)).otherwise(basename(F.col("parent")))
    return rows.select(F.col("parent").alias("dir"), F.concat(F.lit("# "), title_of(own), block("Directories", F.col("dirs")), block("Concepts", F.col("files")), F.lit("\n")).alias("content"))


def synopses(concepts: DataFrame, sections: DataFrame) -> DataFrame:
    """path, synopsis: title, description, purpose and headings of each concept."""
    heads = sections.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start_line", F.format_string("- L%d-%d h%d %s", "start_line", "end_line", "level", "heading").alias("line")))).alias("h"))
    use = F.when(F.coalesce("when_to_use", F.lit("")) != "", F.concat(F.lit("- when_to_use: "), "when_to_use", F.lit("\n"))).otherwise("")
    text = F.concat(F.lit("## "), "path", F.lit("\n\n- title: "), "title", F.lit("\n- description: "), "description", F.lit("\n"), use, F.coalesce(F.array_join(F.col("h.line"), "\n"), F.lit("")), F.lit("\n"))
    return concepts.join(heads, "path", "left").select("path", text.alias("synopsis"))


def index_summaries(indexes: DataFrame, chars: int = 600) -> DataFrame:
    """dir, name, summary: of each name the first index line that links to it."""
    rows = indexes.select(F.col("path").alias("dir"), F.posexplode(F.split("text", "\n")).alias("n", "line"))
    href = F.regexp_extract("line", LINK, 1)
    rows = rows.filter(F.col("line").rlike(LINK)).select("dir", "n", F.url_decode(basename(F.rtrim(href, F.lit("/")))).alias("name"), F.substring(F.trim("line"), 1, chars).alias("summary"))
    return rows.groupBy("dir", "name").agg(F.min_by("summary", "n").alias("summary"))
