"""Queries of the corpus model, links and authoring, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.operators import corpus, links

from .tables import DOCUMENTS, LINES, MARKDOWN, documents, markdown, read


def _long(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in cols})


def chunk_80_lines(spark: SparkSession, sf: str) -> DataFrame:
    rows = corpus.sections(documents(spark, sf), "text", ("doc_ord", "path"))
    return _long(rows.select("doc_ord", "sec_no", "start_line", "end_line", "heading", F.md5("text").alias("text_md5")), "sec_no", "start_line", "end_line")


def sectionize_pages(spark: SparkSession, sf: str) -> DataFrame:
    rows = corpus.sections(markdown(spark, sf), "text", ("page_id", "path"))
    return _long(rows.select("page_id", "sec_no", "start_line", "end_line", "heading", "level", F.md5("text").alias("text_md5")), "sec_no", "start_line", "end_line", "level")


def _concepts(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as concepts: fields are missing by a rule that both engines share."""
    name = F.regexp_extract("text", r"\n# ([^\n]*)", 1)
    rows = markdown(spark, sf)
    present = F.when(F.col("page_id") % 11 != 0, F.filter(F.array(*[F.when(F.col("page_id") % m != 0, F.lit(f)) for f, m in (("type", 5), ("title", 7), ("description", 3), ("tags", 4), ("when_to_use", 6), ("timestamp", 9))]), lambda x: x.isNotNull()))
    stem = F.col("page_id").cast("string")
    return rows.select(
        "page_id", "path", F.col("text").alias("raw"), F.col("text").alias("body"), F.size(T.lines(F.col("text"))).alias("n_lines"), present.alias("present"),
        F.lit("page").alias("type"), F.when(name == "", stem).otherwise(F.substring(name, 1, 40)).alias("title"),
        F.when(F.col("page_id") % 3 == 0, "").otherwise(F.concat(F.lit("About "), F.substring(name, 1, 20))).alias("description"),
        F.array(F.lit("web"), F.concat(F.lit("s"), (F.col("page_id") % 7).cast("string"))).alias("tags"), F.when(F.col("page_id") % 6 != 0, F.lit("when asked")).alias("when_to_use"),
    )


def retrieval_docs(spark: SparkSession, sf: str) -> DataFrame:
    rows = corpus.retrieval_docs(_concepts(spark, sf))
    return _long(rows.select("id", "path", "start_line", "end_line", "heading", F.md5("text").alias("text_md5")), "start_line", "end_line")


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return markdown(spark, sf).select("path", "text")


def href_resolve(spark: SparkSession, sf: str) -> DataFrame:
    """Link targets of every page, and constructed ones with dots, fragments and schemes."""
    rows = read(spark, sf, "pages").select("page_id", F.format_string("a/b%d", F.col("page_id") % 5).alias("base"), F.explode(F.concat(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)), F.array(
        F.concat(F.lit("../x/"), F.col("page_id").cast("string"), F.lit(".md#part")), F.lit("./y/./z.md"), F.lit("../../../up.md"), F.lit("w/.."), F.lit("#here"), F.col("url"), F.lit(" /abs/../t.md ")))).alias("href"))
    return rows.withColumn("target", links.resolve(F.col("base"), F.col("href")))


def extract_links(spark: SparkSession, sf: str) -> DataFrame:
    return _long(links.links(_pages(spark, sf)), "ord")


def _link_sets(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Known concepts, index directories and tree directories: every third, fifth and seventh target exists."""
    targets = links.links(_pages(spark, sf)).select("target").distinct()
    n = F.char_length("target")
    with_md = F.concat("target", F.lit(".md"))
    return targets.filter(n % 3 == 0).select(with_md.alias("path")), targets.filter(n % 5 == 0).select(F.col("target").alias("path")), targets.filter(n % 7 == 0).select(F.col("target").alias("path"))


def link_classify(spark: SparkSession, sf: str) -> DataFrame:
    return _long(links.classify(links.links(_pages(spark, sf)), *_link_sets(spark, sf)), "ord")


def lint_issues(spark: SparkSession, sf: str) -> DataFrame:
    none = spark.createDataFrame([], "path string, text string")
    return links.lint(_concepts(spark, sf), none, _link_sets(spark, sf)[2])


def tree_edges(spark: SparkSession, sf: str) -> DataFrame:
    return _long(corpus.edges(documents(spark, sf)), "ord")


def tree_closure(spark: SparkSession, sf: str) -> DataFrame:
    """Every directory with the number of files at each depth below it: ancestors are read off the paths."""
    rows = documents(spark, sf).select(F.size(F.split("path", "/")).alias("n"), F.posexplode(T.ancestors(F.col("path"))).alias("at", "dir"))
    return rows.groupBy("dir", (F.col("n") - F.col("at")).cast("long").alias("depth")).agg(F.count("*").alias("files"))


def generate_index(spark: SparkSession, sf: str) -> DataFrame:
    rows = _concepts(spark, sf)
    return links.generate_indexes(rows, corpus.edges(rows)).select("dir", "content")


def section_synopses(spark: SparkSession, sf: str) -> DataFrame:
    rows = _concepts(spark, sf)
    return links.synopses(rows, corpus.sections(rows, "raw")).select("path", "synopsis")


def content_hash_files(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("path", F.sha2("text", 256).alias("sha256"))


def freshness(spark: SparkSession, sf: str) -> DataFrame:
    """Files whose stored hash (of an older state, in which every tenth text was shorter) no longer holds."""
    now = content_hash_files(spark, sf)
    old = documents(spark, sf).select("path", F.sha2(F.when(F.col("doc_ord") % 10 == 0, F.substring("text", 1, 50)).otherwise(F.col("text")), 256).alias("stored"))
    return now.join(old, "path").select("path", (F.col("sha256") == F.col("stored")).alias("fresh"))


QUERIES = {f.__name__: f for f in (chunk_80_lines, sectionize_pages, retrieval_docs, href_resolve, extract_links, link_classify, lint_issues, tree_edges, tree_closure, generate_index, section_synopses, content_hash_files, freshness)}

_SECTIONS = f"""ln AS (SELECT page_id, path, l, [i for i in range(1, len(l) + 1) if regexp_matches(rtrim(l[i], chr(10)), '^#{{1,6}}\\s+.+')] AS heads FROM (SELECT page_id, path, {LINES.format('text')} AS l FROM md)),
raw_secs AS (SELECT page_id, path, l, heads, unnest(CASE WHEN len(heads) = 0 THEN [{{'s': 1, 'e': len(l), 'k': '(document)'}}] ELSE
    list_concat(CASE WHEN heads[1] > 1 THEN [{{'s': CAST(1 AS BIGINT), 'e': heads[1] - 1, 'k': '(preamble)'}}] ELSE [] END,
    [{{'s': heads[j], 'e': CASE WHEN j < len(heads) THEN heads[j + 1] - 1 ELSE len(l) END, 'k': ''}} for j in range(1, len(heads) + 1)]) END) AS x FROM ln),
secs AS (SELECT page_id, path, row_number() OVER (PARTITION BY page_id ORDER BY s) - 1 AS sec_no, s AS start_line, e AS end_line,
    CASE WHEN k <> '' THEN k ELSE trim(regexp_extract(rtrim(l[s], chr(10)), '^(#{{1,6}})\\s+(.+?)\\s*$', 2)) END AS heading,
    CASE WHEN k <> '' THEN 0 ELSE length(regexp_extract(l[s], '^(#{{1,6}})\\s', 1)) END AS level, text
  FROM (SELECT page_id, path, l, x.s AS s, x.e AS e, x.k AS k, array_to_string(l[x.s : x.e], '') AS text FROM raw_secs) WHERE k = '' OR regexp_matches(text, '\\S'))"""
_CONCEPTS = """concepts AS (SELECT page_id, path, text AS raw, CASE WHEN page_id % 11 <> 0 THEN [f for f in [CASE WHEN page_id % 5 <> 0 THEN 'type' END, CASE WHEN page_id % 7 <> 0 THEN 'title' END, CASE WHEN page_id % 3 <> 0 THEN 'description' END,
    CASE WHEN page_id % 4 <> 0 THEN 'tags' END, CASE WHEN page_id % 6 <> 0 THEN 'when_to_use' END, CASE WHEN page_id % 9 <> 0 THEN 'timestamp' END] if f IS NOT NULL] END AS present,
  CASE WHEN name = '' THEN CAST(page_id AS VARCHAR) ELSE substring(name, 1, 40) END AS title, CASE WHEN page_id % 3 = 0 THEN '' ELSE 'About ' || substring(name, 1, 20) END AS description,
  CASE WHEN page_id % 6 <> 0 THEN 'when asked' END AS when_to_use FROM (SELECT *, regexp_extract(text, '\\n# ([^\\n]*)', 1) AS name FROM md))"""


def _resolve(base: str, href: str) -> str:
    plain = f"trim(string_split({href}, '#')[1])"
    whole = f"string_split(CASE WHEN starts_with({plain}, '/') OR {base} = '' THEN {plain} ELSE {base} || '/' || {plain} END, '/')"
    fold = f"array_to_string(list_reduce(list_prepend(CAST([] AS VARCHAR[]), [[p] for p in {whole}]), lambda a, p: CASE WHEN p[1] IN ('', '.') THEN a WHEN p[1] = '..' THEN a[1 : len(a) - 1] ELSE list_append(a, p[1]) END), '/')"
    return f"CASE WHEN regexp_matches(trim({href}), '^(https?://|mailto:|#)') OR {plain} = '' THEN NULL ELSE nullif({fold}, '') END"


_LINKS = f"""found AS (SELECT path, h, i FROM (SELECT path, unnest(l) AS h, unnest(range(1, len(l) + 1)) AS i FROM (SELECT path, regexp_extract_all(text, '\\[[^\\]]*\\]\\(([^)]+)\\)', 1) AS l FROM md))),
targets AS (SELECT path, target, min(i) AS i FROM (SELECT path, i, {_resolve("regexp_extract(path, '^(.*)/[^/]*$', 1)", 'trim(h)')} AS target FROM found) WHERE target IS NOT NULL GROUP BY ALL),
links AS (SELECT path, row_number() OVER (PARTITION BY path ORDER BY i) AS ord, target FROM targets),
kinds AS (SELECT path, ord, target, CASE WHEN EXISTS (SELECT 1 FROM links c WHERE length(c.target) % 3 = 0 AND c.target || '.md' = CASE WHEN ends_with(l.target, '.md') THEN l.target ELSE l.target || '.md' END) THEN 'concept'
  WHEN l.target = 'index.md' OR ends_with(l.target, '/index.md') OR length(l.target) % 5 = 0 THEN 'index' WHEN length(l.target) % 7 = 0 THEN 'dir' ELSE 'dangling' END AS kind FROM links l)"""
_KNOWN = """lint_kinds AS (SELECT path, target, CASE WHEN (CASE WHEN ends_with(target, '.md') THEN target ELSE target || '.md' END) IN (SELECT path FROM concepts) THEN 'c' WHEN target = 'index.md' OR ends_with(target, '/index.md') THEN 'i' WHEN length(target) % 7 = 0 THEN 'd' ELSE 'x' END AS kind FROM links)"""
_EDGES = """edges AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY kind, child) AS ord FROM (SELECT DISTINCT array_to_string(p[1 : i - 1], '/') AS parent, array_to_string(p[1 : i], '/') AS child, CASE WHEN i < len(p) THEN 'dir' ELSE 'file' END AS kind
  FROM (SELECT p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT string_split(path, '/') AS p FROM {0}))))"""

ORACLE_SQL = {
    "chunk_80_lines": f"""WITH {DOCUMENTS}, c AS (SELECT doc_ord, l, unnest(range(0, (len(l) + 79) // 80)) AS s FROM (SELECT doc_ord, {LINES.format('text')} AS l FROM docs))
SELECT doc_ord, s AS sec_no, s * 80 + 1 AS start_line, least(s * 80 + 80, len(l)) AS end_line, 'Lines ' || CAST(s * 80 + 1 AS VARCHAR) || '–' || CAST(least(s * 80 + 80, len(l)) AS VARCHAR) AS heading, md5(array_to_string(l[s * 80 + 1 : s * 80 + 80], '')) AS text_md5 FROM c""",
    "sectionize_pages": f"WITH {MARKDOWN}, {_SECTIONS} SELECT page_id, sec_no, start_line, end_line, heading, level, md5(text) AS text_md5 FROM secs",
    "retrieval_docs": f"""WITH {MARKDOWN}, {_SECTIONS}, {_CONCEPTS}
SELECT path || '#-1' AS id, path, CAST(1 AS BIGINT) AS start_line, greatest(1, len({LINES.format('raw')})) AS end_line, '(concept)' AS heading,
  md5(array_to_string([x for x in [path, 'page', title, description, 'web s' || CAST(page_id % 7 AS VARCHAR), coalesce(when_to_use, '')] if x <> ''], chr(10)) || chr(10) || raw) AS text_md5 FROM concepts
UNION ALL SELECT s.path || '#' || CAST(sec_no AS VARCHAR), s.path, start_line, end_line, heading, md5(title || chr(10) || description || chr(10) || heading || chr(10) || s.text) FROM secs s JOIN concepts c ON c.path = s.path""",
    "href_resolve": f"""WITH h AS (SELECT page_id, 'a/b' || CAST(page_id % 5 AS VARCHAR) AS base, unnest(list_concat(regexp_extract_all(html, 'href="([^"]*)"', 1), ['../x/' || CAST(page_id AS VARCHAR) || '.md#part', './y/./z.md', '../../../up.md', 'w/..', '#here', url, ' /abs/../t.md '])) AS href FROM pages)
SELECT page_id, base, href, {_resolve('base', 'trim(href)')} AS target FROM h""",
    "extract_links": f"WITH {MARKDOWN}, {_LINKS} SELECT path, ord, target FROM links",
    "link_classify": f"WITH {MARKDOWN}, {_LINKS} SELECT path, ord, target, kind FROM kinds",
    "lint_issues": f"""WITH {MARKDOWN}, {_LINKS}, {_CONCEPTS}, {_KNOWN}
SELECT path, 'error' AS level, 'missing YAML frontmatter' AS message FROM concepts WHERE present IS NULL
UNION ALL SELECT path, 'error', 'missing required field: ' || k FROM (SELECT path, present, unnest(['type', 'title', 'description']) AS k FROM concepts WHERE present IS NOT NULL) WHERE NOT list_contains(present, k)
UNION ALL SELECT path, 'warning', 'missing recommended field: ' || k FROM (SELECT path, present, unnest(['tags', 'when_to_use', 'timestamp']) AS k FROM concepts WHERE present IS NOT NULL) WHERE NOT list_contains(present, k)
UNION ALL SELECT path, 'error', 'dangling link: ' || target FROM lint_kinds JOIN concepts USING (path) WHERE present IS NOT NULL AND kind = 'x'""",
    "tree_edges": f"WITH {DOCUMENTS}, {_EDGES.format('docs')} SELECT * FROM edges",
    "tree_closure": f"""WITH RECURSIVE {DOCUMENTS}, {_EDGES.format('docs')},
below AS (SELECT parent AS dir, child, kind, CAST(1 AS BIGINT) AS depth FROM edges UNION ALL SELECT b.dir, e.child, e.kind, b.depth + 1 FROM below b JOIN edges e ON e.parent = b.child)
SELECT dir, depth, count(*) AS files FROM below WHERE kind = 'file' GROUP BY ALL""",
    "generate_index": f"""WITH {MARKDOWN}, {_CONCEPTS}, {_EDGES.format('concepts')},
d AS (SELECT parent, string_agg('* [' || child || '](' || child || '/) — ' || coalesce((SELECT arg_min(description, string_split(path, '/')) FROM concepts c WHERE starts_with(c.path, child || '/') AND description <> ''), child || ' concepts'), chr(10) ORDER BY child) AS t FROM edges WHERE kind = 'dir' GROUP BY parent),
f AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent, string_agg('* [' || title || '](' || regexp_extract(path, '([^/]*)$', 1) || ') — ' || CASE WHEN description = '' THEN title ELSE description END, chr(10) ORDER BY path) AS t FROM concepts GROUP BY ALL)
SELECT coalesce(d.parent, f.parent) AS dir, '# ' || CASE WHEN coalesce(d.parent, f.parent) = '' THEN 'Bundle' ELSE 'Site' || substring(coalesce(d.parent, f.parent), 5) END || CASE WHEN d.t IS NULL THEN '' ELSE chr(10) || chr(10) || '## Directories' || chr(10) || chr(10) || d.t END
  || CASE WHEN f.t IS NULL THEN '' ELSE chr(10) || chr(10) || '## Concepts' || chr(10) || chr(10) || f.t END || chr(10) AS content FROM d FULL JOIN f ON d.parent = f.parent""",
    "section_synopses": f"""WITH {MARKDOWN}, {_SECTIONS}, {_CONCEPTS}, h AS (SELECT path, string_agg('- L' || CAST(start_line AS VARCHAR) || '-' || CAST(end_line AS VARCHAR) || ' h' || CAST(level AS VARCHAR) || ' ' || heading, chr(10) ORDER BY start_line) AS t FROM secs GROUP BY path)
SELECT path, '## ' || path || chr(10) || chr(10) || '- title: ' || title || chr(10) || '- description: ' || description || chr(10) || CASE WHEN when_to_use IS NOT NULL THEN '- when_to_use: ' || when_to_use || chr(10) ELSE '' END || coalesce(t, '') || chr(10) AS synopsis FROM concepts LEFT JOIN h USING (path)""",
    "content_hash_files": f"WITH {DOCUMENTS} SELECT path, sha256(text) AS sha256 FROM docs",
    "freshness": f"WITH {DOCUMENTS} SELECT path, sha256(text) = sha256(CASE WHEN doc_ord % 10 = 0 THEN substring(text, 1, 50) ELSE text END) AS fresh FROM docs",
}
