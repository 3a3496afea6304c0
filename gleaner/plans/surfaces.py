"""Queries of parsing, options, prepared indexes and results, with their SQL twins. Their inputs are made
from the tables by rules that both engines share."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner import models
from gleaner.functions import text as T
from gleaner.operators import agents, author, corpus, links, metrics, routing, walk
from gleaner.shared import shared_folder
from gleaner.sources import bundle, fixtures, sidecar

from .corpus import _EDGES
from .tables import DOCUMENTS, QUESTIONS, documents, questions, read


def text_guard(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes that are a text, and some that are not."""
    raw = F.encode(F.replace(F.col("text"), F.lit(" a "), F.lit("\r\na\r")), "utf-8")
    content = F.when(F.col("doc_ord") % 5 == 0, F.concat(raw, F.unhex(F.lit("FF")))).when(F.col("doc_ord") % 7 == 0, F.concat(raw, F.unhex(F.lit("00")))).otherwise(raw)
    return documents(spark, sf).select("doc_ord", F.md5(bundle.as_text(content)).alias("text_md5"))


def corpus_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Every file of a directory, in the order of a walk."""
    rows = documents(spark, sf).withColumn("dir", T.dirname(F.col("path")))
    from pyspark.sql import Window

    return rows.select("dir", "path", F.row_number().over(Window.partitionBy("dir").orderBy(corpus.corpus_order(F.col("path")))).cast("long").alias("place"))


def frontmatter_concepts(spark: SparkSession, sf: str) -> DataFrame:
    """Concepts of files with whole, partial, broken and no frontmatter."""
    n, name = F.col("doc_ord"), F.col("doc_ord").cast("string")
    fields = F.concat(F.lit("type: note\n"), F.when(n % 3 != 0, F.concat(F.lit("title: Title "), name, F.lit("\n"))).otherwise(""), F.lit("description: About "), name, F.lit("\ntags: "), F.when(n % 2 == 0, "[a, b]").otherwise("single"), F.lit("\n"))
    block = F.when(n % 11 == 0, "a: b: c\n").when(n % 7 == 0, "- a\n- list\n").otherwise(fields)
    raw = F.when(n % 13 == 0, F.col("text")).otherwise(F.concat(F.lit("---\n"), block, F.lit("---\n"), F.col("text")))
    files = documents(spark, sf).select("doc_ord", F.regexp_replace("path", "txt$", "md").alias("path"), raw.alias("raw"))
    rows = corpus.concepts(files)
    return rows.select("doc_ord", "type", "title", "description", F.array_join("tags", ",").alias("tags"), F.array_join("present", ",").alias("present"), F.md5("body").alias("body_md5"))


def text_pieces(spark: SparkSession, sf: str) -> DataFrame:
    rows = documents(spark, sf).select("doc_ord", F.posexplode(corpus.text_pieces(F.col("text"), 500)).alias("piece", "part"))
    return rows.select("doc_ord", F.col("piece").cast("long").alias("piece"), F.md5("part").alias("part_md5"))


def clamp_spans(spark: SparkSession, sf: str) -> DataFrame:
    n = F.size(T.lines(F.col("text")))
    low, high = T.clamp((F.col("doc_ord") % 9 - 2).cast("int"), (F.col("doc_ord") % 5 * 3 - 1).cast("int"), n)
    return documents(spark, sf).select("doc_ord", low.cast("long").alias("start_line"), high.cast("long").alias("end_line"))


def lenient_booleans(spark: SparkSession, sf: str) -> DataFrame:
    said = F.element_at(F.array(*map(F.lit, ("1", " TRUE", "yes ", "Y", "no", "0", "", "on"))), (F.col("turn") + F.char_length("text")).cast("int") % 8 + 1)
    return read(spark, sf, "conversations").select("conv_id", "turn", T.lenient_bool(F.when(F.col("role") == "user", said)).alias("value"))


def json_objects(spark: SparkSession, sf: str) -> DataFrame:
    """The first JSON object of answers with prose, fences and broken braces around it."""
    spark_rows = read(spark, sf, "conversations")
    inner = F.to_json(F.struct(F.col("turn").alias("turn"), F.col("text").alias("text"), F.struct(F.lit("}").alias("brace")).alias("deep")))
    answer = F.when(F.col("turn") % 4 == 3, F.concat(F.lit("no {object here} "), F.col("text"))).otherwise(F.concat(F.lit("Well, {so: it is\n```json\n"), inner, F.lit("\n``` and {\"later\": 1}")))
    found = F.from_json(agents.json_object(answer), "turn bigint, text string, deep struct<brace:string>")
    return spark_rows.select("conv_id", F.col("turn").alias("asked"), found.alias("j")).select("conv_id", "asked", F.col("j.turn").alias("turn"), F.md5("j.text").alias("text_md5"), F.col("j.deep.brace").alias("brace"))


def _tree_indexes(spark: SparkSession, sf: str) -> DataFrame:
    """An index of each directory that has files or directories, which links to those whose name's number is not divisible by three."""
    edges = corpus.edges(documents(spark, sf))
    name = T.basename(F.col("child"))
    line = F.concat(F.lit("* ["), name, F.lit("]("), name, F.when(F.col("kind") == "dir", "/").otherwise(""), F.lit(") — about "), "child")
    linked = F.when(F.col("ord") % 3 != 0, F.struct("ord", line.alias("line")))
    return edges.groupBy(F.col("parent").alias("path")).agg(F.concat(F.lit("# Index\n\n"), F.array_join(F.transform(F.array_sort(F.collect_list(linked)), lambda x: x["line"]), "\n")).alias("text"))


def child_summaries(spark: SparkSession, sf: str) -> DataFrame:
    edges = corpus.edges(documents(spark, sf))
    return routing.child_summaries(edges.select("parent", "child"), _tree_indexes(spark, sf))


def route_options(spark: SparkSession, sf: str) -> DataFrame:
    edges = corpus.edges(documents(spark, sf))
    return routing.route_options(edges.select("parent", "child", "kind"), edges, _tree_indexes(spark, sf)).select("parent", "child", "option")


def section_options(spark: SparkSession, sf: str) -> DataFrame:
    rows = corpus.sections(documents(spark, sf).withColumn("path", F.regexp_replace("path", "txt$", "md")).withColumn("text", F.concat(F.lit("lead\n# Part\n"), "text")), "text", ("doc_ord",) + ("path",))
    name = F.col("doc_ord").cast("string")
    option = routing.section_option(F.col("heading"), F.col("text"), F.col("start_line"), name, F.lit("described"), F.when(F.col("doc_ord") % 2 == 0, "there"), F.lit("where the train"))
    return rows.filter("sec_no < 2").select("doc_ord", F.col("sec_no").cast("long").alias("sec_no"), F.md5(option).alias("option_md5"))


def match_children(spark: SparkSession, sf: str) -> DataFrame:
    """Answers that name a child by its path, by its name, by a name that it does not have."""
    edges = corpus.edges(documents(spark, sf))
    said = F.when(F.col("ord") % 3 == 0, F.concat(F.lit(" /"), "child", F.lit("/ "))).when(F.col("ord") % 3 == 1, T.basename(F.col("child"))).otherwise(F.concat(F.lit("not "), "child"))
    answers = edges.select(F.col("child").alias("id"), "parent", said.alias("returned"))
    return routing.match_children(answers, edges).select("id", "parent", "child")


def option_batches(spark: SparkSession, sf: str) -> DataFrame:
    edges = corpus.edges(documents(spark, sf)).withColumn("option", F.col("child"))
    return routing.option_batches(edges, 20, 10_000, F.lit(30), "parent").select("parent", "child", F.col("batch").cast("long").alias("batch"))


def named_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Answers of a peer that name a document after a label, without its suffix, in the text, or not at all."""
    docs = documents(spark, sf).withColumn("path", F.regexp_replace("path", "txt$", "md"))
    bare = F.regexp_replace("path", r"\.md$", "")
    n = F.col("doc_ord")
    said = F.when(n % 4 == 0, F.concat(F.lit("AT: "), "path", F.lit("."))).when(n % 4 == 1, F.concat(F.lit("AT: "), bare)).when(n % 4 == 2, F.concat(F.lit("AT: lost; see ("), "path", F.lit(")"))).otherwise(F.lit("AT: nowhere"))
    found = routing.named_paths(docs.select(n.alias("id"), said.alias("text")), docs.select("path", n.alias("ord")), "AT")
    return found.select("id", "path")


def fixture_gold(spark: SparkSession, sf: str) -> DataFrame:
    """Question files with comments and blank lines, written and read back."""
    q = read(spark, sf, "benchmark")
    gold = F.array(*[F.struct(F.concat(F.lit(f"p{i}/"), (F.col("item_id") % 5).cast("string")).alias("path"), (F.col("item_id") % 7 + i).cast("int").alias("start_line"), (F.col("item_id") % 7 + 9).cast("int").alias("end_line")) for i in (1, 2)])
    line = F.to_json(F.struct(F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("id"), F.col("text").alias("query"), gold.alias("gold")))
    path = f"{shared_folder(spark)}/fixtures-{id(q)}"
    q.select(F.concat(F.lit("# "), (F.col("item_id")).cast("string"), F.lit("\n\n  "), line).alias("value")).write.mode("overwrite").text(path)
    return fixtures.load_gold(spark, path).select("query_id", "path", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"))


def fixture_problems(spark: SparkSession, sf: str) -> DataFrame:
    q = read(spark, sf, "benchmark")
    n = F.col("item_id")
    gold = F.array(F.struct(F.when(n % 5 == 0, "lost.md").otherwise("known.md").alias("path"), (n % 3).cast("int").alias("start_line"), (n % 4 * 10).cast("int").alias("end_line")))
    rows = q.select(F.concat(F.lit("q"), F.floor(n / 2).cast("string")).alias("id"), F.when(n % 7 == 0, " ").otherwise(F.col("text")).alias("query"), F.when(n % 6 != 0, gold).alias("gold"))
    return metrics.check_gold(rows, spark.createDataFrame([("known.md", 20)], "path string, n_lines int")).select("query_id", "problem")


def sidecar_docs(spark: SparkSession, sf: str) -> DataFrame:
    """The persisted retrieval documents of a tree, and whether they are fresh afterwards."""
    tree = documents(spark, sf).select("path", F.lit("file").alias("kind"), F.col("text").alias("raw"))
    target = f"{shared_folder(spark)}/sidecar-{id(tree)}"
    sidecar.build(spark, tree, target)
    again = sidecar.build(spark, tree, target)
    meta = sidecar.read_meta(spark, target)
    return sidecar.read_docs(spark, target).select("id", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), "heading", F.md5("text").alias("text_md5"), F.lit(again).alias("written_again"), F.lit(bool(meta.vectors)).alias("vectors"))


def _said(system: str, prompt: str) -> str:
    return "It  answers\n what is asked. "


def prepared_indexes(spark: SparkSession, sf: str) -> DataFrame:
    """Indexes written from the leaves to the root by a model that always says the same; one in five files is no text."""
    n = F.col("doc_ord")
    tree = documents(spark, sf).select("path", F.lit("file").alias("kind"), F.when(n % 5 != 0, F.when(n % 6 == 0, "").otherwise(F.col("text"))).alias("raw"))
    return author.prepare(tree, lambda: _said, "top").select("dir", F.md5("content").alias("content_md5"), "written")


def answer_spans(spark: SparkSession, sf: str) -> DataFrame:
    """The valid spans of each run's last answer."""
    rows = read(spark, sf, "conversations")
    n = F.col("turn").cast("int")
    span = lambda path, a, b: F.struct(path.alias("path"), a.cast("int").alias("start_line"), b.cast("int").alias("end_line"))
    spans = F.array(span(F.lit("./a.md"), n, n + 4), span(F.lit("lost.md"), n, n), span(F.lit("b.md"), n - 1, n), span(F.lit("a.md"), n, n + 4))
    text = F.concat(F.lit("Found: "), F.to_json(F.struct(spans.alias("spans"))))
    message = F.struct(F.when(F.col("conv_id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.array(F.struct(F.lit("text").alias("type"), text.alias("text"))).alias("content"))
    lines = rows.select(F.col("conv_id").alias("run_id"), F.col("turn").alias("seq"), F.to_json(F.struct(F.lit("message_end").alias("type"), message.alias("message"))).alias("line"))
    files = spark.createDataFrame([("a.md", 9), ("b.md", 3)], "path string, n_lines int")
    return agents.answer_spans(lines, files, 3).select("run_id", F.col("rank").cast("long").alias("rank"), "path", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"))


def run_costs(spark: SparkSession, sf: str) -> DataFrame:
    """Usage of all calls of a run, and its cost by a price list."""
    rows = read(spark, sf, "conversations")
    size = F.char_length("text").cast("long")
    usage = rows.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("seq"), F.lit(1).alias("calls"), size.alias("input_tokens"), (size % 50).alias("output_tokens"), F.when(F.col("turn") % 3 != 2, F.concat(F.lit("m"), (F.col("conv_id") % 3).cast("string"))).alias("model"))
    prices = spark.createDataFrame([("m0", 1.0, 4.0), ("m1", 0.5, 2.0)], "model string, usd_in double, usd_out double")
    out = models.cost(models.total_usage(usage), prices)
    return out.select("query_id", F.col("calls").cast("long").alias("calls"), F.col("input_tokens").cast("long").alias("input_tokens"), F.col("output_tokens").cast("long").alias("output_tokens"), "model", F.round("cost_usd", 9).alias("cost_usd"))


def reranked_list(spark: SparkSession, sf: str) -> DataFrame:
    """A list that a model turns round, naming one twice and one that is not there."""
    docs = documents(spark, sf).withColumn("query_id", F.col("doc_ord") % 10).withColumn("rank", F.floor(F.col("doc_ord") / 10).cast("int") + 1).filter("rank <= 6")
    hits = docs.select("query_id", F.lit("q").alias("query"), "rank", "path", "text")

    def turned(system: str, user: str) -> str:
        n = len(json.loads(user)["candidates"])
        return json.dumps({"order": [*range(n - 1, -1, -1), 0, n + 5]})

    return models.listwise(hits, lambda: turned, 4).select("query_id", F.col("rank").cast("long").alias("rank"), "path", F.col("base_rank").cast("long").alias("base_rank"))


def _judge(question, wanted, answer):
    """A mark from the share of the answer's size: a stand-in that both engines can compute."""
    return (F.char_length(F.concat(wanted, answer)) % 5 + 1).cast("int")


def judged_answers(spark: SparkSession, sf: str) -> DataFrame:
    q = questions(spark, sf)
    answers = q.filter("query_id % 3 <> 0").select("query_id", "query", F.substring("query", 1, 20).alias("answer"))
    return metrics.judged(answers, q.filter("query_id % 4 <> 0").select("query_id", F.substring("query", 5, 30).alias("wanted")), _judge)


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("item_id")
    return read(spark, sf, "benchmark").select(
        n.alias("query_id"), F.when(n % 9 == 0, "failed").alias("error"), F.when(n % 2 == 0, (n % 5 / 4)).alias("answer_score"), (n % 3 / 2).alias("file_recall"), (n % 4 / 3).alias("span_recall"), (n % 6).alias("candidate_files"), (n * 10).alias("context_chars"),
        (n % 7).alias("model_calls"), (n * 3).alias("input_tokens"), (n * 2).alias("output_tokens"), (n % 50).cast("double").alias("latency_ms"), (n * 0.01).alias("cost_usd"), F.lit(2).alias("answer_calls"), n.alias("answer_input_tokens"), (n + 1).alias("answer_output_tokens"), (n * 0.001).alias("judge_cost_usd"))


def hybrid_means(spark: SparkSession, sf: str) -> DataFrame:
    out = metrics.hybrid_means(_rows(spark, sf))
    return out.select("questions", *[F.round(c, 6).alias(c) for c in out.columns if c != "questions"])


def run_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Each question's metrics with the statistics of its run, if there was one."""
    rows = _rows(spark, sf)
    out = metrics.with_runs(rows.select("query_id", "span_recall"), rows.filter("error is null").select("query_id", *metrics.RUN))
    return out.select("query_id", F.round("span_recall", 6).alias("span_recall"), *[F.round(F.col(c).cast("double"), 6).alias(c) for c in metrics.RUN])


def strategy_order(spark: SparkSession, sf: str) -> DataFrame:
    rows = _rows(spark, sf).groupBy(F.concat(F.lit("s"), (F.col("query_id") % 8).cast("string")).alias("strategy")).agg(F.avg("span_recall").alias("span_recall"), F.avg("latency_ms").alias("latency_ms"))
    return metrics.in_order(rows).select("strategy", F.col("place").cast("long").alias("place"))


def older_fields(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("item_id")
    rows = read(spark, sf, "benchmark").select("item_id", F.when(n % 3 == 0, n).alias("recall"), F.when(n % 2 == 0, n + 1000).alias("a_recall"))
    return rows.select("item_id", routing.field(rows, "recall", "z_recall", "a_recall"), routing.field(rows, "f1", "a_f1", default=7))


def index_names(spark: SparkSession, sf: str) -> DataFrame:
    """Labels and targets of index lines for names with brackets, blanks and letters beyond ASCII."""
    name = F.concat(F.lit("[x] "), F.substring("text", 1, 12), F.lit(" é\\"))
    return documents(spark, sf).select("doc_ord", author.label(name).alias("label"), author.quoted(F.lit("a b/é[~]").substr(1, 8)).alias("target"))


CFG = walk.WalkConfig(top_k=2, call_budget=8, min_probability=0.5, relative_probability=0.7)


def _score(rows: DataFrame) -> DataFrame:
    key = F.when(F.col("kind") == "section", F.concat("parent", F.lit("#"), "child")).otherwise(F.col("child"))
    return rows.withColumn("score", F.conv(F.substring(F.md5(F.concat(F.col("query_id").cast("string"), F.lit("/"), key)), 1, 4), 16, 10).cast("double") / 65536)


def _section_walk(spark: SparkSession, sf: str):
    docs = documents(spark, sf)
    rows = docs.select("path", F.posexplode(corpus.chunk_array(F.col("text"), 10)).alias("sec_no", "s"), F.size(T.lines(F.col("text"))).alias("n_lines"))
    secs = rows.select("path", "sec_no", "s.start_line", "s.end_line", F.when(F.col("sec_no") == 0, "(preamble)").otherwise(F.col("s.heading")).alias("heading"), "n_lines", F.col("s.heading").alias("option"))
    return walk.tree_decision(corpus.edges(docs), lambda pairs: pairs.withColumn("option", F.col("child")), secs, questions(spark, sf), _score, CFG)


def section_walk(spark: SparkSession, sf: str) -> DataFrame:
    """The best-first walk down to sections: thresholds, whole files for preambles, requests and budget."""
    spans, _ = _section_walk(spark, sf)
    return spans.select("query_id", F.col("rank").cast("long").alias("rank"), "path", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"))


QUERIES = {f.__name__: f for f in (text_guard, corpus_scan, frontmatter_concepts, text_pieces, clamp_spans, lenient_booleans, json_objects, child_summaries, route_options, section_options, match_children, option_batches, named_paths, fixture_gold, fixture_problems, sidecar_docs,
                                   prepared_indexes, answer_spans, run_costs, reranked_list, judged_answers, hybrid_means, run_metrics, strategy_order, older_fields, section_walk)}

_L = "regexp_extract_all({0}, '[^\\n]*\\n|[^\\n]+')"
_INDEX = f"""WITH {DOCUMENTS}, {_EDGES.format('docs')}, named AS (SELECT *, regexp_extract(child, '([^/]*)$', 1) AS name FROM edges),
said AS (SELECT *, CASE WHEN ord % 3 <> 0 THEN '* [' || name || '](' || name || CASE WHEN kind = 'dir' THEN '/' ELSE '' END || ') — about ' || child ELSE name END AS summary FROM named)"""
_ROWS = """rows AS (SELECT item_id AS query_id, CASE WHEN item_id % 9 = 0 THEN 'failed' END AS error, CASE WHEN item_id % 2 = 0 THEN item_id % 5 / 4.0::DOUBLE END AS answer_score, item_id % 3 / 2.0::DOUBLE AS file_recall, item_id % 4 / 3.0::DOUBLE AS span_recall, item_id % 6 AS candidate_files, item_id * 10 AS context_chars,
item_id % 7 AS model_calls, item_id * 3 AS input_tokens, item_id * 2 AS output_tokens, CAST(item_id % 50 AS DOUBLE) AS latency_ms, item_id * 0.01::DOUBLE AS cost_usd, 2 AS answer_calls, item_id AS answer_input_tokens, item_id + 1 AS answer_output_tokens, item_id * 0.001::DOUBLE AS judge_cost_usd FROM benchmark)"""
_MEANS = {"file_recall": "file_recall", "span_coverage": "span_recall", "candidate_files": "candidate_files", "context_chars": "context_chars", "latency_ms": "latency_ms", "retrieval_model_calls": "model_calls", "retrieval_input_tokens": "input_tokens", "retrieval_output_tokens": "output_tokens", "cost_usd": "cost_usd"}
_SENTENCE = "It answers what is asked."
_LIST = "string_agg('- [' || name || '](' || name || '{0}) — ' || CASE WHEN blank THEN 'Empty file.' ELSE '" + _SENTENCE + "' END, chr(10) ORDER BY name)"

ORACLE_SQL = {
    "text_guard": f"WITH {DOCUMENTS} SELECT doc_ord, CASE WHEN doc_ord % 5 <> 0 AND doc_ord % 7 <> 0 THEN md5(replace(text, ' a ', chr(10) || 'a' || chr(10))) END AS text_md5 FROM docs",
    "corpus_scan": f"WITH {DOCUMENTS} SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, path, row_number() OVER (PARTITION BY regexp_extract(path, '^(.*)/[^/]*$', 1) ORDER BY regexp_extract(path, '([^/]*)$', 1)) AS place FROM docs",
    "frontmatter_concepts": f"""WITH {DOCUMENTS}, k AS (SELECT *, doc_ord % 13 <> 0 AND (doc_ord % 11 = 0) AS broken, doc_ord % 13 <> 0 AND doc_ord % 11 <> 0 AND doc_ord % 7 = 0 AS listed, doc_ord % 13 <> 0 AND doc_ord % 11 <> 0 AND doc_ord % 7 <> 0 AS good FROM docs)
SELECT doc_ord, CASE WHEN good THEN 'note' ELSE '' END AS type, CASE WHEN good AND doc_ord % 3 <> 0 THEN 'Title ' || doc_ord ELSE CAST(doc_ord AS VARCHAR) END AS title, CASE WHEN good THEN 'About ' || doc_ord ELSE '' END AS description,
  CASE WHEN good AND doc_ord % 2 = 0 THEN 'a,b' WHEN good THEN 'single' ELSE '' END AS tags, CASE WHEN good THEN 'description,tags' || CASE WHEN doc_ord % 3 <> 0 THEN ',title' ELSE '' END || ',type' END AS present,
  md5(CASE WHEN broken THEN '---' || chr(10) || 'a: b: c' || chr(10) || '---' || chr(10) || text WHEN listed THEN '---' || chr(10) || '- a' || chr(10) || '- list' || chr(10) || '---' || chr(10) || text ELSE text END) AS body_md5 FROM k""",
    "text_pieces": f"""WITH RECURSIVE {DOCUMENTS}, cut AS (SELECT doc_ord, CAST(-1 AS BIGINT) AS piece, '' AS part, text AS rest FROM docs
  UNION ALL SELECT doc_ord, piece + 1, CASE WHEN length(rest) < 500 THEN rest ELSE substring(rest, 1, size) END, CASE WHEN length(rest) < 500 THEN '' ELSE substring(rest, size + 1) END
  FROM (SELECT *, CASE WHEN 501 - brk > 250 THEN 501 - brk ELSE 500 END AS size FROM (SELECT *, least(coalesce(nullif(instr(reverse(substring(rest, 1, 500)), ' '), 0), 501), coalesce(nullif(instr(reverse(substring(rest, 1, 500)), chr(10)), 0), 501)) AS brk FROM cut WHERE rest <> '')))
SELECT doc_ord, piece, md5(part) AS part_md5 FROM cut WHERE piece >= 0""",
    "clamp_spans": f"WITH {DOCUMENTS}, s AS (SELECT doc_ord, greatest(len({_L.format('text')}), 1) AS n, doc_ord % 9 - 2 AS a, doc_ord % 5 * 3 - 1 AS b FROM docs) SELECT doc_ord, greatest(1, least(a, n)) AS start_line, greatest(greatest(1, least(a, n)), least(b, n)) AS end_line FROM s",
    "lenient_booleans": "SELECT conv_id, turn, role = 'user' AND (turn + length(text)) % 8 < 4 AS value FROM conversations",
    "json_objects": "SELECT conv_id, turn AS asked, CASE WHEN turn % 4 <> 3 THEN turn END AS turn, CASE WHEN turn % 4 <> 3 THEN md5(text) END AS text_md5, CASE WHEN turn % 4 <> 3 THEN '}' END AS brace FROM conversations",
    "child_summaries": f"{_INDEX} SELECT parent, child, summary FROM said",
    "route_options": f"""{_INDEX}, below AS (SELECT a.child AS dir, b.child AS thing, 1 AS depth, [b.ord] AS way FROM edges a JOIN edges b ON b.parent = a.child WHERE a.kind = 'dir'
  UNION ALL SELECT a.child, c.child, 2, [b.ord, c.ord] FROM edges a JOIN edges b ON b.parent = a.child JOIN edges c ON c.parent = b.child WHERE a.kind = 'dir'
  UNION ALL SELECT a.child, d.child, 3, [b.ord, c.ord, d.ord] FROM edges a JOIN edges b ON b.parent = a.child JOIN edges c ON c.parent = b.child JOIN edges d ON d.parent = c.child WHERE a.kind = 'dir'),
t AS (SELECT dir, string_agg(regexp_replace(regexp_extract(thing, '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1'), ', ' ORDER BY depth, way) AS topics FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY depth, way) AS n FROM below) WHERE n <= 12 GROUP BY dir)
SELECT parent, child, child || ': ' || summary || CASE WHEN kind = 'dir' THEN '; subtopics: ' || coalesce(topics, '') ELSE '' END AS option FROM said LEFT JOIN t ON dir = child""",
    "section_options": f"""WITH {DOCUMENTS}, s AS (SELECT doc_ord, '# Part' || chr(10) || text AS text, string_split('# Part' || chr(10) || text, chr(10)) AS l FROM docs),
m AS (SELECT doc_ord, text, [x.s for x in list_filter([{{'s': 'L' || CAST(i + 1 AS VARCHAR) || ': ' || l[i], 'l': lower(l[i])}} for i in range(1, len(l) + 1)], lambda x: contains(x.l, 'train'))] AS m FROM s)
SELECT doc_ord, 0 AS sec_no, md5('Metadata for ' || doc_ord || ': described' || CASE WHEN doc_ord % 2 = 0 THEN '; resource URL: there' ELSE '' END) AS option_md5 FROM docs
UNION ALL SELECT doc_ord, 1, md5('Part: ' || substring(CASE WHEN length(text) <= 2400 OR len(m) = 0 THEN substring(text, 1, 2400) ELSE substring(text, 1, 400) || chr(10) || '...' || chr(10) || array_to_string(m, chr(10)) END, 1, 650)) FROM m""",
    "match_children": f"{_INDEX} SELECT child AS id, parent, CASE WHEN ord % 3 <> 2 THEN child END AS child FROM edges",
    "option_batches": f"""WITH RECURSIVE {DOCUMENTS}, {_EDGES.format('docs')}, r AS (SELECT parent, child, ord, CAST(0 AS BIGINT) AS batch, 1 AS n, 30 + length(child) AS size FROM edges WHERE ord = 1
  UNION ALL SELECT e.parent, e.child, e.ord, r.batch + CASE WHEN r.n = 20 OR r.size + length(e.child) > 10000 THEN 1 ELSE 0 END, CASE WHEN r.n = 20 OR r.size + length(e.child) > 10000 THEN 1 ELSE r.n + 1 END, CASE WHEN r.n = 20 OR r.size + length(e.child) > 10000 THEN 30 ELSE r.size END + length(e.child) FROM r JOIN edges e ON e.parent = r.parent AND e.ord = r.ord + 1)
SELECT parent, child, batch FROM r""",
    "named_paths": f"WITH {DOCUMENTS} SELECT doc_ord AS id, CASE WHEN doc_ord % 4 < 3 THEN regexp_replace(path, 'txt$', 'md') END AS path FROM docs",
    "fixture_gold": "SELECT 'q' || item_id AS query_id, 'p' || i || '/' || (item_id % 5) AS path, item_id % 7 + i AS start_line, item_id % 7 + 9 AS end_line FROM benchmark, (SELECT unnest([1, 2]) AS i)",
    "fixture_problems": """WITH f AS (SELECT 'q' || (item_id // 2) AS id, item_id AS n, text FROM benchmark)
SELECT id AS query_id, 'id missing or repeated' AS problem FROM f GROUP BY id HAVING count(*) > 1
UNION ALL SELECT id, 'no question' FROM f WHERE n % 7 = 0 OR trim(text) = '' UNION ALL SELECT id, 'no gold' FROM f WHERE n % 6 = 0
UNION ALL SELECT id, 'unknown file: lost.md' FROM f WHERE n % 6 <> 0 AND n % 5 = 0
UNION ALL SELECT id, 'lines outside known.md' FROM f WHERE n % 6 <> 0 AND n % 5 <> 0 AND NOT (1 <= n % 3 AND n % 3 <= n % 4 * 10 AND n % 4 * 10 <= 20)""",
    "sidecar_docs": f"""WITH {DOCUMENTS}, l AS (SELECT path, text, {_L.format('text')} AS l, regexp_extract(path, '([0-9]+)\\.txt$', 1) AS title FROM docs),
s AS (SELECT path, title, l, unnest(range(0, (len(l) + 79) // 80)) AS k FROM l)
SELECT path || '#-1' AS id, 1 AS start_line, greatest(1, len(l)) AS end_line, '(concept)' AS heading, md5(path || chr(10) || title || chr(10) || substring(text, 1, 2000)) AS text_md5, false AS written_again, false AS vectors FROM l
UNION ALL SELECT path || '#' || k, k * 80 + 1, least(k * 80 + 80, len(l)), 'Lines ' || (k * 80 + 1) || '–' || least(k * 80 + 80, len(l)), md5(title || chr(10) || chr(10) || 'Lines ' || (k * 80 + 1) || '–' || least(k * 80 + 80, len(l)) || chr(10) || array_to_string(l[k * 80 + 1 : k * 80 + 80], '')), false, false FROM s""",
    "prepared_indexes": f"""WITH {DOCUMENTS}, {_EDGES.format('docs')}, named AS (SELECT e.parent, regexp_extract(child, '([^/]*)$', 1) AS name, kind, doc_ord % 5 = 0 AS skipped, coalesce(doc_ord % 5 <> 0 AND (doc_ord % 6 = 0 OR text = ''), false) AS blank FROM edges e LEFT JOIN docs ON path = child),
b AS (SELECT parent, {_LIST.format('/')} FILTER (WHERE kind = 'dir') AS d, {_LIST.format('')} FILTER (WHERE kind = 'file' AND NOT skipped) AS f, string_agg('- `' || name || '` — binary or non-UTF-8; contents were not summarized.', chr(10) ORDER BY name) FILTER (WHERE kind = 'file' AND skipped) AS s FROM named GROUP BY parent)
SELECT parent AS dir, md5('# ' || CASE WHEN parent = '' THEN 'top' ELSE regexp_extract(parent, '([^/]*)$', 1) END || coalesce(chr(10) || chr(10) || '## Directories' || chr(10) || chr(10) || d, '') || coalesce(chr(10) || chr(10) || '## Files' || chr(10) || chr(10) || f, '') || coalesce(chr(10) || chr(10) || '## Skipped files' || chr(10) || chr(10) || s, '') || chr(10)) AS content_md5, true AS written FROM b""",
    "answer_spans": """WITH last AS (SELECT conv_id, max(turn) AS n FROM conversations WHERE conv_id % 3 <> 0 GROUP BY 1),
s AS (SELECT conv_id AS run_id, 0 AS pos, 'a.md' AS path, n AS start_line, n + 4 AS end_line FROM last WHERE n >= 1 AND n + 4 <= 9 UNION ALL SELECT conv_id, 2, 'b.md', n - 1, n FROM last WHERE n - 1 >= 1 AND n <= 3)
SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY pos) AS rank, path, start_line, end_line FROM s""",
    "run_costs": """WITH u AS (SELECT conv_id AS query_id, count(*) AS calls, CAST(sum(length(text)) AS BIGINT) AS input_tokens, CAST(sum(length(text) % 50) AS BIGINT) AS output_tokens, CASE WHEN bool_or(turn % 3 <> 2) THEN 'm' || (conv_id % 3) END AS model FROM conversations GROUP BY conv_id)
SELECT *, round(CASE model WHEN 'm0' THEN (input_tokens * 1.0::DOUBLE + output_tokens * 4.0::DOUBLE) / 1e6 WHEN 'm1' THEN (input_tokens * 0.5::DOUBLE + output_tokens * 2.0::DOUBLE) / 1e6 ELSE 0.0 END, 9) AS cost_usd FROM u""",
    "reranked_list": f"""WITH {DOCUMENTS}, h AS (SELECT doc_ord % 10 AS query_id, doc_ord // 10 + 1 AS base_rank, path FROM docs WHERE doc_ord // 10 + 1 <= 6)
SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY base_rank DESC) AS rank, path, base_rank FROM h) WHERE rank <= 4""",
    "judged_answers": f"WITH {QUESTIONS} SELECT query_id, CAST(length(substring(query, 5, 30) || substring(query, 1, 20)) % 5 AS DOUBLE) / 4 AS answer_score FROM questions WHERE query_id % 3 <> 0 AND query_id % 4 <> 0",
    "hybrid_means": f"""WITH {_ROWS} SELECT count(*) FILTER (WHERE error IS NULL) AS questions, {', '.join(f'round(avg({c}) FILTER (WHERE error IS NULL), 6) AS {n}' for n, c in _MEANS.items())}, round(avg(answer_score), 6) AS answer_score,
  {', '.join(f'round(avg({c} + answer_{m}) FILTER (WHERE answer_score IS NOT NULL), 6) AS {c}' for c, m in (('model_calls', 'calls'), ('input_tokens', 'input_tokens'), ('output_tokens', 'output_tokens')))}, round(avg(judge_cost_usd) FILTER (WHERE answer_score IS NOT NULL), 6) AS judge_cost_usd FROM rows""",
    "run_metrics": f"WITH {_ROWS} SELECT query_id, round(span_recall, 6) AS span_recall, {', '.join(f'CASE WHEN error IS NULL THEN round(CAST({c} AS DOUBLE), 6) ELSE 0.0 END AS {c}' for c in metrics.RUN)} FROM rows",
    "strategy_order": f"WITH {_ROWS}, s AS (SELECT 's' || (query_id % 8) AS strategy, round(avg(span_recall), 9) AS r, round(avg(latency_ms), 9) AS l FROM rows GROUP BY 1) SELECT strategy, row_number() OVER (ORDER BY r DESC, l, strategy) AS place FROM s",
    "older_fields": "SELECT item_id, coalesce(CASE WHEN item_id % 3 = 0 THEN item_id END, CASE WHEN item_id % 2 = 0 THEN item_id + 1000 END, 0) AS recall, 7 AS f1 FROM benchmark",
}

_HASH = "CAST(CAST('0x' || substring(md5(CAST(query_id AS VARCHAR) || '/' || {0}), 1, 4) AS INTEGER) AS DOUBLE) / 65536"
ORACLE_SQL["section_walk"] = f"""WITH RECURSIVE {DOCUMENTS}, {QUESTIONS}, {_EDGES.format('docs')},
score AS (SELECT query_id, e.*, {_HASH.format('child')} AS score, count(*) OVER (PARTITION BY query_id, parent) AS n FROM questions, edges e),
passed AS (SELECT *, row_number() OVER (PARTITION BY query_id, parent ORDER BY round(score, 9) DESC, ord DESC) AS r FROM (SELECT *, max(score) OVER (PARTITION BY query_id, parent) AS best FROM score) WHERE n = 1 OR score >= greatest({CFG.min_probability}, best * {CFG.relative_probability})),
reach AS (SELECT query_id, '' AS path, 'dir' AS kind, CAST([] AS BIGINT[]) AS key FROM questions UNION ALL SELECT p.query_id, p.child, p.kind, list_append(w.key, p.r) FROM reach w JOIN passed p ON p.query_id = w.query_id AND p.parent = w.path WHERE w.kind = 'dir'),
kids AS (SELECT parent AS path, count(*) AS c FROM edges GROUP BY 1), l AS (SELECT path, {_L.format('text')} AS l FROM docs),
secs AS (SELECT path, k, k * 10 + 1 AS a, least(k * 10 + 10, n) AS b, n FROM (SELECT path, len(l) AS n, unnest(range(0, (len(l) + 9) // 10)) AS k FROM l)),
files AS (SELECT query_id, path, arg_max(k, (round(s, 9), -k)) AS k, max(s) AS s FROM (SELECT query_id, r.path, k, {_HASH.format("r.path || '#' || k")} AS s FROM reach r JOIN secs USING (path)) GROUP BY ALL),
nodes AS (SELECT r.query_id, r.path, key, CASE WHEN kind = 'dir' AND c > 1 THEN CAST(ceil(c / 254.0) AS BIGINT) WHEN f.k IS NOT NULL THEN 1 ELSE 0 END AS calls, CASE WHEN f.s >= 0.12 THEN 1 ELSE 0 END AS emits, CASE WHEN f.k = 0 THEN 1 ELSE secs.a END AS start_line, CASE WHEN f.k = 0 THEN secs.n ELSE secs.b END AS end_line
  FROM reach r LEFT JOIN kids USING (path) LEFT JOIN files f ON f.query_id = r.query_id AND f.path = r.path LEFT JOIN secs ON secs.path = r.path AND secs.k = f.k),
sums AS (SELECT *, coalesce(sum(emits) OVER b, 0) AS sb, coalesce(sum(calls) OVER b, 0) AS cb FROM nodes WINDOW b AS (PARTITION BY query_id ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cuts AS (SELECT *, max(CASE WHEN sb >= {CFG.top_k} OR cb >= {CFG.call_budget} OR calls > {CFG.call_budget} - cb THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY key) AS stops FROM sums)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY key) AS rank, path, start_line, end_line FROM cuts WHERE stops = 0 AND emits = 1"""  # fmt: skip
