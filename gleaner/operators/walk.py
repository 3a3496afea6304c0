"""Guided walks over the directory tree, all queries at once, one level at a time.

A scorer is a function that adds ``score`` (0 to 1) to a DataFrame of options: query_id, query,
parent, child, kind, option. Budgets count its calls; a call takes the options of one node, in
batches of at most MAX_OPTIONS options and MAX_CHARS characters.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.shared import cut_lineage

Scorer = Callable[[DataFrame], DataFrame]
#: Limits of one request, of a query in it, and the least score of a section (fixed values).
MAX_OPTIONS, MAX_CHARS, QUERY_CHARS, SECTION_MIN = 254, 48_000, 500, 0.12


@dataclass(frozen=True)
class WalkConfig:
    """top_k spans, call budget, thresholds of a branch (absolute, and relative to the best), levels at most."""

    top_k: int = 2
    call_budget: int = 32
    min_probability: float = 0.12
    relative_probability: float = 0.2
    return_files: bool = False
    max_depth: int = 64


def _calls(sizes, state):
    """Requests that options of these sizes need: a request closes before an option that would overfill it."""
    start = F.struct(F.lit(0).alias("calls"), F.lit(0).alias("n"), state.cast("int").alias("size"))

    def step(acc, size):
        full = (acc["n"] == 0) | (acc["n"] == MAX_OPTIONS) | (acc["size"] + size > MAX_CHARS)
        return F.struct((acc["calls"] + full.cast("int")).alias("calls"), F.when(full, 1).otherwise(acc["n"] + 1).alias("n"), F.when(full, state.cast("int") + size).otherwise(acc["size"] + size).alias("size"))

    return F.aggregate(sizes, start, step)["calls"]


def _node_calls(options: DataFrame, key: str) -> DataFrame:
    state = F.char_length(F.concat(F.lit("User question: "), F.substring("query", 1, QUERY_CHARS)))
    sizes = options.groupBy("query_id", key).agg(F.first("query").alias("query"), F.array_sort(F.collect_list(F.struct("ord", F.char_length("option").alias("size")))).alias("s"))
    return sizes.select("query_id", key, _calls(F.col("s.size"), state).alias("calls"))


def _root(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", "query", F.lit("").alias("path"), F.lit("dir").alias("kind"), F.expr("cast(array() as array<int>)").alias("key"))


_WALKED = "query_id", "path", "key", "calls", "emits", "start_line", "end_line"


def tree_decision(edges: DataFrame, options: Callable[[DataFrame], DataFrame], sections: DataFrame | None, queries: DataFrame, scorer: Scorer, cfg: WalkConfig) -> tuple[DataFrame, DataFrame]:
    """(spans, stats) of the best-first walk.

    edges: parent, child, kind, ord. options(pairs) adds the option text to rows of query_id, query,
    parent, child, kind, ord. sections: path, sec_no, start_line, end_line, heading, n_lines, option;
    files without sections are passed by. spans: query_id, rank, path, start_line, end_line (null
    lines: the whole file). stats: query_id, calls, visited, truncated.

    A node's key lists the rank of each step (a later child is first among equals), so the order of
    the walk is the order of keys. In every wave each question takes its first open node (and the files
    before it that need no score); what the node would cost is known before it is scored, so nothing
    is scored once a question has its spans or beyond its budget. All questions' nodes of a wave are one
    job, and there are about as many waves as nodes that one question scores. What all waves read, the edges
    and the sections, is worked out once.
    """
    edges, sections = cut_lineage(edges), None if cfg.return_files or sections is None else cut_lineage(sections)
    open_ = cut_lineage(_root(queries))
    state = cut_lineage(queries.select("query_id", F.lit(0).cast("long").alias("calls"), F.lit(0).cast("long").alias("spans"), F.lit(0).cast("long").alias("visited"), F.lit(False).alias("truncated")))
    walked: DataFrame | None = None
    whole = cfg.return_files or sections is None
    while True:
        able = state.filter((F.col("spans") < cfg.top_k) & ~F.col("truncated")).select("query_id", F.col("calls").alias("spent"), (cfg.top_k - F.col("spans")).alias("room"))
        now = _next(open_.join(able, "query_id"), whole)
        asked = options(_children(now, edges)).unionByName(_parts(now, sections, cfg), allowMissingColumns=True)
        calls = _node_calls(asked.filter("asks"), "parent").withColumnRenamed("parent", "path")
        priced = now.join(calls, ["query_id", "path"], "left").withColumn("calls", F.coalesce("calls", F.lit(0)).cast("long"))
        now = cut_lineage(priced.withColumn("fits", (F.col("spent") < cfg.call_budget) & (F.col("spent") + F.col("calls") <= cfg.call_budget)))
        if now.isEmpty():
            break
        go = now.filter("fits")
        todo = options(_children(go, edges)).unionByName(_parts(go, sections, cfg), allowMissingColumns=True)
        free = todo.filter(~F.col("asks")).withColumn("score", F.lit(1.0))
        scored = cut_lineage(scorer(todo.filter("asks")).select(*free.columns).unionByName(free))
        done = cut_lineage(_emitted(go, scored.filter("kind = 'section'"), sections, cfg).select(*_WALKED))
        walked = done if walked is None else walked.unionByName(done)
        open_ = cut_lineage(open_.join(now.select("query_id", "path"), ["query_id", "path"], "left_anti").unionByName(_opened(go, scored.filter("kind <> 'section'"), cfg)))
        made = done.groupBy("query_id").agg(F.sum("calls").alias("c"), F.sum("emits").alias("s"), F.count("*").alias("v"))
        ended = now.groupBy("query_id").agg(F.bool_or(~F.col("fits")).alias("t"))
        state = cut_lineage(state.join(made, "query_id", "left").join(ended, "query_id", "left").select(
            "query_id", *[(F.col(x) + F.coalesce(y, F.lit(0))).alias(x) for x, y in (("calls", "c"), ("spans", "s"), ("visited", "v"))], (F.col("truncated") | F.coalesce("t", F.lit(False))).alias("truncated")))
    upto = Window.partitionBy("query_id").orderBy("key")
    if walked is None:
        walked = queries.limit(0).select("query_id", F.lit("").alias("path"), F.expr("cast(array() as array<int>)").alias("key"), *[F.lit(0).alias(c) for c in _WALKED[3:]])
    spans = walked.filter("emits = 1").withColumn("rank", F.row_number().over(upto)).select("query_id", "rank", "path", "start_line", "end_line")
    return spans, state.select("query_id", "calls", "visited", "truncated")


def _next(open_: DataFrame, whole: bool) -> DataFrame:
    """The nodes of a wave: each question's first one in the order of keys. Whole files cost nothing, so
    those that come first go together with the directory after them, as far as there is room for spans."""
    before = Window.partitionBy("query_id").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    priced = F.lit(True) if not whole else F.col("kind") == "dir"
    rows = open_.withColumn("_priced", F.coalesce(F.sum(priced.cast("int")).over(before), F.lit(0))).withColumn("_n", F.coalesce(F.count("*").over(before), F.lit(0)))
    return rows.filter((F.col("_priced") == 0) & (F.col("_n") < F.col("room"))).drop("_priced", "_n")


def _children(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A directory's children; asks: there are several, so that they are scored."""
    pairs = nodes.filter("kind = 'dir'").select("query_id", "query", F.col("path").alias("parent")).join(edges, "parent")
    return pairs.withColumn("asks", F.count("*").over(Window.partitionBy("query_id", "parent")) > 1)


def _parts(nodes: DataFrame, sections: DataFrame | None, cfg: WalkConfig) -> DataFrame:
    """A file's sections, unless whole files are asked for."""
    files = nodes.filter("kind = 'file'").select("query_id", "query", "path")
    if cfg.return_files or sections is None:
        return files.limit(0).select("query_id", "query", F.col("path").alias("parent"), F.lit("").alias("child"), F.lit("section").alias("kind"), F.lit(0).alias("ord"), F.lit("").alias("option"), F.lit(True).alias("asks"))
    return files.join(sections, "path").select("query_id", "query", F.col("path").alias("parent"), F.col("sec_no").cast("string").alias("child"), F.lit("section").alias("kind"), F.col("sec_no").alias("ord"), "option", F.lit(True).alias("asks"))


def _opened(nodes: DataFrame, scored: DataFrame, cfg: WalkConfig) -> DataFrame:
    """Children that pass their node's threshold, with their keys."""
    w = Window.partitionBy("query_id", "parent")
    least = F.greatest(F.lit(cfg.min_probability), F.max("score").over(w) * cfg.relative_probability)
    passed = scored.withColumn("least", least).filter(~F.col("asks") | (F.col("score") >= F.col("least")))
    ranked = passed.withColumn("r", F.row_number().over(w.orderBy(F.desc(F.round("score", 9)), F.desc("ord"))))
    keys = nodes.select("query_id", F.col("path").alias("parent"), "key")
    return ranked.join(keys, ["query_id", "parent"]).select("query_id", "query", F.col("child").alias("path"), "kind", F.array_append("key", F.col("r")).alias("key"))


def _emitted(nodes: DataFrame, scored: DataFrame, sections: DataFrame | None, cfg: WalkConfig) -> DataFrame:
    """The walked nodes; a file emits itself or its best section, of a preamble the whole file."""
    if cfg.return_files or sections is None:
        nothing = F.lit(None).cast("int")
        return nodes.select("query_id", "path", "key", "calls", (F.col("kind") == "file").cast("int").alias("emits"), nothing.alias("start_line"), nothing.alias("end_line"))
    best = scored.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "parent").orderBy(F.desc(F.round("score", 9)), "ord"))).filter("_n = 1")
    best = best.select("query_id", F.col("parent").alias("path"), F.col("ord").alias("sec_no"), "score").join(sections, ["path", "sec_no"])
    whole = F.col("heading") == "(preamble)"
    best = best.select("query_id", "path", (F.col("score") >= SECTION_MIN).cast("int").alias("emits"), F.when(whole, 1).otherwise(F.col("start_line")).cast("int").alias("start_line"), F.when(whole, F.col("n_lines")).otherwise(F.col("end_line")).cast("int").alias("end_line"))
    return nodes.select("query_id", "path", "key", "calls").join(best, ["query_id", "path"], "left").withColumn("emits", F.coalesce("emits", F.lit(0)))


def tree_reason(edges: DataFrame, gate: Scorer, section_gate: Callable[[DataFrame], DataFrame], queries: DataFrame, cfg: WalkConfig) -> tuple[DataFrame, DataFrame]:
    """(spans, stats) of the breadth-first walk.

    gate(pairs) adds ``opens`` (boolean; null means not) to rows of query_id, query, parent, child,
    kind, ord. section_gate(files) gives query_id, path, sec_no, start_line, end_line of what it
    selects from rows of query_id, query, path. Each visited directory or file is one call; the
    first call_budget tasks in queue order are visited; top_k is cut after the whole walk.
    """
    frontier = _root(queries).select("query_id", "query", "path", "kind", F.lit(1).cast("long").alias("pos"))
    queued = frontier.select("query_id", F.count("*").over(Window.partitionBy("query_id")).alias("total")).distinct()
    visited, tasks = [], [frontier.select("query_id", "pos")]
    for _ in range(cfg.max_depth):
        now = frontier.filter(F.col("pos") <= cfg.call_budget)
        visited.append(now)
        pairs = now.filter("kind = 'dir'").select("query_id", "query", F.col("path").alias("parent"), F.col("pos").alias("parent_pos")).join(edges, "parent")
        opened = gate(pairs).filter(F.coalesce("opens", F.lit(False)))
        w = Window.partitionBy("query_id").orderBy("parent_pos", F.col("kind") != "dir", "ord")
        step = opened.join(queued, "query_id").withColumn("pos", F.row_number().over(w) + F.col("total"))
        frontier = cut_lineage(step.select("query_id", "query", F.col("child").alias("path"), "kind", "pos"))
        if frontier.isEmpty():
            break
        tasks.append(frontier.select("query_id", "pos"))
        queued = queued.join(frontier.groupBy("query_id").agg(F.count("*").alias("more")), "query_id", "left").select("query_id", (F.col("total") + F.coalesce("more", F.lit(0))).alias("total"))
    rows, all_tasks = visited[0], tasks[0]
    for more in visited[1:]:
        rows = rows.unionByName(more)
    for more in tasks[1:]:
        all_tasks = all_tasks.unionByName(more)
    files = rows.filter("kind = 'file'")
    picked = section_gate(files.select("query_id", "query", "path")).join(files.select("query_id", "path", "pos"), ["query_id", "path"])
    once = picked.groupBy("query_id", "path", "start_line", "end_line").agg(F.min(F.struct("pos", "sec_no")).alias("at"))
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("at")))
    spans = ranked.filter(F.col("rank") <= cfg.top_k).select("query_id", "rank", "path", "start_line", "end_line")
    stats = all_tasks.groupBy("query_id").agg(F.count_if(F.col("pos") <= cfg.call_budget).alias("calls"), (F.max("pos") > cfg.call_budget).alias("truncated"))
    return spans, stats
