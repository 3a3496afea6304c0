"""Retrieval strategies by name. Each is a function of a corpus and questions that gives ranked spans."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner import models
from gleaner.functions.text import EXCERPT_CHARS
from gleaner.operators import corpus, fusion, lexical, routing, vector, walk
from gleaner.sources import bundle


@dataclass
class Corpus:
    """What strategies read: a tree (path, kind, raw) as of the bundle source, and derived tables."""

    tree: DataFrame
    vectors: DataFrame | None = None  # id, vector of retrieval documents

    def __post_init__(self):
        files = bundle.files_of(self.tree)
        self.concepts = corpus.concepts(files)
        self.edges = corpus.edges(files)
        self.indexes = bundle.indexes_of(self.tree)
        docs = corpus.retrieval_docs(self.concepts)
        self.docs = docs.withColumn("doc_ord", F.struct(corpus.corpus_order(F.col("path")).alias("path"), "sec_no"))

    def sections(self) -> DataFrame:
        return corpus.sections(self.concepts, "raw", ("path", "title", "description", "resource", "n_lines"))


@dataclass(frozen=True)
class Models:
    """Factories of the models that a strategy may need."""

    chat: Callable | None = None
    chooser: Callable | None = None
    embed: Callable[[DataFrame], DataFrame] | None = None  # adds q to query_id, query


@dataclass(frozen=True)
class Strategy:
    """track: cold (reads the tree) or warm (needs an index); needs: a field of Models, or nothing."""

    name: str
    run: Callable[[Corpus, DataFrame, int, Models, int], DataFrame]
    track: str = "cold"
    needs: str = ""


@dataclass
class Registry:
    strategies: dict[str, Strategy] = field(default_factory=dict)

    def add(self, name: str, **about):
        def kept(run):
            if name in self.strategies:
                raise ValueError(f"there is a strategy {name!r} already")
            self.strategies[name] = Strategy(name, run, **about)
            return run

        return kept


#: The engine's own strategies, and those it is compared with.
OWN, BASELINES = Registry(), Registry()


def names() -> list[str]:
    """Of both registries."""
    return sorted({*OWN.strategies, *BASELINES.strategies})


def get(name: str) -> Strategy:
    """Own strategies come before baselines of the same name."""
    for registry in (OWN, BASELINES):
        if name in registry.strategies:
            return registry.strategies[name]
    raise ValueError(f"no strategy {name!r}; there are {', '.join(names())}")


def retrieve(name: str, source: Corpus, queries: DataFrame, top_k: int = 2, with_models: Models = Models(), call_budget: int = 32) -> DataFrame:
    """query_id, rank, path, start_line, end_line, text, score of a strategy's spans. queries: query_id, query."""
    strategy = get(name)
    if strategy.needs and getattr(with_models, strategy.needs) is None:
        raise ValueError(f"strategy {name!r} needs a model ({strategy.needs})")
    return strategy.run(source, queries, top_k, with_models, call_budget)


def _documents(source: Corpus, hits: DataFrame) -> DataFrame:
    return hits.join(source.docs, "doc_ord").select("query_id", "rank", "path", "start_line", "end_line", F.substring("text", 1, EXCERPT_CHARS).alias("text"), "score")


def _spans(source: Corpus, spans: DataFrame) -> DataFrame:
    """Spans with their lines' text; null lines are the whole file."""
    files = source.concepts.select("path", "raw", "n_lines")
    rows = spans.join(files, "path").withColumn("start_line", F.coalesce("start_line", F.lit(1))).withColumn("end_line", F.coalesce("end_line", "n_lines"))
    text = F.array_join(F.slice(corpus.lines(F.col("raw")), F.col("start_line"), F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(0))), "")
    return rows.select("query_id", "rank", "path", "start_line", "end_line", text.alias("text"), F.lit(None).cast("double").alias("score"))


@BASELINES.add("bm25")
def _bm25(source, queries, top_k, with_models, call_budget):
    return _documents(source, lexical.bm25(source.docs, queries, top_k))


@BASELINES.add("fts")
def _fts(source, queries, top_k, with_models, call_budget):
    return _documents(source, lexical.fts(source.docs, queries, top_k))


@BASELINES.add("vsearch", track="warm", needs="embed")
def _vsearch(source, queries, top_k, with_models, call_budget):
    """Vectors whose document is gone are passed by; equal scores are in the order of the ids' hashes."""
    number = F.xxhash64("id")
    known = source.vectors.join(source.docs.select("id"), "id", "left_semi").select(number.alias("doc_ord"), F.col("vector").alias("v"))
    found = vector.vector_search(known, with_models.embed(queries), top_k).withColumnRenamed("doc_ord", "number")
    return _documents(source, found.join(source.docs.select(number.alias("number"), "doc_ord"), "number").drop("number"))


@BASELINES.add("rerank")
def _rerank(source, queries, top_k, with_models, call_budget):
    """max(3 k, 12) lexical candidates in the order that a chat model gives, or in their own."""
    base = _documents(source, lexical.bm25(source.docs, queries, max(3 * top_k, 12))).join(queries, "query_id")
    order = models.listwise(base, with_models.chat, top_k)
    return order.join(base.select("query_id", F.col("rank").alias("base_rank"), "start_line", "end_line", "text", "score"), ["query_id", "base_rank"]).select("query_id", "rank", "path", "start_line", "end_line", "text", "score")


@OWN.add("tree-decision", needs="chooser")
def _tree_decision(source, queries, top_k, with_models, call_budget):
    rows = source.sections()

    def options(pairs: DataFrame) -> DataFrame:
        made = routing.route_options(pairs.select("parent", "child", "kind").distinct(), source.edges, source.indexes).select("parent", "child", "option")
        return pairs.join(made, ["parent", "child"])

    text = routing.section_option(F.col("heading"), F.col("text"), F.col("start_line"), F.col("title"), F.col("description"), F.col("resource"), F.lit(""))
    spans, _ = walk.tree_decision(source.edges, options, rows.withColumn("option", text), queries, models.chosen_scores(with_models.chooser), walk.WalkConfig(top_k=top_k, call_budget=call_budget))
    return _spans(source, spans)


@OWN.add("tree-reason", needs="chat")
def _tree_reason(source, queries, top_k, with_models, call_budget):
    pick = models.reason_sections(with_models.chat, source.sections().select("path", "sec_no", "start_line", "end_line", "heading", "text", "n_lines"))
    spans, _ = walk.tree_reason(source.edges, models.reason_gate(with_models.chat, source.indexes), pick, queries, walk.WalkConfig(top_k=top_k, call_budget=call_budget))
    return _spans(source, spans)


@OWN.add("hybrid", needs="chooser")
def _hybrid(source, queries, top_k, with_models, call_budget):
    """Tree, lexical and term-frequency files, fused, described by their index lines and reranked."""
    wide = max(32, 8 * top_k)
    found = {"tree": _tree_decision(source, queries, top_k, with_models, call_budget), "bm25": _bm25(source, queries, wide, with_models, call_budget), "fts": _fts(source, queries, wide, with_models, call_budget)}
    ranked = None
    for name, hits in found.items():
        rows = fusion.unique_files(hits, wide).withColumn("source", F.lit(name))
        ranked = rows if ranked is None else ranked.unionByName(rows)
    evidence = ranked.filter("source <> 'tree'").groupBy("query_id", "path").agg(F.max_by("excerpt", "source").alias("excerpt"))
    summaries = routing.child_summaries(source.edges.filter("kind = 'file'").select("parent", "child"), source.indexes).select(F.col("child").alias("path"), F.substring("summary", 1, 1000).alias("summary"))
    pool = fusion.descriptors(fusion.rrf(ranked).filter(F.col("rank") <= wide), summaries, evidence).join(queries, "query_id")
    best = fusion.rerank(pool, models.relevance(with_models.chooser, F.col("query"), F.col("descriptor")), wide, top_k)
    nothing = F.lit(None).cast("int")
    return _spans(source, best.select("query_id", "rank", "path", nothing.alias("start_line"), nothing.alias("end_line"))).drop("score").join(best.select("query_id", "rank", F.col("rerank_score").alias("score")), ["query_id", "rank"])
