"""Command line: ``python -m gleaner.cli lint|index|prepare|query|bench|analyze ROOT ...``."""

from __future__ import annotations

import argparse
import json
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner import evaluate, strategies
from gleaner.models import ChatChooser, make_chat
from gleaner.operators import author, corpus, links, metrics
from gleaner.sources import bundle


def lint(spark: SparkSession, root: str) -> DataFrame:
    """path, level, message."""
    tree = bundle.load(spark, root, eager=True)
    return links.lint(corpus.concepts(bundle.files_of(tree)), bundle.indexes_of(tree), bundle.directories_of(tree)).orderBy("path", "level", "message")


def index(spark: SparkSession, root: str, write: bool = True) -> int:
    """Indexes from frontmatter; the number of directories."""
    files = bundle.files_of(bundle.load(spark, root, eager=True))
    made = links.generate_indexes(corpus.concepts(files), corpus.edges(files), root.rstrip("/").rsplit("/", 1)[-1] or "Bundle")
    return author.write_indexes(made, root) if write else made.count()


def synopses(spark: SparkSession, root: str) -> str:
    """Writes the synopses of all concepts, in corpus order, below the engine's own folder; the file's path."""
    concept = corpus.concepts(bundle.files_of(bundle.load(spark, root, eager=True)))
    target = os.path.join(root, bundle.STATE, "synopses.md")
    os.makedirs(os.path.dirname(target), exist_ok=True)
    rows = links.synopses(concept, corpus.sections(concept)).orderBy(corpus.corpus_order(F.col("path")))
    with open(target, "w", encoding="utf-8") as f:
        for r in rows.toLocalIterator():
            f.write(r.synopsis + "\n")
    return target


def given_models(spec: str | None) -> strategies.Models:
    """Chat and chooser of a model name; none of either without one."""
    if not spec:
        return strategies.Models()
    return strategies.Models(chat=lambda: make_chat(spec), chooser=lambda: ChatChooser(make_chat(spec)))


def query(spark: SparkSession, root: str, question: str, strategy: str = "bm25", top_k: int = 2, model: str | None = None, call_budget: int = 32) -> DataFrame:
    """rank, path, start_line, end_line, text, score of the best spans by a strategy."""
    asked = spark.createDataFrame([(0, question)], "query_id int, query string")
    found = strategies.retrieve(strategy, strategies.Corpus(bundle.load(spark, root)), asked, top_k, given_models(model), call_budget)
    return found.drop("query_id").orderBy("rank")


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="gleaner")
    parser.add_argument("command", choices=["lint", "index", "prepare", "query", "bench", "analyze"])
    parser.add_argument("root", help="the tree; of analyze a benchmark's folder")
    parser.add_argument("question", nargs="?", help="a question; of bench and analyze a question file")
    parser.add_argument("--strategy", default="bm25", help=f"one, or for bench a comma list, of {', '.join(strategies.names())}")
    parser.add_argument("--top-k", type=int, default=2)
    parser.add_argument("--cutoffs", default="1,2,4,8")
    parser.add_argument("--call-budget", type=int, default=32)
    parser.add_argument("--model", help="remote/name")
    parser.add_argument("--out", default="bench-results")
    for flag, about in (("force", "write indexes that are there already"), ("strict", "warnings fail too"), ("synopses", "also write synopses"), ("json", "one JSON object with spans and statistics")):
        parser.add_argument(f"--{flag}", action="store_true", help=about)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("gleaner").getOrCreate()
    if args.command == "lint":
        rows = lint(spark, args.root).collect()
        for r in rows:
            print(f"{r.level}\t{r.path}\t{r.message}")
        return int(any(args.strict or r.level == "error" for r in rows))
    if args.command == "index":
        print(index(spark, args.root))
        if args.synopses:
            print(synopses(spark, args.root))
    elif args.command == "prepare":
        spec = args.model
        made = author.prepare(bundle.load(spark, args.root), lambda: make_chat(spec), args.root.rstrip("/").rsplit("/", 1)[-1], args.force)
        print(author.write_indexes(made.filter("written"), args.root))
    elif args.command == "bench":
        summary = evaluate.bench(spark, args.root, args.question, args.strategy.split(","), metrics.parse_cutoffs(args.cutoffs), args.out, given_models(args.model), args.call_budget)
        for r in summary.orderBy("place").collect():
            print(json.dumps(r.asDict(), ensure_ascii=False))
    elif args.command == "analyze":
        for name, rows in evaluate.analyze(spark, args.root, args.question).items():
            print(json.dumps({name: [r.asDict() for r in rows.collect()]}, ensure_ascii=False))
    else:
        began = time.perf_counter()
        spans = [r.asDict() for r in query(spark, args.root, args.question or "", args.strategy, args.top_k, args.model, args.call_budget).collect()]
        if args.json:
            print(json.dumps({"spans": spans, "stats": {"strategy": args.strategy, "track": strategies.get(args.strategy).track, "latency_ms": round(1000 * (time.perf_counter() - began), 1)}}, ensure_ascii=False))
        for r in [] if args.json else spans:
            print(f"{r['rank']}. {r['path']}:{r['start_line']}-{r['end_line']}\n{r['text']}\n")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
