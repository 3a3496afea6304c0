"""Models behind the walks, rerankers and the index author: protocols, a remote client, usage and cost."""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import clamp, preview
from gleaner.operators.agents import first_object, json_object
from gleaner.operators.routing import match_children, option_batches
from gleaner.operators.walk import MAX_CHARS, MAX_OPTIONS, QUERY_CHARS
from gleaner.shared import cut_lineage
from gleaner.shipping import ship


class Chat(Protocol):
    """Answers a system and a user text."""

    def __call__(self, system: str, user: str) -> str: ...


class Chooser(Protocol):
    """Scores options (0 to 1) for a question."""

    def __call__(self, question: str, options: list[str]) -> list[float]: ...


@dataclass
class RemoteChat:
    """A chat endpoint of the common HTTP form, with retries. Settings come from the environment of
    the process that calls it, so keys are not shipped with plans."""

    model: str
    url: str = ""
    tries: int = 4
    timeout: float = 60.0

    def __call__(self, system: str, user: str) -> str:
        return self.post("/chat/completions", {"model": self.model, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}]})["choices"][0]["message"]["content"] or ""

    def embed(self, texts: list[str]) -> list[list[float]]:
        rows = self.post("/embeddings", {"model": self.model, "input": texts})["data"]
        return [r["embedding"] for r in sorted(rows, key=lambda r: r["index"])]

    def post(self, path: str, body: dict) -> dict:
        url = (self.url or os.environ["GLEANER_MODEL_URL"]).rstrip("/") + path
        request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {os.environ.get('GLEANER_MODEL_KEY', '')}"})
        for attempt in range(self.tries):
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                    return json.load(answer)
            except urllib.error.HTTPError as e:
                if e.code not in (408, 429) and e.code < 500 or attempt == self.tries - 1:
                    raise
            except OSError:
                if attempt == self.tries - 1:
                    raise
            time.sleep(2**attempt)
        raise AssertionError("unreachable")


def make_chat(spec: str) -> Chat:
    """A model from ``provider/model``; the one provider is ``remote``."""
    provider, _, model = spec.partition("/")
    if provider != "remote" or not model:
        raise ValueError(f"a model is given as remote/name, not {spec!r}")
    return RemoteChat(model)


@dataclass
class ChatChooser:
    """A chooser made of a chat model: it is asked for a number from 0 to 1 for each option. Where its answer
    is no such list, every option scores 0, so that nothing is opened on its word."""

    chat: Chat

    def __call__(self, question: str, options: list[str]) -> list[float]:
        listed = "\n".join(f"{i}. {o}" for i, o in enumerate(options))
        said = first_object(self.chat('How likely does each option lead to the answer? Answer with JSON: {"scores": [numbers from 0 to 1, one for each option]}', f"User question: {question}\n\n{listed}"))
        scores = (said or {}).get("scores")
        if not isinstance(scores, list) or len(scores) < len(options) or not all(isinstance(x, int | float) for x in scores):
            return [0.0] * len(options)
        return [min(1.0, max(0.0, float(x))) for x in scores[: len(options)]]


def chosen_scores(factory: Callable[[], Chooser], max_options: int = MAX_OPTIONS, max_chars: int = MAX_CHARS) -> Callable[[DataFrame], DataFrame]:
    """A walk's scorer: the options of one question and node go to the chooser in as few requests as their
    number and size allow. A value beyond the options' (for none of them) is dropped."""

    def score(options: DataFrame) -> DataFrame:
        ship(options.sparkSession)
        state = F.char_length(F.concat(F.lit("User question: "), F.substring("query", 1, QUERY_CHARS)))
        dealt = option_batches(options, max_options, max_chars, state, "query_id", "parent")
        lists = dealt.groupBy("query_id", "parent", "batch").agg(F.first("query").alias("query"), F.array_sort(F.collect_list(F.struct("ord", "option"))).alias("o"))

        @F.pandas_udf("array<double>")
        def choose(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            model = factory()
            for question, texts in batches:
                yield pd.Series([list(model(q[:QUERY_CHARS], list(t)))[: len(t)] for q, t in zip(question, texts)])

        scored = lists.withColumn("s", choose("query", F.col("o.option"))).select("query_id", "parent", F.explode(F.arrays_zip(F.col("o.ord").alias("ord"), F.col("s").alias("score"))).alias("z"))
        return options.join(scored.select("query_id", "parent", "z.ord", "z.score"), ["query_id", "parent", "ord"])

    return score


def _told(factory: Callable[[], Chat], system: str, prompt: Column, shape: str) -> Column:
    """The JSON object of a chat model's answer as a struct of a shape; null fields where there is none."""

    @F.pandas_udf("string")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for prompts in batches:
            yield prompts.map(lambda p: model(system, p))

    return F.from_json(json_object(ask(prompt)), shape)


def reason_gate(factory: Callable[[], Chat], indexes: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A tree-reason gate: the model reads a directory's index and children and names those to open. A child
    is opened only if the answer names it (by path, or by a name that one child has); whatever else the
    answer says, or if it is no JSON, nothing is. indexes: path, text."""

    def gate(pairs: DataFrame) -> DataFrame:
        ship(pairs.sparkSession)
        asked = pairs.groupBy("query_id", "query", "parent").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "child"))), lambda c: c["child"]), "\n").alias("children"))
        asked = asked.join(indexes.select(F.col("path").alias("parent"), F.col("text").alias("index")), "parent", "left")
        prompt = F.concat(F.lit("Question: "), "query", F.lit("\n\nIndex of this directory:\n"), F.coalesce("index", F.lit("")), F.lit("\n\nIts children:\n"), "children")
        told = _told(factory, 'Which children can hold the answer? Answer with JSON: {"relevant": true or false, "open_dirs": [paths], "open_files": [paths]}', prompt, "open_dirs array<string>, open_files array<string>")
        named = cut_lineage(asked.select("query_id", "parent", told.alias("a")))
        none = F.expr("cast(array() as array<string>)")
        answers = named.select("query_id", "parent", F.explode(F.array_distinct(F.concat(F.coalesce("a.open_dirs", none), F.coalesce("a.open_files", none)))).alias("returned"))
        found = match_children(answers, pairs.select("parent", "child").distinct()).filter("child is not null").select("query_id", "parent", "child", F.lit(True).alias("opens")).distinct()
        return pairs.join(found, ["query_id", "parent", "child"], "left")

    return gate


def reason_sections(factory: Callable[[], Chat], sections: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A tree-reason section gate: the model reads the previews of a file's sections and names line ranges,
    which are clamped to the file; an answer that is no JSON, or says it is not relevant without naming
    any, selects nothing. sections: path, sec_no, start_line, end_line, heading, text, n_lines."""

    def pick(files: DataFrame) -> DataFrame:
        ship(files.sparkSession)
        shown = F.format_string("[L%d-%d] %s\n%s", "start_line", "end_line", "heading", preview(F.col("text"), F.col("query"), F.col("start_line")))
        rows = files.join(sections, "path").groupBy("query_id", "query", "path", "n_lines").agg(F.array_sort(F.collect_list(F.struct("sec_no", shown.alias("shown")))).alias("s"))
        prompt = F.concat(F.lit("Question: "), "query", F.lit("\n\nSections of "), "path", F.lit(":\n\n"), F.array_join("s.shown", "\n\n"))
        told = _told(factory, 'Which lines answer the question? Answer with JSON: {"relevant": true or false, "spans": [{"start_line": n, "end_line": n}]}', prompt, "spans array<struct<start_line:int,end_line:int>>")
        said = cut_lineage(rows.select("query_id", "path", "n_lines", told.alias("a")))
        spans = said.select("query_id", "path", "n_lines", F.posexplode("a.spans").alias("sec_no", "p")).filter("p.start_line is not null and p.end_line is not null")
        low, high = clamp(F.col("p.start_line"), F.col("p.end_line"), F.col("n_lines"))
        return spans.select("query_id", "path", "sec_no", low.alias("start_line"), high.alias("end_line"))

    return pick


def relevance(factory: Callable[[], Chooser], query: Column, descriptor: Column) -> Column:
    """A pointwise relevance score of each row, in Arrow batches; rows of one question share a call."""

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = factory()
        for q, d in batches:
            out = pd.Series(0.0, index=q.index)
            for question, rows in d.groupby(q):
                out.loc[rows.index] = list(model(question, list(rows)))[: len(rows)]
            yield out

    return score(query, descriptor)


def listwise(hits: DataFrame, factory: Callable[[], Chat] | None, top_k: int, preview: int = 500) -> DataFrame:
    """Reranks each query's hits (query_id, query, rank, path, text) by an order that a chat model
    gives; without a model, or where its answer has no order, the base order stays. An index that
    the answer repeats is used once, indexes out of range not at all."""
    listed = hits.groupBy("query_id").agg(F.first("query").alias("query"), F.array_sort(F.collect_list(F.struct("rank", "path", F.substring("text", 1, preview).alias("text")))).alias("h"))
    if factory is None:
        order = F.sequence(F.lit(0), F.least(F.size("h"), F.lit(top_k)) - 1)
    else:
        ship(hits.sparkSession)

        @F.pandas_udf("array<int>")
        def ask(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            model = factory()
            for question, lists in batches:
                out = []
                for q, h in zip(question, lists):
                    items = [{"i": i, "path": x["path"], "preview": x["text"]} for i, x in enumerate(h)]
                    answer = first_object(model('Order the candidates by relevance. Answer with JSON: {"order": [indices]}', json.dumps({"query": q, "candidates": items, "at_most": top_k})))
                    named = [i for i in (answer or {}).get("order") or [] if isinstance(i, int) and 0 <= i < len(items)]
                    out.append((list(dict.fromkeys(named)) or list(range(len(items))))[:top_k])
                yield pd.Series(out)

        order = ask("query", "h")
    rows = listed.select("query_id", "h", F.posexplode(order).alias("pos", "i"))
    return rows.select("query_id", (F.col("pos") + 1).alias("rank"), F.get("h", F.col("i"))["path"].alias("path"), F.get("h", F.col("i"))["rank"].alias("base_rank"))


def cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Adds cost_usd to model, input_tokens, output_tokens. prices: model, usd_in, usd_out per million; unknown models cost 0."""
    rows = usage.join(prices, "model", "left")
    return rows.withColumn("cost_usd", F.coalesce((F.col("input_tokens") * F.col("usd_in") + F.col("output_tokens") * F.col("usd_out")) / 1e6, F.lit(0.0))).drop("usd_in", "usd_out")


def total_usage(usage: DataFrame) -> DataFrame:
    """query_id, calls, input_tokens, output_tokens, model: sums, and the last known model. usage: query_id, seq, ..."""
    return usage.groupBy("query_id").agg(F.sum("calls").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.max_by("model", F.when(F.col("model").isNotNull(), F.col("seq"))).alias("model"))
