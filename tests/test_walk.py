import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from gleaner import models
from gleaner.operators import agents, corpus, fusion, metrics, walk
from gleaner.functions import text as T


def tree(rnd, depth=3):
    paths = []

    def grow(prefix, level):
        for i in range(rnd.randrange(1, 4)):
            name = f"{prefix}{'d' if level < depth and rnd.random() < 0.6 else 'f'}{i}"
            grow(name + "/", level + 1) if name.rsplit("/", 1)[-1][0] == "d" else paths.append(name + ".md")

    while not paths:
        grow("", 0)
    return sorted(paths)


def children(paths, parent):
    pre = parent + "/" if parent else ""
    below = [p[len(pre):] for p in paths if p.startswith(pre)]
    return [("dir", pre + d) for d in sorted({b.split("/")[0] for b in below if "/" in b})] + [("file", pre + b) for b in sorted(below) if "/" not in b]


def dfs(paths, score, sections, cfg):
    """The best-first walk with a stack."""
    stack, spans, calls, visited, cut = [("dir", "")], [], 0, 0, False
    while stack and len(spans) < cfg.top_k:
        if calls >= cfg.call_budget:
            cut = True
            break
        kind, path = stack.pop()
        if kind == "dir":
            kids = children(paths, path)
            if len(kids) == 1:
                stack.append(kids[0])
                visited += 1
                continue
            calls += 1
            visited += 1
            values = [score(c) for _, c in kids]
            keep = [k for k in sorted(zip(values, range(len(kids))), key=lambda x: x[0]) if k[0] >= max(cfg.min_probability, max(values) * cfg.relative_probability)]
            stack += [kids[i] for _, i in keep]
        else:
            visited += 1
            secs = sections.get(path, [])
            if cfg.return_files:
                spans.append((path, None, None))
            elif secs:
                calls += 1
                values = [score(f"{path}#{n}") for n in range(len(secs))]
                best = values.index(max(values))
                if values[best] >= 0.12:
                    spans.append((path, *((1, 9) if secs[best][0] == "(preamble)" else secs[best][1:])))
    return spans, calls, cut


@pytest.mark.parametrize("seed", range(6))
def test_decision_walk_equals_a_stack(spark, seed):
    rnd = random.Random(seed)
    paths = tree(rnd)
    table = {}

    def score(name):
        return table.setdefault(name, rnd.choice([0.05, 0.2, 0.5, 0.5, 0.9]))

    sections = {p: [("(preamble)", 1, 2), ("h", 3, 5), ("k", 6, 9)][: rnd.randrange(4)] for p in paths}
    for p in paths:
        for n in range(3):
            score(f"{p}#{n}")
        for i in range(1, len(p.split("/")) + 1):
            score("/".join(p.split("/")[:i]))
    cfg = walk.WalkConfig(top_k=rnd.randrange(1, 5), call_budget=rnd.randrange(1, 8), return_files=seed % 2 == 0)
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    secs = spark.createDataFrame([(p, n, s[1], s[2], s[0], 9, "o") for p, ss in sections.items() for n, s in enumerate(ss)], "path string, sec_no int, start_line int, end_line int, heading string, n_lines int, option string")
    known = spark.createDataFrame(list(table.items()), "name string, score double")
    name = F.when(F.col("kind") == "section", F.concat("parent", F.lit("#"), "child")).otherwise(F.col("child"))
    scorer = lambda rows: rows.withColumn("name", name).join(F.broadcast(known), "name").drop("name")
    spans, stats = walk.tree_decision(corpus.edges(files), lambda r: r.withColumn("option", F.col("child")), secs, spark.createDataFrame([(1, "q")], "query_id int, query string"), scorer, cfg)
    want, calls, cut = dfs(paths, score, sections, cfg)
    assert [(r.path, r.start_line, r.end_line) for r in spans.orderBy("rank").collect()] == want
    s = stats.first()
    assert (s.calls, s.truncated) == (calls, cut)


def test_decision_walk_scores_nothing_beyond_its_cut(spark):
    """A wide tree of three levels: with room for one file and five calls no more options are scored than that."""
    paths = [f"d{i}/e{j}/f{k}.md" for i in range(4) for j in range(4) for k in range(4)]
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(name):
        seen.add(1)
        return 0.5

    edges = corpus.edges(spark.createDataFrame([(p,) for p in paths], "path string"))
    asked = spark.createDataFrame([(1, "q"), (2, "r")], "query_id int, query string")
    scorer = lambda rows: rows.withColumn("score", counted.asNondeterministic()("child"))
    for cfg, calls in ((walk.WalkConfig(top_k=1, call_budget=9, return_files=True), 3), (walk.WalkConfig(top_k=9, call_budget=2, return_files=True), 2)):
        seen.value = 0
        spans, stats = walk.tree_decision(edges, lambda r: r.withColumn("option", F.col("child")), None, asked, scorer, cfg)
        assert {r.calls for r in stats.collect()} == {calls}
        assert spans.count() == (2 if cfg.top_k == 1 else 0)
        assert seen.value == 2 * 4 * calls


def test_reason_walk_equals_a_queue(spark):
    rnd = random.Random(9)
    paths = tree(rnd)
    opens = {c: rnd.random() < 0.8 for p in paths for c in ["/".join(p.split("/")[: i + 1]) for i in range(len(p.split("/")))]}
    known = spark.createDataFrame(list(opens.items()), "child string, opens boolean")
    pending, visited = deque([("dir", "")]), []
    while pending and len(visited) < 5:
        kind, path = pending.popleft()
        visited.append((kind, path))
        if kind == "dir":
            pending += [k for k in children(paths, path) if opens[k[1]]]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    pick = lambda f: f.select("query_id", "path", F.explode(F.array(F.lit(0), F.lit(1))).alias("sec_no"), F.lit(1).alias("start_line"), F.lit(2).alias("end_line"))
    spans, stats = walk.tree_reason(corpus.edges(files), lambda r: r.join(F.broadcast(known), "child"), pick, spark.createDataFrame([(1, "q")], "query_id int, query string"), walk.WalkConfig(top_k=9, call_budget=5))
    assert [r.path for r in spans.orderBy("rank").collect()] == [p for k, p in visited if k == "file"]
    assert (stats.first().calls, stats.first().truncated) == (len(visited), bool(pending))


def test_requests_are_split_by_size(spark):
    df = spark.createDataFrame([([20_000] * 5,), ([1] * 600,), ([],), ([60_000],)], "s array<int>")
    assert [r[0] for r in df.select(walk._calls(F.col("s"), F.lit(100))).collect()] == [3, 3, 0, 1]


class _Longest:
    def __call__(self, question, options):
        return [min(1.0, len(o) / 10) for o in options]


def test_model_scorers(spark):
    rows = spark.createDataFrame([(1, "q", "", f"c{i}", "file", i, "x" * i) for i in range(5)], "query_id int, query string, parent string, child string, kind string, ord int, option string")
    assert {r.ord: r.score for r in models.chosen_scores(_Longest)(rows).collect()} == {i: i / 10 for i in range(5)}
    got = rows.withColumn("score", models.relevance(_Longest, F.col("query"), F.col("option"))).collect()
    assert all(r.score == len(r.option) / 10 for r in got)


def test_listwise(spark):
    hits = spark.createDataFrame([(1, "q", i, f"p{i}", "t") for i in range(1, 5)], "query_id int, query string, rank int, path string, text string")
    order = lambda model: [r.path for r in models.listwise(hits, model, 3).orderBy("rank").collect()]
    assert order(None) == ["p1", "p2", "p3"]
    assert order(lambda: lambda s, u: 'Sure: {"order": [2, 2, 9, 0]}') == ["p3", "p1"]
    assert order(lambda: lambda s, u: "no idea") == ["p1", "p2", "p3"]


def test_agent_answers(spark):
    said = lambda t: '{"type": "message_end", "message": {"role": "assistant", "content": [{"type": "text", "text": %s}], "usage": {"totalTokens": 3, "input": 2, "cacheRead": 1, "output": 4, "cost": {"total": 0.5}}}}' % t
    import json

    answer = json.dumps('```{"spans": [{"path": "./a", "start_line": 1, "end_line": 2}, {"path": "a", "start_line": 1, "end_line": 2}, {"path": "a", "start_line": 3, "end_line": 9}, {"path": "b", "start_line": 1, "end_line": 1}]}```')
    lines = spark.createDataFrame([("r", 0, said('"first"')), ("r", 1, "not json"), ("r", 2, '{"type": "tool_execution_start"}'), ("r", 3, said(answer))], "run_id string, seq int, line string")
    files = spark.createDataFrame([("a", 4)], "path string, n_lines int")
    assert [(r.path, r.start_line, r.end_line) for r in agents.answer_spans(lines, files, 5).collect()] == [("a", 1, 2)]
    u = agents.event_usage(lines).first()
    assert (u.calls, u.input, u.output, u.cost, u.tools) == (2, 6, 8, 1.0, 1)
    assert agents.first_object('x { "a" } {"b": {"c": 1}} {}') == {"b": {"c": 1}} and agents.first_object(None) is None


def test_packing_skips_what_does_not_fit(spark):
    files = spark.createDataFrame([(1, 1, "a", "x" * 30), (1, 2, "b", "y" * 90), (1, 3, "c", "z")], "query_id int, rank int, path string, text string")
    assert [(r.path, r.included) for r in fusion.pack_context(files, 90).orderBy("rank").collect()] == [("a", True), ("b", False), ("c", True)]


def test_fusion_prefers_what_two_sources_share(spark):
    rows = spark.createDataFrame([(1, "a", 1, "x"), (1, "a", 2, "s"), (1, "b", 1, "y"), (1, "b", 2, "s")], "query_id int, source string, rank int, path string")
    assert [r.path for r in fusion.rrf(rows).orderBy("rank").collect()] == ["s", "x", "y"]


def test_metrics_of_empty_sets(spark):
    q = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    span = "query_id int, path string, start_line int, end_line int"
    hits = spark.createDataFrame([(1, "a", 1, 5), (1, "a", 1, 5), (1, "b", 1, 1), (2, "a", 1, 1)], span)
    gold = spark.createDataFrame([(1, "a", 5, 6), (1, "c", 1, 2)], span)
    got = {r.query_id: r for r in metrics.all_metrics(q, hits, gold).collect()}
    assert (got[1].span_recall, got[1].span_precision, got[1].file_recall, got[1].file_f1) == (0.5, 2 / 3, 0.5, 0.5)
    assert (got[1].line_recall, got[1].line_precision) == (0.25, 1 / 6)
    assert got[2].span_f1 == 0.0 and got[3].span_f1 == got[3].line_f1 == got[3].file_f1 == 1.0


def test_gold_checks_and_small_functions(spark):
    fx = spark.createDataFrame([("a", "q", [("f", 1, 2), ("f", 3, 9), ("g", 1, 1)]), ("a", "", [])], "id string, query string, gold array<struct<path:string,start_line:int,end_line:int>>")
    problems = sorted(r.problem for r in metrics.check_gold(fx, spark.createDataFrame([("f", 5)], "path string, n_lines int")).collect())
    assert problems == ["id missing or repeated", "lines outside f", "no gold", "no question", "unknown file: g"]
    assert metrics.parse_cutoffs("8, 2,8") == [2, 8]
    row = spark.range(1).select(T.title_of(F.lit("my-2nd_dir's")).alias("t"), T.lenient_bool(F.lit(" Yes ")).alias("y"), T.lenient_bool(F.lit(None)).alias("n"), *[c.alias(f"c{i}") for i, c in enumerate(T.clamp(F.lit(9), F.lit(12), F.lit(5)))], T.judge_score(F.lit(4)).alias("j")).first()
    assert tuple(row) == ("my-2nd_dir's".replace("-", " ").replace("_", " ").title(), True, False, 5, 5, 0.75)
    usage = spark.createDataFrame([(1, 0, 1, 10, 5, "m"), (1, 1, 2, 20, 5, None)], "query_id int, seq int, calls int, input_tokens int, output_tokens int, model string")
    total = models.total_usage(usage)
    assert tuple(total.first()) == (1, 3, 30, 10, "m")
    assert models.cost(total, spark.createDataFrame([("m", 1.0, 2.0)], "model string, usd_in double, usd_out double")).first().cost_usd == pytest.approx(5e-5)
