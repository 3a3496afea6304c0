import json

import pytest
from pyspark.sql import functions as F

from gleaner import cli, evaluate, models, strategies
from gleaner.operators import corpus, routing
from gleaner.sources import bundle

FILES = {
    "index.md": "# Top\n\n* [left](left/) — cats and dogs\n* [right](right/) — trains\n",
    "left/index.md": "* [cats](cats.md) — all about cats\n* [dogs](dogs.md) — dogs\n",
    "right/index.md": "* [trains](trains.md) — trains\n",
    "left/cats.md": "---\ntype: page\ntitle: Cats\ndescription: about cats\n---\nlead\n# Purring\ncats purr loudly\n# Food\nfish\n",
    "left/dogs.md": "# Barking\ndogs bark\n",
    "right/trains.md": "# Speed\ntrains are fast\n",
    "right/old/steam-engine.v2.md": "steam\n",
}


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for path, text in FILES.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    return strategies.Corpus(bundle.load(spark, str(root)))


def chooser():
    def choose(question, options):
        words = question.lower().split()
        return [max(0.05, sum(w in o.lower() for w in words) / len(words)) for o in options] + [0.4]  # the last is for none

    return choose


def chat():
    def answer(system, prompt):
        if "Index of this directory" in prompt:
            kids = prompt.split("Its children:\n")[1].split("\n")
            return 'Sure: {"relevant": false, "open_dirs": ["left"], "open_files": ["cats.md", "nowhere.md"]}' if any("left" in k for k in kids) else "no JSON"
        return '```json\n{"relevant": true, "spans": [{"start_line": 7, "end_line": 99}, {"start_line": null, "end_line": 3}]}\n```'

    return answer


def asked(spark, text):
    return spark.createDataFrame([(1, text)], "query_id int, query string")


def test_registry():
    assert strategies.names() == ["bm25", "fts", "hybrid", "rerank", "tree-decision", "tree-reason", "vsearch"]
    assert strategies.get("bm25").track == "cold" and strategies.get("vsearch").track == "warm"
    with pytest.raises(ValueError, match="no strategy"):
        strategies.get("other")
    with pytest.raises(ValueError, match="needs a model"):
        strategies.retrieve("tree-reason", None, None)


def test_lexical_and_rerank(spark, source):
    top = strategies.retrieve("bm25", source, asked(spark, "cats purr"), 1).first()
    assert (top.path, top.start_line) == ("left/cats.md", 7)
    swapped = strategies.Models(chat=lambda: lambda s, u: 'best: {"order": [1, 1, 0]}')
    base = [r.start_line for r in strategies.retrieve("rerank", source, asked(spark, "cats purr"), 2).orderBy("rank").collect()]
    assert [r.start_line for r in strategies.retrieve("rerank", source, asked(spark, "cats purr"), 2, swapped).orderBy("rank").collect()] == base[::-1]


def test_vector_search_skips_unknown_documents(spark, source):
    ids = [r.id for r in source.docs.orderBy("doc_ord").collect()]
    source.vectors = spark.createDataFrame([(i, [float(n), 1.0]) for n, i in enumerate(ids)] + [("gone#0", [9.0, 0.0])], "id string, vector array<double>")
    embed = lambda q: q.withColumn("q", F.array(F.lit(1.0), F.lit(0.0)))
    got = strategies.retrieve("vsearch", source, asked(spark, "x"), 2, strategies.Models(embed=embed)).orderBy("rank").collect()
    source.vectors = None
    assert len(got) == 2 and got[0].path == ids[-1].split("#")[0]


def test_tree_strategies(spark, source):
    with_models = strategies.Models(chat=chat, chooser=chooser)
    got = strategies.retrieve("tree-decision", source, asked(spark, "cats purr"), 1, with_models).collect()
    assert [(r.path, r.start_line, r.end_line, r.text) for r in got] == [("left/cats.md", 7, 8, "# Purring\ncats purr loudly\n")]
    got = strategies.retrieve("tree-reason", source, asked(spark, "cats purr"), 3, with_models).collect()
    assert [(r.path, r.start_line, r.end_line) for r in got] == [("left/cats.md", 7, 10)]
    best = strategies.retrieve("hybrid", source, asked(spark, "cats purr"), 2, with_models).orderBy("rank").first()
    assert best.path == "left/cats.md" and best.score == 1.0


def test_options(spark, source):
    rows = {r.child: r.option for r in routing.route_options(source.edges.select("parent", "child", "kind"), source.edges, source.indexes).collect()}
    assert rows["left"] == "left: * [left](left/) — cats and dogs; subtopics: cats, dogs"
    assert rows["right"] == "right: * [right](right/) — trains; subtopics: old, trains, steam engine.v2" and rows["left/dogs.md"] == "left/dogs.md: * [dogs](dogs.md) — dogs"
    assert rows["right/old"] == "right/old: old; subtopics: steam engine.v2"


def test_requests_are_split(spark):
    calls = spark.sparkContext.accumulator(0)

    def counting():
        def choose(question, options):
            calls.add(1)
            assert len(options) <= 3 and sum(map(len, options)) <= 40
            return [0.5] * len(options)

        return choose

    options = spark.createDataFrame([(1, "q", "", i, "o" * (15 if i == 3 else 4)) for i in range(8)], "query_id int, query string, parent string, ord int, option string")
    assert models.chosen_scores(counting, 3, 40)(options).count() == 8
    rows = routing.option_batches(options, 3, 40, F.lit(16), "query_id", "parent").orderBy("ord").collect()
    assert [r.batch for r in rows] == [0, 0, 0, 1, 1, 1, 2, 2]


def test_children_and_paths(spark):
    kids = spark.createDataFrame([("", "a"), ("", "b"), ("d", "d/a"), ("d", "d/x/n"), ("d", "d/y/n")], "parent string, child string")
    said = [("", "/a/"), ("d", "d/a"), ("d", " a "), ("d", "n"), ("", "c"), ("", None)]
    got = routing.match_children(spark.createDataFrame([(i, *x) for i, x in enumerate(said)], "id int, parent string, returned string"), kids).orderBy("id").collect()
    assert [r.child for r in got] == ["a", "d/a", "d/a", None, None, None]
    paths = spark.createDataFrame([("docs/one.md", 0), ("docs/two.md", 1)], "path string, ord int")
    texts = ["AT: docs/two.md.", "AT: docs/two", "see docs/two.md and docs/one.md", "AT: other, yet docs/two.md", "nothing", "", None]
    got = routing.named_paths(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), paths, "AT").orderBy("id").collect()
    assert [r.path for r in got] == ["docs/two.md", "docs/two.md", "docs/one.md", "docs/two.md", None, None, None]
    row = spark.createDataFrame([(None, 3, None)], "a int, b int, c int")
    assert row.select(routing.field(row, "a", "x", "b"), routing.field(row, "c", default=7)).first() == (3, 7)


def test_bench_and_analysis(spark, tmp_path, capsys):
    root, out = tmp_path / "tree", str(tmp_path / "out")
    for path, text in FILES.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    gold = [{"path": "left/cats.md", "start_line": 7, "end_line": 8}]
    lines = [json.dumps({"id": "a", "query": "cats purr loudly", "gold": gold}), "# comment", json.dumps({"id": "b", "query": "zebra", "gold": [{"path": "left/dogs.md", "start_line": 1, "end_line": 2}]})]
    (tmp_path / "q.jsonl").write_text("\n".join(lines))
    questions = str(tmp_path / "q.jsonl")
    broken = strategies.Models(chooser=lambda: lambda q, o: 1 / 0)
    summary = {r.strategy: r for r in evaluate.bench(spark, str(root), questions, ["bm25", "vsearch", "tree-decision"], [1, 4], out, broken).collect()}
    assert summary["bm25"].n == 2 and summary["vsearch"].n_skipped == 2 and summary["tree-decision"].n_errors == 2
    assert summary["bm25"].place == 1 and summary["bm25"].span_recall >= 0.5
    found = {k: v.collect() for k, v in evaluate.analyze(spark, out, questions).items()}
    assert [r.strategy for r in found["summary"]][0] == "bm25" and {r.k for r in found["recall"]} == {1, 4}
    assert found["repeats"][0].strategy == "bm25" and all(r.span_recall < 0.5 for r in found["misses"])
    (tmp_path / "bad.jsonl").write_text(json.dumps({"id": "a", "query": "x", "gold": [{"path": "gone.md", "start_line": 1, "end_line": 2}]}))
    with pytest.raises(ValueError, match="unknown file"):
        evaluate.bench(spark, str(root), str(tmp_path / "bad.jsonl"), ["bm25"], [1], out)
    assert cli.main(["query", str(root), "cats purr", "--top-k", "1", "--json"]) == 0
    said = json.loads(capsys.readouterr().out.strip().split("\n")[-1])
    assert said["spans"][0]["path"] == "left/cats.md" and said["stats"]["strategy"] == "bm25"
    assert open(cli.synopses(spark, str(root))).read().startswith("## left/cats.md")


def test_a_chat_model_as_chooser():
    pick = models.ChatChooser(lambda s, u: 'I think {"scores": [0.2, 3, -1]}')
    assert pick("q", ["a", "b", "c"]) == [0.2, 1.0, 0.0]
    assert models.ChatChooser(lambda s, u: "no idea")("q", ["a", "b"]) == [0.0, 0.0]
