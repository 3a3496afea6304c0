import pytest

from gleaner import cli
from gleaner.operators import author, corpus, links
from gleaner.sources import bundle, fixtures, sidecar


@pytest.fixture
def root(tmp_path):
    def put(path, text):
        p = tmp_path / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text if isinstance(text, bytes) else text.encode())

    put("index.md", "# Top\n\n* [guide](guide.md) — start\n* [gone](gone.md) — nothing\n")
    put("guide.md", "---\ntype: page\ntitle: Guide\ndescription: How to start\ntags: one\n---\n\n# First\n\nSee [code](src/code.md) and ![pic](pic.png).\n\n## Second\ntext\n")
    put("src/code.md", "plain text, no frontmatter\n")
    put("src/long.py", "".join(f"line {i}\n" for i in range(1, 82)))
    put(".github/flow.yml", "on: push\n")
    put("_private/x.md", "---\n- a\n- list\n---\nbody\n")
    put("node_modules/skip.js", "x")
    put("src/nul.bin", b"a\0b")
    put("src/.dot", "hidden")
    put("src/log.md", "reserved")
    (tmp_path / "link.md").symlink_to(tmp_path / "guide.md")
    (tmp_path / "src/up").symlink_to(tmp_path)
    return str(tmp_path)


def test_lazy_listing_and_order(spark, root):
    tree = bundle.load(spark, root)
    got = [(r.path, r.kind, r.raw is None) for r in tree.orderBy(corpus.corpus_order(tree.path)).collect()]
    assert got == [("guide.md", "file", False), ("index.md", "index", False), (".github/flow.yml", "file", False), ("_private/x.md", "file", False), ("src/code.md", "file", False), ("src/long.py", "file", False), ("src/nul.bin", "file", True)]
    assert {r.path for r in bundle.directories_of(tree).collect()} == {"", ".github", "_private", "src"}


def test_eager_listing(spark, root):
    paths = {r.path for r in bundle.load(spark, root, eager=True).collect()}
    assert {"guide.md", "src/code.md", "_private/x.md"} <= paths and not any(p.endswith((".py", ".js", "log.md")) for p in paths)


def test_lookup_stays_inside(spark, root):
    asked = ["src/code.md", "/etc/passwd", "../x", "src/../guide.md", "node_modules/skip.js", "link.md", "src/up/guide.md", "", "index.md"]
    got = {r.path: r.kind for r in bundle.at_paths(bundle.load(spark, root), spark.createDataFrame([(p,) for p in asked], "path string")).collect()}
    assert got == dict.fromkeys(asked) | {"src/code.md": "file", "index.md": "index"}


def test_texts_and_bytes(spark, tmp_path):
    texts = {"a.txt": b"one\r\ntwo\rthree\n", "b.txt": b"\xff\xfe", "c.txt": b"a\0b", "d.txt": "é\ufeff".encode(), "e.txt": b""}
    for name, content in texts.items():
        (tmp_path / name).write_bytes(content)
    assert {r.path: r.raw for r in bundle.load(spark, str(tmp_path)).collect()} == {"a.txt": "one\ntwo\nthree\n", "b.txt": None, "c.txt": None, "d.txt": "é\ufeff", "e.txt": ""}
    assert bundle.load(spark, f"file://{tmp_path}").count() == 5


def test_concepts(spark, root):
    rows = {r.path: r for r in corpus.concepts(bundle.files_of(bundle.load(spark, root))).collect()}
    g = rows["guide.md"]
    assert (g.type, g.title, g.description, g.tags, g.when_to_use) == ("page", "Guide", "How to start", ["one"], None)
    assert g.body.startswith("# First") and g.n_lines == 13 and g.present == ["description", "tags", "title", "type"]
    assert (rows["_private/x.md"].title, rows["_private/x.md"].present) == ("x", None)
    assert rows["src/code.md"].body == rows["src/code.md"].raw and rows["src/code.md"].title == "code"


def test_sections(spark):
    texts = ["", "\n \n", "no heading", "lead\n# A\nx\n## B ##\n\n", "#  \n####### seven\n# \n#tag\n # indented\n", "\n# Only\n", "a\r\n# C\r\nb\x0cd"]
    rows = corpus.sections(spark.createDataFrame([(f"{i}.md", t) for i, t in enumerate(texts)], "path string, raw string")).collect()
    got = [(r.path[0], r.start_line, r.end_line, r.heading, r.level) for r in rows]
    assert sorted(got) == [("2", 1, 1, "(document)", 0), ("3", 1, 1, "(preamble)", 0), ("3", 2, 3, "A", 1), ("3", 4, 5, "B ##", 2), ("4", 1, 5, "", 1), ("5", 2, 2, "Only", 1), ("6", 1, 1, "(preamble)", 0), ("6", 2, 4, "C", 1)]
    assert "".join(r.text for r in sorted(rows, key=lambda r: r.start_line) if r.path == "6.md") == texts[6]


def test_chunks(spark):
    df = spark.createDataFrame([("a.py", "".join(f"{i}\n" for i in range(81))), ("b.txt", "")], "path string, raw string")
    assert [(r.path, r.start_line, r.end_line, r.heading) for r in corpus.sections(df).collect()] == [("a.py", 1, 80, "Lines 1–80"), ("a.py", 81, 81, "Lines 81–81")]
    texts = ["x" * 25_000, "word " * 4_001, "", "short", "y" * 10_000, "a " + "z" * 12_000, ("l" * 70 + "\n") * 300, "é" * 6000 + " " + "é" * 6000]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", corpus.text_pieces(corpus.F.col("text")).alias("p")).collect()
    got = {r.i: r.p for r in rows}
    assert [len(c) for c in got[0]] == [10_000, 10_000, 5_000] and got[2] == [] and got[3] == ["short"] and len(got[4]) == 1
    for i, text in enumerate(texts):
        assert "".join(got[i]) == text and all(0 < len(c) <= 10_000 for c in got[i])
    assert [len(c) for c in got[5]] == [10_000, 2_002] and all(c.endswith("\n") for c in got[6]) and len(got[7][0]) == 6_001


def test_lint(spark, root):
    got = {(r.path, r.level, r.message) for r in cli.lint(spark, root).collect()}
    assert ("src/code.md", "error", "missing YAML frontmatter") in got and ("_private/x.md", "error", "missing YAML frontmatter") in got
    assert ("index.md", "error", "dangling link: gone.md") in got and ("guide.md", "warning", "missing recommended field: timestamp") in got
    assert not any("pic.png" in m or "src/code" in m for _, _, m in got)


def test_index_and_query(spark, root):
    assert cli.index(spark, root) == 3
    text = open(f"{root}/index.md").read()
    assert "## Directories\n\n* [_private](_private/) — _private concepts\n* [src](src/) — src concepts\n\n## Concepts\n\n* [Guide](guide.md) — How to start\n" in text
    top = cli.query(spark, root, "line 81", "fts").first()
    assert (top.path, top.start_line) == ("src/long.py", 1)
    assert cli.query(spark, root, "zzz").count() == 2  # nothing matches: the first documents


def test_synopsis(spark, root):
    rows = corpus.concepts(bundle.files_of(bundle.load(spark, root)))
    got = {r.path: r.synopsis for r in links.synopses(rows, corpus.sections(rows)).collect()}
    assert "- L8-11 h1 First\n- L12-13 h2 Second" in got["guide.md"]


def test_sidecar_is_stale_after_an_edit(spark, root, tmp_path):
    target = str(tmp_path / "state")
    tree = bundle.load(spark, f"{root}/src")
    assert sidecar.build(spark, tree, target) and not sidecar.build(spark, tree, target)
    assert sidecar.read_docs(spark, target).count() == 5
    (tmp_path / "src/code.md").write_text("changed")
    assert not sidecar.is_fresh(spark, target, sidecar.content_hash(bundle.load(spark, f"{root}/src")))


def test_fixtures(spark, tmp_path):
    p = tmp_path / "q.jsonl"
    p.write_text('# comment\n\n{"id": "a", "query": "x?", "gold": [{"path": "p", "start_line": 1, "end_line": 2}]}\n{"query": "y", "gold": []}\n')
    assert fixtures.load_fixtures(spark, str(p)).count() == 2
    assert [tuple(r) for r in fixtures.load_gold(spark, str(p)).collect()] == [("a", "p", 1, 2)]


def _chat():
    def chat(system, user):
        if "empty.md" in user and "must not" not in user:
            return ""
        if user.startswith("Make this one"):
            return "s" * 30
        return "long " * 100 if "long.py" in user else "about " + user.split("\n")[0][-30:]

    return chat


def test_prepare(spark, root, tmp_path):
    (tmp_path / "src/empty.md").write_text("x")
    rows = {r.dir: r for r in author.prepare(bundle.load(spark, root), _chat, "top").collect()}
    assert set(rows) == {"", ".github", "_private", "src"} and not rows[""].written and rows["src"].written
    assert "- [long.py](long.py) — " + "s" * 30 in rows["src"].content and "- `nul.bin` — binary or non-UTF-8; contents were not summarized." in rows["src"].content
    forced = {r.dir: r for r in author.prepare(bundle.load(spark, root), _chat, "top", force=True).collect()}
    assert "- [src](src/) — " in forced[""].content and forced[""].written
    assert author.write_indexes(spark.createDataFrame([("src", "new")], "dir string, content string"), root) == 1 and open(f"{root}/src/index.md").read() == "new"


def _sentences(spark, answer):
    rows = spark.createDataFrame([("x",)], "prompt string")
    return author.sentences(rows, lambda: answer).first().summary


def test_sentences(spark):
    long_ = _sentences(spark, lambda s, u: "word " * 200)
    assert long_.endswith("word.") and len(long_) <= 400
    assert _sentences(spark, lambda s, u: " two\n  lines " if "must not" in u else " ") == "two lines"
    assert _sentences(spark, lambda s, u: "brief" if u.startswith("Make this one") else "word " * 200) == "brief"
    with pytest.raises(Exception, match="empty summary"):
        _sentences(spark, lambda s, u: " ")


def test_summaries_of_many_pieces(spark):
    rows = spark.createDataFrame([("d", "a", "a", "word " * 40_000), ("d", "b", "b", ""), ("d", "c", "c", "one")], "dir string, name string, subject string, text string")
    asked = author._summaries(rows, lambda: lambda s, u: f"g{u.count('- ')}" if u.startswith("Make one") else "p", "dir", "name")
    assert {r.name: r.summary for r in asked.collect()} == {"a": "g3", "b": "Empty file.", "c": "p"}
