import math
import random

import numpy as np

from gleaner.llm import quality
from gleaner.llm.quality import classify, content_features, op1_quality_cotraining, page_features, rising

SF = "/root/testdata/sf0.01"


def test_agrees_with_labels_of_every_fold(spark):
    got = {r.doc_id: r for r in op1_quality_cotraining(spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    assert len(got) == 1000
    right = [got[r.doc_id].keep == bool(r.quality) for r in labels]
    assert np.mean(right) >= 0.97
    assert all(0 <= r.quality_score <= 1 for r in got.values())


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    shown, hidden = labels.filter("doc_id % 2 = 0"), {r.doc_id: r.quality for r in labels.filter("doc_id % 2 = 1").collect()}
    got = {r.doc_id: r.keep for r in classify(docs, shown).collect()}
    assert np.mean([got[i] == bool(q) for i, q in hidden.items()]) >= 0.95


def test_odd_rows_and_labels(spark):
    docs = spark.createDataFrame([(None, None, "x"), (1, "", "y"), (1, "good words here", "z"), (2, "퟿" * 40000, None)], "doc_id long, text string, content string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None), (9, 0)], "doc_id long, quality int")
    rows = classify(docs, labels).collect()
    assert len(rows) == 4 and all(r.keep and r.quality_score == 1.0 for r in rows)  # labels of one class only
    both = labels.union(spark.createDataFrame([(2, 0)], "doc_id long, quality int"))
    assert len(classify(docs, both).collect()) == 4
    assert classify(docs, labels.limit(0)).first().quality_score == 0.5
    assert classify(docs.limit(0), labels).collect() == []


def test_pooling():
    assert rising(np.array([1.0, 0.0, 2.0, 1.0]), np.ones(4)).tolist() == [0.5, 0.5, 1.5, 1.5]


def plain(docs, labels, rounds=2):
    """The whole of it in plain Python, one row after the other."""
    size = {"content": quality.CONTENT, "page": quality.PAGE_VALUES * quality.LEVELS}
    rows = {i: {"content": [int(x) for x in content_features(t)], "page": [int(x) for x in page_features(t, a, b)]} for i, t, a, b in docs}
    value = lambda f, n: 1 / math.sqrt(n) if f < quality.CONTENT - quality.PATTERNS else 1.0
    number, fold = labels["number"], labels["fold"]
    order = sorted(rows, key=lambda i: number[i])
    known = labels["label"]
    shown, pool, held = [i for i in order if i in known and fold[i] > 0], [i for i in order if i not in known], [i for i in rows if i in known and fold[i] == 0]
    share = sum(known.values()) / len(known)

    def score(w, v, i):
        f = rows[i][v]
        return sum(w[x] * value(x, len(f)) for x in f) + w[-1]

    def fit(w, v, examples):
        w, squares = list(w), [1e-6] * (size[v] + 1)
        steps = max(1, -(-len(examples) // quality.MINI))
        for _ in range(max(quality.EPOCHS, -(-quality.STEPS // steps))):
            for at in range(0, len(examples), quality.MINI):
                some = examples[at : at + quality.MINI]
                g = [0.0] * len(w)
                for i, y in some:
                    error = 1 / (1 + math.exp(-max(-30, min(30, score(w, v, i))))) - y
                    for x in rows[i][v]:
                        g[x] += error * value(x, len(rows[i][v])) / len(some)
                    g[-1] += error / len(some)
                for k in range(len(w)):
                    d = g[k] + quality.RIDGE * w[k]
                    squares[k] += d * d
                    w[k] -= quality.RATE * d / math.sqrt(squares[k])
        return w

    def curve(w, v):
        scores = [score(w, v, i) for i in known]
        edges = [min(scores) + (max(scores) - min(scores)) * k / (quality.CURVE - 1) for k in range(quality.CURVE)]
        edges[-1] = max(scores)
        seen = [[0.04 * (1 - share), 0.04 * share] for _ in edges]
        for i in held:
            s = score(w, v, i)
            seen[min(quality.CURVE - 1, sum(e < s for e in edges))][known[i]] += 1
        return edges, rising(np.array([b / (a + b) for a, b in seen]), np.array([a + b for a, b in seen]))

    models = {v: fit([0.0] * (size[v] + 1), v, [(i, known[i]) for i in shown]) for v in size}
    curves = {v: curve(models[v], v) for v in size}
    p = lambda v, i: float(np.interp(score(models[v], v, i), *curves[v]))
    for _ in range(rounds):
        told = {v: [(i, int(q >= 0.5)) for i in pool if max(q := p(o, i), 1 - q) >= quality.CONFIDENT] for v, o in (("content", "page"), ("page", "content"))}
        models = {v: fit(models[v], v, [(i, known[i]) for i in shown] + told[v]) for v in size}
        curves = {v: curve(models[v], v) for v in size}
    return {i: (p("content", i), p("page", i)) for i in rows}


def test_equals_a_plain_version(spark, monkeypatch):
    monkeypatch.setattr(quality, "STEPS", 12)
    rnd = random.Random(2)
    good, bad = [f"w{i}" for i in range(60)], ["$$$", "!!", "BUY", "||", "x1"]
    docs, label = [], {}
    for i in range(90):
        fine = rnd.random() < 0.6
        docs.append((i, " ".join(rnd.choice(good if fine or rnd.random() < 0.4 else bad) for _ in range(rnd.randrange(4, 25))), rnd.choice(["en", "de"]), "s"))
        if i < 60:
            label[i] = int(fine)
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame(list(label.items()), "doc_id long, quality int")
    made = {r.doc_id: r for r in quality.features(df).selectExpr("doc_id", "xxhash64(doc_id, content, page) AS number", "cast(pmod(xxhash64(doc_id, 7), 5) AS int) AS fold").collect()}
    want = plain(docs, {"label": label, "number": {i: r.number for i, r in made.items()}, "fold": {i: r.fold for i, r in made.items()}})
    for parts in (1, 5):  # the same for any partitions
        got = {r.doc_id: (r.content_score, r.page_score) for r in classify(df.repartition(parts), labels).collect()}
        worst = max(abs(min(max(a, 1e-4), 1 - 1e-4) - b) for i in want for a, b in zip(want[i], got[i]))
        assert worst < 2e-6
