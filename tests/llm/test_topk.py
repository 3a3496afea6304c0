import math

import numpy as np

from gleaner.llm.topk import top_k


def brute(rows, every, k):
    good = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in {i: a for i, a in good if i % every == 0}.items():
        hits = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q)[:k]
        out |= {(q, r, i, -s) for r, (s, i) in enumerate(hits, 1)}
    return out


def check(spark, rows, **kw):
    got = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), every=5, k=10, **kw).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows, 5, 10))


def test_random_ties_and_chunks(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=40)]) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(40)]  # one vector many times
    check(spark, rows)
    check(spark, rows, chunk=16)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [float("nan"), 1.0]), (3, [None, 1.0]), (5, [0.0, float("inf")]), (6, [3.0, -1.0]), (10, [0.5, 0.25])]
    check(spark, rows)
    check(spark, rows[:1])
    check(spark, [])


def test_beyond_double_precision(spark):
    rows = [(i, [float(np.float32(2.0**20 + i)), float(np.float32(3.0**9 * i))]) for i in range(12)]
    check(spark, rows)


def test_repeated_ids_are_stable_and_columns_are_ignored(spark):
    rows = [(100, [3.0, 1.0], "x", 0.5), (100, [1.0, 2.0], "y", 0.1), (1, [1.0, 0.0], "z", 0.2), (2, [0.0, 1.0], "z", 0.3), (2, [0.0, 1.0], "z", 0.3)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "vec_id long, embedding array<double>, query_id string, score double").repartition(3)
        got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in sorted(top_k(df).collect(), key=lambda r: r["rank"])]
        assert got == [(100, 1, 2, 2 << 20), (100, 2, 2, 2 << 20), (100, 3, 1, 1 << 20)]


def test_huge_components_are_cut_to_long(spark):
    df = spark.createDataFrame([(0, [1e300, 1.0]), (1, [1e300, 2.0]), (2, [-1e300, 0.0])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in sorted(top_k(df).collect(), key=lambda r: r["rank"])] == [(1, (1 << 63) - 1), (2, -(1 << 63))]
