import random
import re

import numpy as np

from gleaner.llm import near_dedup
from gleaner.llm.near_dedup import BINS, near_duplicates, signatures

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n):
    w = WORD.findall((text or "").translate(LOW))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, n):
    sets = {i: shingles(t, n) for i, t in rows}
    label = {i: i for i in sets}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                p, q = sorted((top(i), top(j)))
                label[q] = p
    return {i: (len(sets[i]), top(i), top(i) == i) for i in ids}


def made(n, seed):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}É" for i in range(500)]
    docs = [None, "", " ", "one", "One", "one two", "a b c d e", "a b c d e f"]
    while len(docs) < n:
        base = rnd.choice(docs) if rnd.random() < 0.6 else None
        if base and len(base) > 20:
            w = base.split(" ")
            for _ in range(rnd.randrange(1, max(2, len(w) // 15))):
                w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
            docs.append(" ".join(w).upper() if rnd.random() < 0.2 else " ".join(w))
        else:
            docs.append(" ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(1, 120))))
    return list(enumerate(docs))


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, n int, rep string").repartition(4)
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df, **kw).collect()}


def test_equals_brute_force(spark):
    rows = made(250, 1)
    assert run(spark, rows, shingle=2) == brute(rows, 2)


def test_a_chain_of_neighbours(spark):
    base = [f"t{i}" for i in range(60)]
    rows = []
    for i in range(40):  # each like its neighbours, the ends unlike
        rows.append((i, " ".join(base)))
        base[(i * 7) % 60] = f"n{i}"
    assert run(spark, rows, shingle=2) == brute(rows, 2)


def test_repeated_and_missing_ids(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (7, "q r s t u v"), (7, "q r s t u v"), (3, None)], "doc_id long, text string")
    got = sorted((((r.doc_id or -1), r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df).collect()), key=str)
    assert got == sorted([(-1, 2, None, True), (3, 0, 3, True), (7, 2, None, False), (7, 2, 7, False), (7, 2, 7, True)], key=str)
    assert near_duplicates(df.limit(0)).collect() == []


def test_densified_bins_estimate_likeness():
    rng = np.random.default_rng(0)
    common = rng.integers(0, 2**63, 40).astype(np.uint64) * np.uint64(2)
    own = [rng.integers(0, 2**63, 10).astype(np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2)]
    sets = [np.sort(np.concatenate([common, o])) for o in own]
    sig = signatures(np.repeat([0, 1], 50), np.concatenate(sets), 2)
    assert sig.shape == (2, BINS) and (sig > 0).all()
    assert abs((sig[0] == sig[1]).mean() - 40 / 60) < 0.2


def templated(pages, pairs, seed=5):
    """Pages with a common template, each two of them a little less alike than asked, and some pairs just alike enough."""
    rnd = random.Random(seed)
    template = [f"t{i}" for i in range(176)]
    own = lambda i, k: [f"o{i}x{rnd.randrange(10**9)}" for _ in range(k)]
    rows = []
    for i in range(pages):
        mine = own(i, 24)
        rows.append(" ".join(template + mine))
        if i < pairs:  # a twin that has three of the page's own words
            rows.append(" ".join(template + mine[:3] + own(i, 21)))
    rnd.shuffle(rows)
    return list(enumerate(rows))


def test_links_between_leaves_of_a_large_template_group(spark, monkeypatch):
    rows = templated(600, 30)
    want = brute(rows, 2)
    assert 20 <= sum(not kept for _, _, kept in want.values()) <= 60  # pairs, not one large component
    assert run(spark, rows, shingle=2) == want
    monkeypatch.setattr(near_dedup, "SIDE", 48)  # several parts; groups that are buckets
    assert run(spark, rows, shingle=2) == want


def test_common_counts():
    rng = np.random.default_rng(1)
    for docs, words in ((3, 4), (60, 4000), (200, 900)):
        sides = [[np.unique(np.minimum(rng.integers(0, words, 50), rng.integers(0, words, 50))) for _ in range(n)] for n in (docs, docs + 1)]
        flat = [(np.repeat(np.arange(len(s)), [len(x) for x in s]), np.concatenate(s)) for s in sides]
        got = near_dedup.common_counts(*flat, docs, docs + 1)
        assert (got == [[len(np.intersect1d(x, y)) for y in sides[1]] for x in sides[0]]).all()


def thue_morse(n):
    """A word and its complement, of 2**n letters, which collide under polynomials modulo 2**64."""
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def test_words_that_collide_under_polynomials(spark):
    for n in (10, 12):
        x, y = thue_morse(n)
        rows = [(1, f"q {x}"), (2, f"q {y}"), (3, f"q {x}"), (4, x), (5, y)]
        assert run(spark, rows, shingle=2) == brute(rows, 2)


def test_thirty_components_in_one_bucket(spark, monkeypatch):
    """Families around one template: near the pivot's bound, some families linked among themselves only."""
    rnd = random.Random(9)
    template = [f"t{i}" for i in range(150)]
    rows = [" ".join(template)]
    for family in range(30):
        base = list(template)
        for k in range(13 + family % 4):
            base[rnd.randrange(150)] = f"f{family}k{k}"
        for member in range(4):
            w = list(base)
            for _ in range(member):
                w[rnd.randrange(150)] = f"m{family}.{member}.{rnd.randrange(10**6)}"
            rows.append(" ".join(w))
    rows = list(enumerate(rows))
    want = brute(rows, 2)
    assert len({c for _, c, _ in want.values()}) >= 20
    assert run(spark, rows, shingle=2) == want
    monkeypatch.setattr(near_dedup, "SIDE", 16)
    monkeypatch.setattr(near_dedup, "LEAVES", 7)
    assert run(spark, rows, shingle=2) == want
