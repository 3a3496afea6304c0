import hashlib
import random
import re

import pyarrow as pa

from gleaner.llm.cover_dedup import COVER, PERIOD, cover_dedup
from gleaner.llm.words import word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    first = {}
    docs = {i: WORD.findall(t or "") for i, t in rows}
    for i in sorted(docs):
        w = docs[i]
        for p in range(len(w) - 49):
            first.setdefault(tuple(w[p : p + 50]), i)
    out = {}
    for i, w in docs.items():
        gone = set()
        for p in range(len(w) - 49):
            if first[tuple(w[p : p + 50])] < i:
                gone |= set(range(p, p + 50))
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())
    return out


def made(n, seed):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}é" for i in range(400)]
    words = lambda k: [rnd.choice(vocabulary) for _ in range(k)]
    passages = [words(rnd.randrange(45, 120)) for _ in range(4)]
    docs = [None, "", " \t", "a " * 400, "a " * 300, "b " * 49 + "a", " ".join(words(60))]
    for _ in range(n):
        kind = rnd.randrange(5)
        if kind == 0:
            docs.append(rnd.choice(docs))
        elif kind == 1:
            docs.append("\n".join(words(rnd.randrange(60)) + rnd.choice(passages) + words(rnd.randrange(60))))
        elif kind == 2:
            base = (rnd.choice(docs) or "").split()
            at = rnd.randrange(len(base) + 1)
            docs.append(" ".join(base[:at] + words(1) + base[at:]))
        else:
            docs.append(" ".join(words(rnd.randrange(150))))
    return list(enumerate(docs))


def test_cover():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


def test_equals_brute_force(spark):
    rows = made(150, 3)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, known string, uid int").repartition(6)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in cover_dedup(df).collect()}
    assert got == brute(rows)


def test_repeated_and_missing_ids(spark):
    text = " ".join(map(str, range(60)))
    df = spark.createDataFrame([(None, text), (7, text), (7, text), (3, None)], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.n_removed) for r in cover_dedup(df).collect()) == [(-1, 0), (3, 0), (7, 60), (7, 60)]
    assert cover_dedup(df.limit(0)).collect() == []


def test_long_texts_are_cut_between_words():
    texts = ["one two", "x" * 50 + " y " * 40 + "z" * 70, None, "last"]
    texts = [t or "" for t in texts]
    whole = {int(r): h[b[k] : b[k + 1]].tolist() for rows, h, b in word_hashes(pa.array(texts)) for k, r in enumerate(rows)}
    small = {int(r): h[b[k] : b[k + 1]].tolist() for rows, h, b in word_hashes(pa.array(texts), size=16) for k, r in enumerate(rows)}
    assert whole == small and [len(whole[i]) for i in range(4)] == [2, 42, 0, 1]


def test_words_that_collide_under_polynomials(spark):
    for n in (10, 12):
        a, b = "a", "b"
        for _ in range(n):
            a, b = a + b, b + a
        other = [f"w{i}" for i in range(60)]
        rows = [(1, " ".join(other[:30] + [a] + other[30:])), (2, " ".join(other[:30] + [b] + other[30:])), (3, " ".join(other[:30] + [a] + other[30:]))]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in cover_dedup(df).collect()}
        assert got == brute(rows) and got[2][1] == 0
