import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from gleaner.llm.rolling import blocks
from gleaner.llm.suffix_dedup import pieces_of, suffix_dedup
from gleaner.llm import suffix_sort
from gleaner.llm import suffix_dedup as suffix_dedup_module
from gleaner.llm.suffix_sort import sort_suffixes


def brute(rows, window=100):
    seen, out = set(), {}
    for i, text in sorted(rows):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - window + 1):
            w = data[p : p + window]
            if w in seen:
                gone[p : p + window] = b"\1" * window
            seen.add(w)
        spans = sum(1 for p in range(len(data)) if gone[p] and (p == 0 or not gone[p - 1]))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out[i] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def made(n, seed):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(1, 9))) for _ in range(300)]
    text = lambda k: " ".join(rnd.choice(words) for _ in range(k))
    line, passage = text(10), text(60)
    docs = [None, "", "x", "-" * 900, "For " * 300, "ab" * 200, "-" * 100, "-" * 99]
    for _ in range(n):
        kind = rnd.randrange(6)
        if kind == 0 and docs[-1]:
            docs.append(rnd.choice(docs))
        elif kind == 1:
            docs.append(f"{text(rnd.randrange(40))} {passage} {text(rnd.randrange(40))}")
        elif kind == 2:
            docs.append(f"{text(20)}\n{line}\n{text(20)}")
        elif kind == 3 and docs[-1]:
            base = rnd.choice(docs) or "y"
            at = rnd.randrange(len(base) + 1)
            docs.append(base[:at] + text(2) + base[at:])
        else:
            docs.append(text(rnd.randrange(200)))
    return list(enumerate(docs))


@pytest.mark.parametrize("limits", [{}, {"hot_texts": 3}, {"shard_bytes": 3000}])
def test_equals_brute_force(spark, limits):
    rows = made(120, 5)
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, uid int, s string").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup(df, **limits).collect()}
    assert got == brute(rows)


def test_long_texts_are_cut_into_blocks():
    long_ = "".join(random.Random(4).choice("abcdefgh") for _ in range(3000))
    texts = [long_ + "tail", "q", "q" + long_ * 2]
    covered = {i: set() for i in range(3)}
    for data, rows, starts, ends, offsets in blocks(pa.array(texts), 99, 700):
        for _, _, _, t, a, b, _ in zip(*pieces_of(data, starts, ends, 100, 24)):
            covered[int(rows[t])] |= set(range(int(a + offsets[t] - starts[t]), int(b + offsets[t] - starts[t])))
    assert all(covered[i] == set(range(len(t) - 99)) for i, t in enumerate(texts))


def test_repeated_and_missing_ids(spark):
    df = spark.createDataFrame([(None, "z" * 150), (7, "z" * 150), (7, "z" * 150), (3, None)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_removed) for r in suffix_dedup(df).collect())
    assert got == [(-1, 149), (3, 0), (7, 150), (7, 150)]
    assert suffix_dedup(df.limit(0)).collect() == []


def shared(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


@pytest.mark.parametrize(("memory", "in_memory"), [(1 << 20, 1 << 20), (8, 2)])  # in memory; on disk, with recursion
def test_order_and_common_prefixes(memory, in_memory):
    rnd = random.Random(1)
    for trial in range(150):
        text = bytearray()
        while len(text) < rnd.randrange(1, 300):
            text += bytes([rnd.choice(b"aabc")]) * rnd.choice([1, 1, 2, 3, 60])
        data, depth = np.frombuffer(bytes(text), np.uint8), rnd.choice([3, 20, 500])
        order, lcp = sort_suffixes(data, depth, memory, in_memory)
        cut = [bytes(text[i : i + depth]) for i in order]
        assert sorted(order.tolist()) == list(range(len(text))) and cut == sorted(cut)
        assert lcp.tolist() == [0, *(shared(x, y) for x, y in zip(cut, cut[1:]))]


def test_shards_spill_at_production_settings(monkeypatch):
    """A shard of the usual size goes through the file, and its removed windows are those of a plain count."""
    spilled = []
    close = suffix_sort.DiskQueue.close
    monkeypatch.setattr(suffix_sort.DiskQueue, "close", lambda self: (spilled.append(self.spilled), close(self)))
    rnd = random.Random(2)
    words = [bytes(rnd.choice(b"abcdefgh ") for _ in range(rnd.randrange(2, 9))) for _ in range(4000)]
    passage = b" ".join(rnd.choice(words) for _ in range(400))
    texts = []
    while sum(map(len, texts)) < suffix_dedup_module.SHARD_BYTES:
        body = b" ".join(rnd.choice(words) for _ in range(3000))
        texts.append(body + (passage if rnd.random() < 0.2 else b""))
    seen, want = set(), set()
    for i, t in enumerate(texts):
        for p in range(len(t) - 99):
            w = t[p : p + 100]
            (want.add((i, p)) if w in seen else seen.add(w))
    got = set()
    for batch in suffix_dedup_module.sort_shard(np.arange(len(texts)), np.zeros(len(texts), np.int64), texts, 100):
        for uid, s, e in zip(batch.column("uid").to_pylist(), batch.column("s").to_pylist(), batch.column("e").to_pylist()):
            got |= {(uid, p) for p in range(s, e)}
    assert got == want and len(want) > 10_000
    assert max(spilled) > 5 * suffix_sort.MEMORY  # several times what the queues may hold


def test_strings_that_collide_under_polynomials(spark):
    a, b = "a", "b"
    for _ in range(12):
        a, b = a + b, b + a
    rows = [(1, a[:1024]), (2, b[:1024]), (3, a), (4, b)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup(df).collect()}
    assert got == brute(rows)
