import hashlib
import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from gleaner.llm.bpe import round_trip
from gleaner.llm.common import Scratch
from gleaner.llm.packing import cut, pack, sum_of_squares, token_pieces
from gleaner.llm import token_counts
from gleaner.llm.token_counts import count_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(PATH)
TEXTS = [None, "", "a", "It's <|endoftext|> fine\n\n  x", "՘ odd ꟏", "word " * 3000, "x" * 5000, "word " * 3000, " \t "]


def table(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "x", i) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string, piece int")


def expected(text):
    return LIB.encode(text or "", add_special_tokens=False).ids


def test_round_trip(spark):
    rows = round_trip(table(spark), PATH).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        ids = expected(TEXTS[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(LIB.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_counts(spark):
    for r in count_tokens(table(spark), PATH).collect():
        n = len(expected(TEXTS[r.doc_id]))
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len((TEXTS[r.doc_id] or "").encode()), n > 1024)


def test_packing(spark):
    rows = pack(token_pieces(table(spark), PATH), Scratch(spark, "t")).collect()
    bins = defaultdict(list)
    for r in rows:
        ids = [*expected(TEXTS[r.doc_id]), 0]
        assert (r.start, r.length) == cut(len(ids), 2048)[r.piece]
        part = ids[r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
        bins[r.sequence_id].append((r.offset, r.length))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(r.length for r in rows) == sum(len(expected(t)) + 1 for t in TEXTS)


def test_groups_and_empty_tables(spark):
    small = pack(token_pieces(table(spark), PATH), Scratch(spark, "t"), group_rows=4).collect()
    assert len({r.sequence_id >> 32 for r in small}) > 1
    none = table(spark, [])
    assert pack(token_pieces(none, PATH), Scratch(spark, "t")).collect() == []
    assert count_tokens(none, PATH).collect() == [] == round_trip(none, PATH).collect()


def test_sum_of_squares_reaches_the_bound():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 2049, 5000)
    bins, offsets = sum_of_squares(lengths, 2048)
    fill = np.bincount(bins, weights=lengths)
    assert fill.max() <= 2048 and len(fill) <= 1.03 * -(-lengths.sum() // 2048)
    assert cut(4097, 2048) == [(0, 1), (1, 2048), (2049, 2048)] and cut(2048, 2048) == [(0, 2048)]


def test_repeated_and_missing_ids(spark):
    df = spark.createDataFrame([(None, "a b"), (7, "a b"), (7, "a b"), (7, None), (7, "it's " * 400)], "doc_id long, text string")
    want = sorted((i or -1, len(expected(t))) for i, t in ((None, "a b"), (7, "a b"), (7, "a b"), (7, None), (7, "it's " * 400)))
    assert sorted((r.doc_id or -1, r.n_tokens) for r in count_tokens(df, PATH).collect()) == want
    assert sorted((r.doc_id or -1, r.n_tokens) for r in round_trip(df, PATH).collect()) == want
    packed = pack(token_pieces(df, PATH), Scratch(spark, "t")).collect()
    assert sorted((r.doc_id or -1, r.length - 1) for r in packed) == want


def test_many_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "BLOCK_WORDS", 2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        for r in count_tokens(table(spark), PATH).collect():
            assert r.n_tokens == len(expected(TEXTS[r.doc_id]))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
