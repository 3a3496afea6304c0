"""Removal of repeated byte strings by suffix sorting in shards.

A window is WINDOW bytes of one document. Windows are cut into pieces, runs of neighbours with the
same minimizer (the smallest hash of the GRAM-byte strings inside), so equal windows stand in
pieces of one key, wherever they occur. Equal pieces are merged: all but the first are removed
whole. The first holders of pieces whose key has several texts (or which may repeat inside
themselves) are dealt into shards by key, and each shard is suffix-sorted by external induced
sorting; neighbours with a common prefix of WINDOW bytes are equal windows, and all but the first
occurrence go. Keys with very many texts are settled window by window instead, by wide digests
that spread over all tasks. A cluster never sorts more than these holders, and no shard holds
more than its share of keys. A shard's suffixes and their common prefixes need more than the queues
hold in memory, so they are spilled; the shard's texts are in memory.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, map_arrow, parts, unique_ids
from .removal import GONE, HOLDER, OCCURRENCE, OPEN, batch_of, byte_digests, finish, first_of_each, gone_by_document, joined, spread
from .rolling import blocks, grams, merged, signed, sliding
from .suffix_sort import sort_suffixes

WINDOW, GRAM = 100, 24
#: Bytes sorted together, and the number of texts of one key from which it is settled by windows.
SHARD_BYTES, HOT_TEXTS = 4 << 20, 2000
RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def pieces_of(data, starts, ends, window: int, gram: int):
    """(key, digest in two halves, text, first window, end of windows, may repeat inside) of a block's pieces, in order."""
    w = window - gram + 1
    n = len(data) - window + 1
    if n <= 0:
        return [np.empty(0, t) for t in (np.uint64, np.int64, np.int64, np.int64, np.int64, np.int64, bool)]
    h = grams(data, gram) | np.uint64(1)
    m = sliding(h, w)[:n]
    valid = np.zeros(n + 1, np.int8)
    long_ = ends - starts >= window
    valid_at = np.zeros(n + 1, np.int64)
    np.add.at(valid_at, starts[long_], 1)
    np.add.at(valid_at, np.minimum(ends[long_] - window + 1, n), -1)
    valid = np.cumsum(valid_at[:n]) > 0
    m = np.where(valid, m, np.uint64(0))
    opens = np.zeros(n, bool)
    opens[starts[long_]] = True
    opens[1:] |= m[1:] != m[:-1]
    opens[0] = True
    s = np.flatnonzero(opens)
    e = np.append(s[1:], n)
    use = valid[s]
    # a key's gram that stands twice within one piece: windows there may be equal
    largest = sliding(np.concatenate([np.zeros(w - 1, np.uint64), m, np.zeros(max(0, len(h) - n), np.uint64)]), w, np.maximum)[: len(h)]
    places = np.flatnonzero(largest == h)
    a, b = places[:-1], places[1:]
    twice = (h[a] == h[b]) & (b - a <= w)
    flag = np.zeros(len(s), bool)
    if twice.any():
        a, b = a[twice], b[twice]
        low, high = np.searchsorted(s, np.maximum(b - w, 0), "right") - 1, np.searchsorted(s, np.minimum(a + 1, n - 1), "right") - 1
        for step in range(int((high - low).max()) + 1):
            at = np.minimum(low + step, high)
            flag[at[m[s[at]] == h[a]]] = True
    s, e, flag = s[use], e[use], flag[use]
    text = np.searchsorted(starts, s, "right") - 1
    return m[s], *byte_digests(data.tobytes(), s, e + window - 1), text, s, e, flag


def occurrences(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row for each piece; of equal pieces in a batch of documents only the first stays open."""

    def run(batches):
        for batch in batches:
            uids = batch.column(0).to_numpy()
            found = []
            for data, rows, starts, ends, offsets in blocks(batch.column(1), window - 1):
                key, digest, more, text, s, e, flag = pieces_of(data, starts, ends, window, gram)
                shift = offsets[text] - starts[text]
                found.append((signed(key), digest, more, uids[rows[text]], (s + shift).astype(np.int32), (e + shift).astype(np.int32), flag))
            if not found:
                continue
            key, digest, more, uid, s, e, flag = (np.concatenate(c) for c in zip(*found))
            if not len(uid):
                continue
            order, first = first_of_each(key, digest, more, uid, s)
            yield batch_of(OPEN, *(c[order[first]] for c in (key, digest, more, uid, s, e, flag)))
            yield from gone_rows(uid[order[~first]], s[order[~first]], e[order[~first]])

    return map_arrow(docs.select("uid", "text"), run, OCCURRENCE)


def gone_rows(uid, s, e):
    """Removed windows; those that follow each other in a document become one row."""
    if not len(uid):
        return
    order = np.lexsort((s, uid))
    uid, s, e = uid[order], s[order].astype(np.int64), e[order].astype(np.int64)
    heads = np.flatnonzero(np.concatenate([[True], (uid[1:] != uid[:-1]) | (s[1:] > e[:-1])]))
    yield batch_of(GONE, 0, 0, 0, uid[heads], s[heads].astype(np.int32), np.maximum.reduceat(e, heads).astype(np.int32), False)


def settle_pieces(batches, hot_texts: int = HOT_TEXTS):
    """Of all occurrences of some keys: the first of each piece is kept, the others are gone; first
    holders of keys with several texts, or which may repeat inside, go on (flag: very many texts)."""
    held = list(batches)
    if not held:
        return
    _, key, digest, more, uid, s, e, flag = joined(pa.Table.from_batches(held))
    if not len(uid):
        return
    order, first = first_of_each(key, digest, more, uid, s)
    yield from gone_rows(uid[order[~first]], s[order[~first]], e[order[~first]])
    order = order[first]
    k = key[order]
    heads = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    texts = np.repeat(np.diff(np.append(heads, len(k))), np.diff(np.append(heads, len(k))))
    on = (texts > 1) | flag[order]
    order, texts = order[on], texts[on]
    if len(order):
        yield batch_of(HOLDER, key[order], digest[order], more[order], uid[order], s[order], e[order], texts > hot_texts)


def shard_rows(docs: DataFrame, holders: DataFrame, window: int) -> DataFrame:
    """The texts of the holders' pieces; of very frequent keys the digest of each window instead."""
    lists = holders.groupBy("uid").agg(F.collect_list(F.struct("key", "s", "e", "flag")).alias("p"))
    rows = docs.join(lists, "uid").select("uid", "text", F.col("p.key").alias("key"), F.col("p.s").alias("s"), F.col("p.e").alias("e"), F.col("p.flag").alias("flag"))

    def run(batches):
        for batch in batches:
            out = []
            for uid, text, key, s, e, flag in zip(*(batch.column(i) for i in range(6))):
                uid, data = uid.as_py(), text.as_py().encode()
                for k, a, b, hot in zip(key.values.to_pylist(), s.values.to_pylist(), e.values.to_pylist(), flag.values.to_pylist()):
                    if not hot:
                        out.append((k, uid, a, data[a : b + window - 1], False))
                        continue
                    for p in range(a, b):
                        out.append((int.from_bytes(hashlib.blake2b(data[p : p + window], digest_size=8).digest(), "little", signed=True), uid, p, hashlib.blake2b(data[p : p + window], digest_size=16).digest(), True))
                if len(out) > 20_000:
                    yield _shard_batch(out)
                    out = []
            if out:
                yield _shard_batch(out)

    return map_arrow(rows, run, "key long, uid long, s int, data binary, hot boolean")


def _shard_batch(rows) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["key", "uid", "s", "data", "hot"])


def sort_shard(uid: np.ndarray, s: np.ndarray, texts: list[bytes], window: int):
    """(uid, window) of the windows that also occur earlier, by suffix sorting of all texts."""
    sizes = np.array([len(t) + 1 for t in texts])
    data = np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8)  # no UTF-8 text holds this byte
    first = np.cumsum(sizes) - sizes
    order, shared = sort_suffixes(data, window)
    owner = np.searchsorted(first, order, "right") - 1
    at = order - first[owner]
    # whole windows that are equal are neighbours: what stands between them begins with the same bytes
    whole = at + window <= sizes[owner] - 1
    owner, at, shared = owner[whole], at[whole], shared[whole]
    if not len(owner):
        return
    group = np.cumsum(shared < window)
    doc, place = uid[owner], s[owner] + at
    by = np.lexsort((place, doc, group))
    again = np.zeros(len(by), bool)
    again[1:] = group[by][1:] == group[by][:-1]
    yield from gone_rows(doc[by[again]], place[by[again]], place[by[again]] + 1)


def settle_shards(window: int, shard_bytes: int, shards: int):
    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        hot = table.filter(table["hot"])
        if hot.num_rows:
            digest = np.frombuffer(b"".join(hot["data"].to_pylist()), np.int64).reshape(-1, 2)
            uid, s = hot["uid"].to_numpy(), hot["s"].to_numpy()
            order, first = first_of_each(digest[:, 0], digest[:, 1], digest[:, 1], uid, s)
            yield from gone_rows(uid[order[~first]], s[order[~first]], s[order[~first]] + 1)
        cold = table.filter(pa.compute.invert(table["hot"]))
        shard = cold["shard"].to_numpy()
        for k in np.unique(shard):
            at = np.flatnonzero(shard == k)
            part = cold.take(at)
            yield from sort_shard(part["uid"].to_numpy(), part["s"].to_numpy().astype(np.int64), part["data"].to_pylist(), window)

    return run


def repeated_windows(docs: DataFrame, scratch: Scratch, window: int = WINDOW, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, hot_texts: int = HOT_TEXTS) -> DataFrame:
    """uid, gone: for each document with any, the windows that also start earlier."""
    spark = docs.sparkSession
    found = scratch.write(occurrences(docs, window, gram), "occurrences")
    n = parts(spark)
    rows = found.count()
    many = max(n, -(-rows // 400_000))
    settled = map_arrow(spread(found.filter(F.col("kind") == OPEN), many, "key"), lambda b: settle_pieces(b, hot_texts), OCCURRENCE)
    settled = scratch.write(settled, "settled")
    early = scratch.write(found.filter(F.col("kind") == GONE), "early")
    scratch.drop(found)  # most of its rows are settled; they need not stay on disk
    holders = settled.filter(F.col("kind") == HOLDER)
    size = holders.agg(F.sum(F.col("e") - F.col("s") + (window - 1))).first()[0] or 0
    shards = max(n, -(-size // shard_bytes))
    texts = shard_rows(docs, holders, window).withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))
    sorted_ = map_arrow(spread(texts, shards, "shard"), settle_shards(window, shard_bytes, shards), OCCURRENCE)
    return gone_by_document(early, settled, scratch.write(sorted_, "sorted"))


def remove_windows(window: int):
    def one(text: str, s: np.ndarray, e: np.ndarray):
        data = text.encode()
        a, b = merged(s, e + window - 1)
        kept = hashlib.sha256()
        at = 0
        for x, y in zip(a.tolist(), b.tolist()):
            kept.update(data[at:x])
            at = y
        kept.update(data[at:])
        return len(data), int((b - a).sum()), len(a), kept.hexdigest()

    return one


def cut_text(window: int):
    def one(text: str, s: np.ndarray, e: np.ndarray):
        data = text.encode()
        a, b = merged(s, e + window - 1)
        keep = [data[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(data)])]
        return (b"".join(keep).decode("utf-8", "ignore"),)

    return one


def suffix_dedup(docs: DataFrame, window: int = WINDOW, name: str = "suffix_dedup", **limits) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of docs.

    A byte goes if a window over it also starts earlier (in a smaller doc_id, or earlier in the
    same document). Null text counts as empty. Rows that repeat a doc_id, or have none, count as
    documents of their own, null ids first, equal ids in the order of their texts.
    """
    scratch = Scratch(docs.sparkSession, name)
    rows, _ = unique_ids(docs, scratch)
    return finish(rows, repeated_windows(rows, scratch, window, **limits), remove_windows(window), RESULT).drop("uid")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
