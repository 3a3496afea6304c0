"""Removal of repeated passages of words, found through difference-cover anchors.

Strings of ANCHOR words are hashed only at places whose number modulo PERIOD is in a difference
cover: whatever the two places of an equal window are, some shift below PERIOD takes both to
covered places, so windows of PERIOD - 1 + ANCHOR words or more share an anchor. Documents whose
anchors stand in no other document are finished at once. In the others, the windows around shared
anchors are extended to whole pieces (runs of windows with one minimizer), equal pieces are
settled by their documents' order, and where a piece key has several texts the windows are
compared one by one. Anchors and keys are hashes of words and only find candidates; equality is
decided by 128-bit cryptographic digests of the words' bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, map_arrow, parts, unique_ids
from .removal import GONE, HOLDER, OCCURRENCE, OPEN, batch_of, byte_digests, finish, gone_by_document, joined, spread
from .rolling import Spans, merged, signed, sliding
from .suffix_dedup import gone_rows
from .words import word_hashes

#: A window, the period, a difference cover of it (every difference modulo 31 occurs), an anchor.
WINDOW, PERIOD, COVER = 50, 31, (1, 5, 11, 24, 25, 27)
ANCHOR = WINDOW - PERIOD + 1
RESULT = "n_words long, n_removed long, kept_sha256 string"


def anchors(hashes: np.ndarray, bounds: np.ndarray):
    """(text, place in the text, hash) of the anchors of each text that has a whole window."""
    n = len(hashes) - ANCHOR + 1
    if n <= 0:
        return np.empty(0, int), np.empty(0, int), np.empty(0, np.uint64)
    covered = np.zeros(PERIOD, bool)
    covered[list(COVER)] = True
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[:n]
    place = np.arange(n) - bounds[text]
    size = np.diff(bounds)[text]
    at = np.flatnonzero(covered[place % PERIOD] & (place + ANCHOR <= size) & (size >= WINDOW))
    return text[at], place[at], Spans(hashes).hash(at, at + ANCHOR)


def documents_by_key(key, digest, more, uid):
    """(order by key, digest, document; whether the row's document is its group's smallest)."""
    order = np.lexsort((uid, more, digest, key))
    k, d, m, u = key[order], digest[order], more[order], uid[order]
    heads = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (d[1:] != d[:-1]) | (m[1:] != m[:-1])])) if len(k) else np.empty(0, int)
    return order, u == np.repeat(u[heads], np.diff(np.append(heads, len(k))))


def anchor_rows(docs: DataFrame) -> DataFrame:
    """kind OPEN: an anchor and a document with it, one row for each anchor of a batch (flag: it
    stands in several documents of the batch); kind HOLDER: an anchor shared within the batch."""

    def run(batches):
        for batch in batches:
            uids = batch.column(0).to_numpy()
            found = []
            for rows, hashes, bounds in word_hashes(batch.column(1)):
                text, _, h = anchors(hashes, bounds)
                found.append(np.unique(np.rec.fromarrays([signed(h), uids[rows[text]]], names="h,u")) if len(h) else np.rec.fromarrays([np.empty(0, np.int64)] * 2, names="h,u"))
            rows = np.unique(np.concatenate(found)) if found else []
            if not len(rows):
                continue
            h, u = rows["h"], rows["u"]
            heads = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            shared = np.repeat(np.diff(np.append(heads, len(h))) > 1, np.diff(np.append(heads, len(h))))
            yield batch_of(OPEN, h[heads], 0, 0, u[heads], np.zeros(len(heads), np.int32), np.zeros(len(heads), np.int32), shared[heads])
            if shared.any():
                yield batch_of(HOLDER, h[shared], 0, 0, u[shared], np.zeros(shared.sum(), np.int32), np.zeros(shared.sum(), np.int32), True)

    return map_arrow(docs.select("uid", "text"), run, OCCURRENCE)


def shared_anchors(batches):
    """The anchors that stand in several documents, for the documents that do not know it yet."""
    held = list(batches)
    if not held:
        return
    h, u, flag = joined(pa.Table.from_batches(held))
    if not len(h):
        return
    order = np.argsort(h, kind="stable")
    h, u, flag = h[order], u[order], flag[order]
    heads = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    size = np.diff(np.append(heads, len(h)))
    tell = np.repeat(size > 1, size) & ~flag
    yield pa.RecordBatch.from_arrays([pa.array(h[tell]), pa.array(u[tell])], ["key", "uid"])


def spans_of_words(text: bytes, start: np.ndarray, end: np.ndarray):
    """Digests of the words [start, end) of a text, joined by one space."""
    words = text.split()
    after = np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])])
    return byte_digests(b" ".join(words), after[start], after[end] - 1)


def pieces_of_words(hashes: np.ndarray, known: np.ndarray, text: bytes):
    """(key, digest in two halves, first window, end of windows) of the runs of windows around shared anchors."""
    n = len(hashes) - WINDOW + 1
    _, place, h = anchors(hashes, np.array([0, len(hashes)]))
    place = place[np.isin(signed(h), known)]
    if n <= 0 or not len(place):
        return [np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.int32, np.int32)]
    around = np.zeros(n + 1, np.int64)
    np.add.at(around, np.maximum(0, place - (WINDOW - ANCHOR)), 1)
    np.add.at(around, np.minimum(place + 1, n), -1)
    use = np.cumsum(around[:n]) > 0
    m = sliding(Spans(hashes).every(ANCHOR), WINDOW - ANCHOR + 1)[:n]
    opens = np.ones(n, bool)
    opens[1:] = (m[1:] != m[:-1]) | (use[1:] != use[:-1])
    s = np.flatnonzero(opens)
    e = np.append(s[1:], n)
    s, e = s[use[s]], e[use[s]]
    return signed(m[s]), *spans_of_words(text, s, e + WINDOW - 1), s.astype(np.int32), e.astype(np.int32)


_DOC = "doc_id long, uid long, n_words long, n_removed long, kept_sha256 string, text string, pieces array<struct<key:bigint,digest:bigint,more:bigint,s:int,e:int,late:boolean>>"


def first_look(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Documents without shared anchors, finished; the others with their text and pieces (late: the piece
    also stands in a smaller document of the batch, so it goes and need not be sent on)."""
    lists = known.groupBy("uid").agg(F.collect_set("key").alias("known"))
    rows = docs.join(lists, "uid", "left").select("doc_id", "uid", "text", "known")
    struct = pa.list_(pa.struct([("key", pa.int64()), ("digest", pa.int64()), ("more", pa.int64()), ("s", pa.int32()), ("e", pa.int32()), ("late", pa.bool_())]))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), struct]

    def run(batches):
        for batch in batches:
            doc, uid, text, lists = (batch.column(i) for i in range(4))
            uids, out, found, owner = uid.to_numpy(), [], [], []
            for at, hashes, bounds in word_hashes(text):
                for k, r in enumerate(at.tolist()):
                    h, whole = hashes[bounds[k] : bounds[k + 1]], text[r].as_py()
                    mine = pieces_of_words(h, lists[r].values.to_numpy(), whole.encode()) if lists[r].is_valid else ()
                    if some := bool(len(mine) and len(mine[0])):
                        found.append(mine)
                        owner.append(np.full(len(mine[0]), len(out)))
                    out.append([doc[r].as_py(), uids[r], len(h), 0, None if some else hashlib.sha256(b" ".join(whole.encode().split())).hexdigest(), whole if some else None, [] if some else None])
            if found:
                key, digest, more, s, e = (np.concatenate(c) for c in zip(*found))
                owner = np.concatenate(owner)
                order, first = documents_by_key(key, digest, more, np.array([row[1] for row in out])[owner])
                late = np.empty(len(key), bool)
                late[order] = ~first
                names = ("key", "digest", "more", "s", "e", "late")
                for o, *p in zip(owner.tolist(), *(c.tolist() for c in (key, digest, more, s, e, late))):
                    out[o][6].append(dict(zip(names, p)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 7, kinds)], ["doc_id", "uid", "n_words", "n_removed", "kept_sha256", "text", "pieces"])

    return map_arrow(rows, run, _DOC)


def settle_documents(keep_several: bool):
    """Occurrences in later documents go; with ``keep_several`` the others go on where a key has several texts."""

    def run(batches):
        held = list(batches)
        if not held:
            return
        key, digest, more, uid, s, e = joined(pa.Table.from_batches(held))
        if not len(uid):
            return
        order, first = documents_by_key(key, digest, more, uid)
        late = order[~first]
        yield from gone_rows(uid[late], s[late], e[late])
        order = order[first]
        k, d, m = key[order], digest[order], more[order]
        heads = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        size = np.diff(np.append(heads, len(k)))
        several = (np.repeat(d[heads], size) != d) | (np.repeat(m[heads], size) != m)
        on = order[np.repeat(np.logical_or.reduceat(several, heads), size)]
        if keep_several and len(on):
            yield batch_of(HOLDER, key[on], digest[on], more[on], uid[on], s[on], e[on], False)

    return run


def window_rows(docs: DataFrame, holders: DataFrame) -> DataFrame:
    """Each window of the holders' pieces, by digest; of equal ones in a batch only the first document's stay open."""
    lists = holders.groupBy("uid").agg(F.collect_list(F.struct("s", "e")).alias("p"))
    rows = docs.join(lists, "uid").select("uid", "text", F.col("p.s").alias("s"), F.col("p.e").alias("e"))

    def run(batches):
        for batch in batches:
            uids, lists_s, lists_e = batch.column(0).to_numpy(), batch.column(2), batch.column(3)
            found = []
            for r, text in enumerate(batch.column(1)):
                place = np.unique(np.concatenate([np.arange(a, b) for a, b in zip(lists_s[r].values.to_pylist(), lists_e[r].values.to_pylist())]))
                found.append((*spans_of_words(text.as_py().encode(), place, place + WINDOW), np.full(len(place), uids[r]), place.astype(np.int32)))
            if not found:
                continue
            digest, more, uid, s = (np.concatenate(c) for c in zip(*found))
            order, first = documents_by_key(digest, digest, more, uid)
            late, order = order[~first], order[first]
            yield from gone_rows(uid[late], s[late], s[late] + 1)
            yield batch_of(OPEN, digest[order], digest[order], more[order], uid[order], s[order], s[order] + 1, False)

    return map_arrow(rows, run, OCCURRENCE)


def _without(text: str, s: np.ndarray, e: np.ndarray):
    words = text.encode().split()
    a, b = merged(s, e + WINDOW - 1)
    keep = [w for x, y in zip([0, *b.tolist()], [*a.tolist(), len(words)]) for w in words[x:y]]
    return len(words), int((b - a).sum()), hashlib.sha256(b" ".join(keep)).hexdigest()


def cover_dedup(docs: DataFrame, name: str = "cover_dedup") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row of docs.

    A word goes if a window over it also starts in a document with a smaller doc_id. Null text has
    no words. Rows that repeat a doc_id, or have none, count as documents of their own, null ids
    first, equal ids in the order of their texts.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, name)
    rows, _ = unique_ids(docs, scratch)
    found = scratch.write(anchor_rows(rows), "anchors")
    n = parts(spark)
    many = max(n, -(-found.count() // 400_000))
    told = map_arrow(spread(found.filter(F.col("kind") == OPEN).select("key", "uid", "flag"), many, "key"), shared_anchors, "key long, uid long")
    known = found.filter(F.col("kind") == HOLDER).select("key", "uid").unionByName(told)
    looked = scratch.write(first_look(rows, known), "looked")
    scratch.drop(found)
    open_ = looked.filter("pieces is not null")
    pieces = open_.select("uid", F.explode("pieces").alias("p")).select("p.key", "p.digest", "p.more", "uid", "p.s", "p.e", "p.late")
    settled = scratch.write(map_arrow(spread(pieces.filter("not late").drop("late"), n, "key"), settle_documents(True), OCCURRENCE), "settled")
    early = pieces.filter("late").select(F.lit(GONE).alias("kind"), "uid", "s", "e")
    windows = scratch.write(window_rows(open_.select("uid", "text"), settled.filter(F.col("kind") == HOLDER)), "windows")
    compared = map_arrow(spread(windows.filter(F.col("kind") == OPEN).select("key", "digest", "more", "uid", "s", "e"), n, "key"), settle_documents(False), OCCURRENCE)
    gone = gone_by_document(settled, windows, compared, early)
    done = looked.filter("pieces is null").select("doc_id", "n_words", "n_removed", "kept_sha256")
    return done.unionByName(finish(open_.select("doc_id", "uid", "text"), gone, _without, RESULT).drop("uid"))


def op6_cover_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
