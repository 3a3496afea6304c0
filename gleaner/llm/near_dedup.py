"""Near duplicates by one-permutation hashing.

A document's set of word shingles is hashed once; the hash's leading bits choose a bin, and each
bin keeps its smallest hash. Empty bins borrow by optimal densification: a fixed random walk over
the bins until one is filled. Bands of ROWS bins make bucket keys. Documents with equal sets are
one class from the start. In each bucket the candidate edges form a star around its smallest
document, the bucket's pivot, so a bucket of m documents gives m - 1 edges; most of a family share
one pivot, so there are far fewer different edges. Each edge is confirmed on full sets.

A star can miss a link between two of its leaves x and y. Both leaves differ from the pivot c by a
few shingles only: D(x), those that just one of x and c has. With a = those of x alone, b = those of
c alone and w = percent * a + 100 * b, counting shows that x and y are alike exactly if

    (100 + percent) * |D(x) & D(y)| >= w(x) + w(y) - (100 - percent) * |c|,

and that x is alike to c exactly if w(x) <= (100 - percent) * |c|. So the leaves of a pivot whose
components differ are compared by these differences alone: a leaf goes out if not even its whole
difference could reach the bound, and the rest meet in blocks of about SIDE by SIDE documents, whose
tasks give a spanning forest of the links, so no pairs are written out. All leaves that share a
bucket share its pivot, so no two candidates are left uncompared. Found links join components, not
documents, so the last step works on a table of components.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, map_arrow, unique_ids
from .components import components
from .rolling import Spans, mix, signed
from .words import word_hashes

BINS, ROWS = 128, 4
SHINGLE, PERCENT = 5, 80
#: Leaves that meet one copy of a pivot's set.
LEAVES = 500
#: Documents on one side of a block, and the shingles of their differences.
SIDE, SIDE_SHINGLES = 512, 1 << 20
_SKETCH = "uid long, n long, set1 long, set2 long, bands array<long>"


def shingle_sets(hashes: np.ndarray, bounds: np.ndarray, size: int):
    """(text, hash) of the distinct shingles, ordered by both. A text with fewer words than
    ``size`` has one shingle of all its words; one without words has none."""
    counts = np.diff(bounds)
    n = len(hashes)
    text = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(n) - bounds[:-1][text]
    at = np.flatnonzero((place + size <= counts[text]) | ((place == 0) & (counts[text] < size)))
    owner = text[at]
    h = Spans(hashes).hash(at, at + np.minimum(size, counts[owner]))
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])
    return owner[new], h[new]


def signatures(owner: np.ndarray, h: np.ndarray, n: int, bins: int = BINS) -> np.ndarray:
    """A row of ``bins`` values for each of n texts; texts without shingles keep zeros."""
    where = (h >> np.uint64(64 - (bins - 1).bit_length())).astype(np.int64)
    first = np.ones(len(h), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (where[1:] != where[:-1])
    sig = np.zeros((n, bins), np.uint64)
    filled = np.zeros((n, bins), bool)
    sig[owner[first], where[first]] = h[first]
    filled[owner[first], where[first]] = True
    rows, cols = np.nonzero(~filled & filled.any(axis=1)[:, None])
    attempt = np.uint64(0)
    while len(rows):
        attempt += np.uint64(1)
        source = (mix(cols.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + attempt) % np.uint64(bins)).astype(np.int64)
        found = filled[rows, source]
        sig[rows[found], cols[found]] = sig[rows[found], source[found]]
        rows, cols = rows[~found], cols[~found]
    return sig


def band_keys(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    n, bins = sig.shape
    key = np.broadcast_to(np.arange(bins // rows, dtype=np.uint64), (n, bins // rows)).copy()
    for r in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, r::rows])
    return key


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """uid, set size, 128-bit identity of the set, band keys (null for an empty set)."""

    def run(batches):
        for batch in batches:
            uids = batch.column(0).to_numpy()
            for rows, hashes, bounds in word_hashes(batch.column(1), lower=True):
                owner, h = shingle_sets(hashes, bounds, size)
                k = len(rows)
                ends = np.searchsorted(owner, np.arange(k + 1))
                n = np.diff(ends)
                whole = h.tobytes()
                identity = b"".join([hashlib.blake2b(whole[8 * a : 8 * b], digest_size=16).digest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())])
                one, two = np.frombuffer(identity, np.int64).reshape(-1, 2).T
                keys = signed(band_keys(signatures(owner, h, k)))
                bands = pa.ListArray.from_arrays(pa.array(np.arange(k + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.reshape(-1)), mask=pa.array(n == 0))
                yield pa.RecordBatch.from_arrays([pa.array(uids[rows]), pa.array(n), pa.array(one), pa.array(two), bands], ["uid", "n", "set1", "set2", "bands"])

    return map_arrow(docs.select("uid", "text"), run, _SKETCH)


def full_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """uid, n, shingles: the hashed shingles of the wanted documents."""

    def run(batches):
        for batch in batches:
            uids = batch.column(0).to_numpy()
            for rows, hashes, bounds in word_hashes(batch.column(1), lower=True):
                owner, h = shingle_sets(hashes, bounds, size)
                ends = np.searchsorted(owner, np.arange(len(rows) + 1))
                yield pa.RecordBatch.from_arrays([pa.array(uids[rows]), pa.array(np.diff(ends)), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(signed(h)))], ["uid", "n", "shingles"])

    return map_arrow(docs.select("uid", "text").join(wanted.hint("merge"), "uid", "left_semi"), run, "uid long, n long, shingles array<long>")


def with_sets(pairs: DataFrame, sets: DataFrame, *made) -> DataFrame:
    """pairs (c, x, ...) with columns made from sc and sx, the sets of both. A pivot with very many
    leaves is met by several copies of its set."""
    degree = pairs.groupBy("c").agg(F.ceil(F.count("*") / LEAVES).alias("copies"))
    dealt = pairs.join(degree, "c").select(*pairs.columns, F.pmod(F.xxhash64("x"), "copies").alias("salt"))
    leaves = dealt.join(sets.select(F.col("uid").alias("x"), F.col("n").alias("nx"), F.col("shingles").alias("sx")).hint("merge"), "x")
    pivots = sets.join(degree.hint("merge"), sets.uid == degree.c).select("c", F.col("n").alias("nc"), F.col("shingles").alias("sc"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("salt"))
    return leaves.join(pivots.hint("merge"), ["c", "salt"]).select(*pairs.columns, *made)


def open_leaves(tried: DataFrame, labels: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """c, x, label, w, d (the size of D(x)), slack: leaves that a leaf of the same pivot and of another
    component might be alike to, by these sizes. tried: c, x, nc, nx, common."""
    named = labels.withColumnRenamed("node", "x")
    a, b = F.col("nx") - F.col("common"), F.col("nc") - F.col("common")
    leaves = tried.select("c", "x", (percent * a + 100 * b).alias("w"), (a + b).alias("d"), ((100 - percent) * F.col("nc")).alias("slack"))
    leaves = scratch.write(leaves.join(named, "x", "left").withColumn("label", F.coalesce("label", "x")), "leaves")
    for _ in range(2):  # leaves that go out can leave a pivot's others with one component
        group = leaves.groupBy("c").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("w").alias("least")).filter("low <> high").select("c", "least")
        leaves = leaves.join(group, "c").filter((100 + percent) * F.col("d") >= F.col("w") + F.col("least") - F.col("slack")).drop("least")
    return leaves


def common_counts(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], n_left: int, n_right: int) -> np.ndarray:
    """How many shingles each left document has in common with each right one. A side is (document,
    shingle) of all its sets. Shingles that many have are counted as bits, the others pair by pair."""
    sides = []
    _, ids = np.unique(np.concatenate([left[1], right[1]]), return_inverse=True)
    k = int(ids.max(initial=-1)) + 1
    for owner, at in ((left[0], ids[: len(left[1])]), (right[0], ids[len(left[1]) :])):
        order = np.argsort(at, kind="stable")
        sides.append((owner[order], at[order], np.bincount(at, minlength=k)))
    (lo, lt, ln), (ro, rt, rn) = sides
    dense = (ln * rn > 0) & (ln * rn * 128 >= n_left * n_right)
    common = np.zeros(n_left * n_right, np.int64)
    rare = (ln * rn > 0) & ~dense
    mine = np.flatnonzero(rare[lt])
    ends = np.cumsum(rn[lt[mine]])
    heads = np.cumsum(rn) - rn
    at = 0
    while at < len(mine):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 22), "right")))
        some = mine[at:to]
        many = rn[lt[some]]
        place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(heads[lt[some]], many)
        common += np.bincount(np.repeat(lo[some], many) * n_right + ro[place], minlength=len(common))
        at = to
    common = common.reshape(n_left, n_right)
    column = np.cumsum(dense) - 1
    for low in range(0, int(dense.sum()), 8192):
        bits = []
        for owner, t, n in ((lo, lt, n_left), (ro, rt, n_right)):
            here = dense[t] & (column[t] >= low) & (column[t] < low + 8192)
            has = np.zeros((n, min(8192, -(-(int(dense.sum()) - low) // 64) * 64)), bool)
            has[owner[here], column[t[here]] - low] = True
            bits.append(np.packbits(has, axis=1).view(np.uint64))
        for i, row in enumerate(bits[0]):
            common[i] += np.bitwise_count(bits[1] & row).sum(axis=1, dtype=np.int64)
    return common


def forest(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Places of links (a, b) that join what all of them join, without a circle."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := above.get(x, x)) != x:
            above[x] = above.get(up, up)
            x = up
        return x

    out = []
    _, firsts = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1, return_index=True)
    for i in firsts.tolist():
        p, q = top(int(a[i])), top(int(b[i]))
        if p != q:
            above[p] = q
            out.append(i)
    return out


def dealt(leaves: DataFrame) -> DataFrame:
    """leaves (c, x, label, w, d, slack) with their part and the number of parts that each one meets.

    A pivot's leaves are dealt to parts: those of its largest component (kb parts) and the others (ks
    parts). Each part of the others meets every part, so no two parts of the largest component meet."""
    side = lambda m, n: F.greatest(F.ceil(F.col(m) / SIDE), F.ceil(F.col(n) / SIDE_SHINGLES))
    labels = leaves.groupBy("c", "label").agg(F.count("*").alias("m"), F.sum("d").alias("n"))
    size = labels.groupBy("c").agg(F.sum("m").alias("m"), F.sum("n").alias("n"), F.max(F.struct("m", "label", "n")).alias("big"))
    size = size.select("c", F.col("big.label").alias("big"), side("m", "n").alias("k"), side("big.m", "big.n").alias("kb"), (F.col("m") - F.col("big.m")).alias("ms"), (F.col("n") - F.col("big.n")).alias("ns"))
    size = size.select("c", "big", F.when(F.col("k") == 1, 1).otherwise(side("ms", "ns")).alias("ks"), F.when(F.col("k") == 1, 0).otherwise(F.col("kb")).alias("kb"))
    drawn = lambda k: F.pmod(F.xxhash64("x"), F.col(k))
    rows = leaves.join(size, "c").withColumn("part", F.when((F.col("label") == F.col("big")) & (F.col("kb") > 0), F.col("ks") + drawn("kb")).otherwise(drawn("ks")))
    return rows.select("c", "x", "label", "w", "slack", "part", F.when(F.col("part") < F.col("ks"), F.col("ks") + F.col("kb")).otherwise(F.col("ks")).alias("meets"))


def links_within(leaves: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of components that join all leaves of a pivot that are alike and differ in label. leaves: as dealt."""
    difference = F.concat(F.array_except("sx", "sc"), F.array_except("sc", "sx"))
    rows = with_sets(leaves, sets, difference.alias("d")).withColumn("far", F.explode(F.sequence(F.lit(0).cast("long"), F.col("meets") - 1)))
    rows = rows.select("c", F.least("part", "far").alias("p"), F.greatest("part", "far").alias("q"), "x", "label", "w", "slack", "d", "part")

    def block(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        x, label, w, part = (rows[c].to_numpy() for c in ("x", "label", "w", "part"))
        lists = rows["d"].combine_chunks()
        flat, starts = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        slack, p, q = rows["slack"][0].as_py(), rows["p"][0].as_py(), rows["q"][0].as_py()
        left, right = np.flatnonzero(part == p), np.flatnonzero(part == q)
        out = []
        if len(left) and len(right) and (label != label[0]).any():
            sides = []
            for docs in (left, right):
                many = starts[docs + 1] - starts[docs]
                owner = np.repeat(np.arange(len(docs)), many)
                sides.append((owner, flat[np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(starts[docs], many)]))
            common = common_counts(*sides, len(left), len(right))
            good = ((100 + percent) * common >= w[left][:, None] + w[right][None, :] - slack) & (label[left][:, None] != label[right][None, :])
            i, j = np.nonzero(good)
            if len(i):
                out = [(left[i[k]], right[j[k]]) for k in forest(label[left[i]], label[right[j]])]
        a, b = (label[[y[k] for y in out]] if out else np.empty(0, np.int64) for k in (0, 1))
        return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})

    return rows.groupBy("c", "p", "q").applyInArrow(block, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, name: str = "near_dedup") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of docs.

    Words are lower-cased in A-Z. Documents are linked if 100 * common >= percent * all shingles of
    both; component_id is the smallest doc_id reachable. Null text, or text without words, is linked
    with nothing. Rows that repeat a doc_id, or have none, count as documents of their own, of which
    the first in the order of ids (nulls first) and texts is kept. Very long texts are hashed in
    blocks; an empty table gives no rows; columns other than doc_id and text are ignored.
    """
    scratch = Scratch(docs.sparkSession, name)
    rows, renamed = unique_ids(docs, scratch)
    made = scratch.write(sketches(rows, shingle), "sketches")
    ids = made.select("uid", "n", "set1", "set2")
    classes = ids.filter("n > 0").groupBy("set1", "set2", "n").agg(F.min("uid").alias("rep"), F.count("*").alias("m"))
    several = scratch.write(classes.filter("m > 1"), "classes")  # written, so that a join with a hot class can be split
    member = scratch.write(ids.join(several, ["set1", "set2", "n"]).select("uid", "rep"), "members")
    # joins that grow with the input are shuffled at every size, so that small tables show what large ones cost
    single = made.join(member.filter("uid <> rep").hint("merge"), "uid", "left_anti").filter("n > 0")
    banded = single.select(F.explode("bands").alias("key"), "uid")
    buckets = banded.groupBy("key").agg(F.min("uid").alias("c"), F.count("*").alias("m")).filter("m > 1").select("key", "c")
    star = scratch.write(banded.join(buckets.hint("merge"), "key").filter("uid <> c").select("c", F.col("uid").alias("x")).distinct(), "star")
    sets = scratch.write(full_sets(rows, star.select(F.explode(F.array("c", "x")).alias("uid")).distinct(), shingle), "sets")

    tried = scratch.write(with_sets(star, sets, "nc", "nx", F.size(F.array_intersect("sc", "sx")).cast("long").alias("common")), "tried")
    alike = tried.filter(100 * F.col("common") >= percent * (F.col("nc") + F.col("nx") - F.col("common")))
    labels = components(alike.select(F.col("c").alias("a"), F.col("x").alias("b")), scratch)
    leaves = scratch.write(dealt(scratch.write(open_leaves(tried, labels, percent, scratch), "open")), "dealt")
    found = scratch.write(links_within(leaves, sets, percent), "links")
    scratch.drop(sets)
    joined = components(found, scratch).select(F.col("node").alias("label"), F.col("label").alias("joined"))
    out = made.select("uid", "n").join(member.hint("merge"), "uid", "left").withColumn("rep", F.coalesce("rep", "uid"))
    out = out.join(labels.withColumnRenamed("node", "rep").hint("merge"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    out = out.join(joined, "label", "left").select("uid", F.col("n").alias("n_shingles"), F.coalesce("joined", "label").alias("component"))
    if not renamed:
        return out.select(F.col("uid").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), (F.col("uid") == F.col("component")).alias("kept"), "uid")
    names = rows.select("uid", "doc_id")
    out = out.join(names, "uid").join(names.select(F.col("uid").alias("component"), F.col("doc_id").alias("component_id")), "component")
    return out.select("doc_id", "n_shingles", "component_id", (F.col("uid") == F.col("component")).alias("kept"), "uid")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), shingle=2).drop("uid")
