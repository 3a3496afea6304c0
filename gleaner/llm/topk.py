"""Exact top-k inner products by columnar branch and bound.

Vectors stand in blocks with one row per dimension. Partial products are accumulated one band of
dimensions at a time; the Cauchy-Schwarz bound on what the other dimensions can still add (the
remaining mass of query and candidate) drops candidates below the query's k-th best score so far,
and the survivors are compacted before the next band.

The stated queries meet all rows in chunks of a fixed size: a chunk is broadcast, every task keeps
the best k of its own rows for each query, and a grouped top-k joins the tasks' lists.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, map_arrow

#: Queries sent to the executors at once; with their vectors a few MB.
CHUNK_QUERIES = 8192
#: Candidates in a block, dimensions in a band.
BLOCK, BAND = 8192, 16
#: Below this, sums of products are exact in double precision.
EXACT = float(1 << 53)


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """vec_id, v: floor(scale * x) of each component; rows null, empty of finite numbers or holding a null or non-finite one are left out."""
    v = F.col(vector_col).cast("array<double>")
    good = F.col(id_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.filter(good).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x * scale)).cast("array<double>").alias("v"))


class Best:
    """The k best (score, vec_id) of each query so far: higher scores first, then smaller ids."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.scores = [np.empty(0, np.int64)] * n
        self.ids = [np.empty(0, np.int64)] * n
        self.floor = np.full(n, -np.inf)

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.concatenate([self.scores[q], scores]), np.concatenate([self.ids[q], ids])
        top = np.lexsort((i, -s))[: self.k]
        self.scores[q], self.ids[q] = s[top], i[top]
        if len(top) == self.k:
            self.floor[q] = self.scores[q][-1]


def remaining(m: np.ndarray, bands: list[int]) -> np.ndarray:
    """Norms of the columns of m from each band's start on; one row per band, and a last one of zeros."""
    squares = np.stack([(m[b : b + BAND] ** 2).sum(axis=0) for b in bands] + [np.zeros(m.shape[1])])
    return np.sqrt(np.cumsum(squares[::-1], axis=0)[::-1]) * (1 + 1e-9)


def search_block(queries: np.ndarray, query_ids: np.ndarray, block: np.ndarray, ids: np.ndarray, best: Best) -> None:
    """queries: a column for each query; block: a column for each candidate, of the same height."""
    bands = list(range(0, len(block), BAND)) or [0]
    q_left, c_left = remaining(queries, bands), remaining(block, bands)
    if len(block) and q_left[0].max(initial=0) * c_left[0].max(initial=0) >= EXACT:
        whole = [np.vectorize(int, otypes=[object])(m) for m in (queries, block)]
        exact = whole[0].T @ whole[1]  # beyond double precision: Python's integers
        for q in range(queries.shape[1]):
            own = ids != query_ids[q]
            best.add(q, np.clip(exact[q][own], -(1 << 63), (1 << 63) - 1).astype(np.int64), ids[own])
        return
    partial = queries[:BAND].T @ block[:BAND]  # the first band of all pairs of the block at once
    for q in range(queries.shape[1]):
        alive = np.flatnonzero((ids != query_ids[q]) & (partial[q] + q_left[1, q] * c_left[1] >= best.floor[q] - 0.5))
        score = partial[q][alive]
        for b in range(1, len(bands)):
            if not len(alive):
                break
            low = bands[b]
            score = score + queries[low : low + BAND, q] @ block[low : low + BAND, alive]
            keep = score + q_left[b + 1, q] * c_left[b + 1, alive] >= best.floor[q] - 0.5
            alive, score = alive[keep], score[keep]
        if len(alive):
            best.add(q, np.rint(score).astype(np.int64), ids[alive])


def _matrix(column: pa.ListArray, height: int | None = None) -> np.ndarray:
    """A column for each vector; shorter ones are filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    height = max(height or 0, int(sizes.max(initial=0)))
    if len(sizes) and (sizes == height).all():
        return np.ascontiguousarray(flat.reshape(len(sizes), height).T)
    out = np.zeros((height, len(sizes)))
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes), rows] = flat
    return out


def top_k(vectors: DataFrame, every: int = 100, k: int = 10, chunk: int = CHUNK_QUERIES, **cols) -> DataFrame:
    """query_id, rank, vec_id, score for each vector whose id is divisible by ``every``, against all
    other ids. Of rows that repeat a query's id the least vector asks, and none is among its
    candidates; other repeated rows are candidates each. Equal scores are ranked by the smaller id.
    Vectors of different lengths are compared as if filled up with zeros. Components whose floor, and
    scores that, leave the range of long are cut to it. Null, empty or non-finite vectors take no
    part (empty ones score 0); an empty table gives no rows; other columns are ignored.

    The queries are asked chunk by chunk; a chunk's lists are written before the next one is sent, so
    neither the plan nor what is sent to a task grows with the number of queries.
    """
    scratch = Scratch(vectors.sparkSession, "topk")
    rows = quantised(vectors, **cols)
    asked = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    n = asked.count()
    pieces = -(-n // chunk)
    schema = "query_id long, vec_id long, score long"
    found = []
    for piece in range(pieces):
        part = asked if pieces == 1 else asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(pieces)) == piece)
        table = part.toArrow().combine_chunks()  # about `chunk` queries, whatever the size of the input
        if not table.num_rows:
            continue
        q_ids, q_vectors = table["vec_id"].to_numpy(), _matrix(table["v"].combine_chunks() if isinstance(table["v"], pa.ChunkedArray) else table["v"])

        def run(batches, q_ids=q_ids, q_vectors=q_vectors):
            best = Best(len(q_ids), k)
            for batch in batches:
                for at in range(0, batch.num_rows, BLOCK):
                    some = batch.slice(at, BLOCK)
                    block = _matrix(pa.array(some.column(1)), len(q_vectors))
                    queries = q_vectors if len(block) == len(q_vectors) else np.pad(q_vectors, ((0, len(block) - len(q_vectors)), (0, 0)))
                    for low in range(0, len(q_ids), 256):
                        part_of = _Part(best, low)
                        search_block(queries[:, low : low + 256], q_ids[low : low + 256], block, some.column(0).to_numpy(), part_of)
            sizes = [len(x) for x in best.ids]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, sizes)), pa.array(np.concatenate(best.ids)), pa.array(np.concatenate(best.scores))], ["query_id", "vec_id", "score"])

        lists = map_arrow(rows, run, schema)
        found.append(lists if pieces == 1 else scratch.write(lists, "lists"))
    if not found:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    every_list = found[0]
    for more in found[1:]:
        every_list = every_list.unionByName(more)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return every_list.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


class _Part:
    """A view of Best for the queries from ``low`` on."""

    def __init__(self, best: Best, low: int):
        self.best, self.low = best, low
        self.floor = best.floor[low:]

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        self.best.add(self.low + q, scores, ids)


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
