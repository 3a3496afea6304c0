"""Vector retrieval by cosine similarity."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.shipping import ship

from .lexical import top_hits

#: Queries that meet all vectors in one pass; with their vectors about two MB.
CHUNK = 4096


def cosine(a: Column, b: Column) -> Column:
    """In double precision; 0 where a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / norms)


def _best_of_task(ids: np.ndarray, q: np.ndarray, k: int):
    """A map over Arrow batches of (doc_ord, v): the best of the task's rows for each query. Scores that
    round to the k-th best one are all kept, so that the order among equals is left to Spark."""
    norms = np.sqrt((q * q).sum(axis=1))

    def run(batches):
        kept = [(np.empty(0), np.empty(0, np.int64))] * len(ids)
        for batch in batches:
            column = batch.column(1)
            sizes = np.diff(column.offsets.to_numpy())
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            if (sizes != q.shape[1]).any():
                raise ValueError(f"vectors of {q.shape[1]} numbers are asked for")
            v, docs = flat.reshape(len(sizes), q.shape[1]), batch.column(0).to_numpy()
            lengths = np.sqrt((v * v).sum(axis=1))
            scale = lengths[:, None] * norms[None, :]
            scores = np.divide(v @ q.T, scale, out=np.zeros_like(scale), where=scale > 0)
            for i in range(len(ids)):
                s, d = np.concatenate([kept[i][0], scores[:, i]]), np.concatenate([kept[i][1], docs])
                if len(s) > k:
                    best = s >= np.partition(s, -k)[-k] - 1e-5
                    s, d = s[best], d[best]
                kept[i] = s, d
        counts = [len(s) for s, _ in kept]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, counts)), pa.array(np.concatenate([d for _, d in kept])), pa.array(np.concatenate([s for s, _ in kept]))], ["query_id", "doc_ord", "score"])

    return run


def vector_search(vectors: DataFrame, queries: DataFrame, k: int, chunk: int = CHUNK) -> DataFrame:
    """query_id, rank, doc_ord, score. vectors: doc_ord, v; queries: query_id, q, all of one length. The
    stated queries meet all vectors in chunks of a fixed size; a task multiplies matrices and sends on
    its best rows only."""
    ship(vectors.sparkSession)
    pieces = max(1, -(-queries.count() // chunk))
    schema, out = "query_id long, doc_ord long, score double", None
    for piece in range(pieces):
        part = queries if pieces == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(pieces)) == piece)
        asked = part.select(F.col("query_id").cast("long"), F.col("q").cast("array<double>")).toArrow()  # about `chunk` rows
        if not asked.num_rows:
            continue
        found = vectors.select(F.col("doc_ord").cast("long"), "v").filter("v is not null").mapInArrow(_best_of_task(asked["query_id"].to_numpy(), np.array(asked["q"].to_pylist()), k), schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, doc_ord long, score double")
    return top_hits(out, k).select("query_id", "rank", "doc_ord", "score")
