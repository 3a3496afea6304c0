"""What substring operators share: occurrences of equal pieces, and the removal of spans."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import map_arrow

#: An occurrence of a piece: key (pieces with different keys share no window), the two halves of the
#: digest of its bytes, document, first window, end of windows; flag: see the operator.
OCCURRENCE = "kind int, key long, digest long, more long, uid long, s int, e int, flag boolean"
_KINDS = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]
#: kind: an occurrence that is still to be compared; windows [s, e) that go; a first holder.
OPEN, GONE, HOLDER = 0, 1, 2


def byte_digests(data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of the 128-bit cryptographic digest of each data[start:end]: texts whose digests are equal are equal."""
    view, digest = memoryview(data), hashlib.blake2b
    found = b"".join([digest(view[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist())])
    halves = np.frombuffer(found, np.int64).reshape(-1, 2)
    return halves[:, 0], halves[:, 1]


def batch_of(kind, key, digest, more, uid, s, e, flag) -> pa.RecordBatch:
    n = len(uid)
    full = lambda x, t: np.full(n, x, t) if np.isscalar(x) else x
    cols = [full(kind, np.int32), full(key, np.int64), full(digest, np.int64), full(more, np.int64), uid, s, e, full(flag, bool)]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _KINDS)], [f.split()[0] for f in OCCURRENCE.split(", ")])


def arrays(batch: pa.RecordBatch | pa.Table) -> list[np.ndarray]:
    return [batch.column(i).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch.column(i).to_numpy() for i in range(batch.num_columns)]


def first_of_each(key, digest, more, uid, s):
    """(order by key, digest, document, place; whether the row in that order is its piece's first)."""
    order = np.lexsort((s, uid, more, digest, key))
    k, d, m = key[order], digest[order], more[order]
    first = np.ones(len(order), bool)
    first[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1]) | (m[1:] != m[:-1])
    return order, first


def joined(table: pa.Table) -> list[np.ndarray]:
    return arrays(table.combine_chunks())


def spread(df: DataFrame, n: int, *cols: str) -> DataFrame:
    return df.repartition(n, *[F.col(c) for c in cols])


def gone_by_document(*parts: DataFrame) -> DataFrame:
    """uid, gone: the removed windows of each document, as a list of (s, e)."""
    rows = parts[0].filter(F.col("kind") == GONE).select("uid", "s", "e")
    for p in parts[1:]:
        rows = rows.unionByName(p.filter(F.col("kind") == GONE).select("uid", "s", "e"))
    return rows.groupBy("uid").agg(F.collect_list(F.struct("s", "e")).alias("gone"))


def finish(docs: DataFrame, gone: DataFrame, one: Callable, schema: str, carried: list[str] = ("doc_id", "uid")) -> DataFrame:
    """Joins each document (uid, text, ...) with its removed windows; ``one(text, starts, ends)`` gives its
    result columns, which follow the carried ones."""
    rows = docs.join(gone, "uid", "left").select(*carried, "text", F.col("gone.s").alias("s"), F.col("gone.e").alias("e"))
    made_schema = StructType([*rows.select(*carried).schema.fields, *StructType.fromDDL(schema).fields])
    empty = np.empty(0, np.int64)

    def run(batches):
        names = [f.split()[0] for f in schema.split(", ")]
        kinds = [{"long": pa.int64(), "string": pa.string()}[f.split()[1]] for f in schema.split(", ")]
        for batch in batches:
            cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            made = []
            for text, s, e in zip(cols["text"], cols["s"], cols["e"]):
                some = s.is_valid
                made.append(one(text.as_py() or "", s.values.to_numpy().astype(np.int64) if some else empty, e.values.to_numpy().astype(np.int64) if some else empty))
            columns = list(zip(*made)) if made else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([*[cols[c] for c in carried], *[pa.array(c, k) for c, k in zip(columns, kinds)]], [*carried, *names])

    return map_arrow(rows, run, made_schema)
