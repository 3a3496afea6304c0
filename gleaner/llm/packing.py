"""Sum-of-squares packing of tokenised documents into sequences of a fixed length.

Documents are tokenised once, where they are read; only piece lengths and checksums leave that
step. Pieces are dealt into groups of about GROUP_ROWS by a counter (no key can be hot), and each
group is packed on its own: longest first, each piece into the open sequence for which the sum,
over gaps, of the squared number of open sequences with that gap becomes smallest. A new sequence
is opened only if the piece fits in none, so a group wastes at most a few sequences.
"""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, map_arrow
from .token_counts import Pieces

CAPACITY = 2048
#: Pieces packed together: a few MB, and enough for gaps of every size.
GROUP_ROWS = 131_072
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, slot long"
_PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item. Items are placed longest first; order among equals is that given."""
    n = len(lengths)
    bins, offsets = np.empty(n, np.int64), np.zeros(n, np.int64)
    count = np.zeros(capacity + 1, np.int64)  # open bins by gap
    holding: list[list[int]] = [[] for _ in range(capacity + 1)]
    used, never = 0, np.int64(1) << 40
    for k in np.argsort(-lengths, kind="stable"):
        s = int(lengths[k])
        if s < capacity:
            here = count[s:capacity]
            after = count[: capacity - s].copy()
            after[0] = 0  # a full bin is not an open one
            change = np.where(here > 0, after - here, never)
            at = int(change.argmin())
            if change[at] < never:
                gap = s + at
                b = holding[gap].pop()
                count[gap] -= 1
                bins[k], offsets[k] = b, capacity - gap
                if at:
                    count[at] += 1
                    holding[at].append(b)
                continue
            count[capacity - s] += 1
            holding[capacity - s].append(used)
        bins[k] = used
        used += 1
    return bins, offsets


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all full, but the first may be shorter."""
    first = n % capacity
    return ([(0, first)] if first else []) + [(i, capacity) for i in range(first, n, capacity)]


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece of each document's ids followed by end_id; a null text counts as empty."""

    def run(batches):
        p = Pieces(path)
        encode, one = p.library.encode_to_numpy, p.one
        task, slot = TaskContext.get().partitionId(), 0
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = text or ""
                if p.enc._shadow(text) == text:
                    ids = encode(text, allowed_special="all").astype("<u4")
                else:  # characters that the two libraries take for different classes
                    ids = np.frombuffer(b"".join(p.enc.encode(text)), "<u4")
                ids = np.append(ids, np.array([end_id], "<u4")).astype("<u4")
                data = ids.tobytes()
                for i, (start, length) in enumerate(cut(len(ids), capacity)):
                    rows.append((doc, i, start, length, zlib.crc32(data[4 * start : 4 * (start + length)]), task, slot))
                    slot += 1
            names = [f.split()[0] for f in _PIECES.split(", ")]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            cols = zip(*rows) if rows else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, _PIECES)


def pack(pieces: DataFrame, scratch: Scratch, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Adds sequence_id and offset. The pieces are written first, so a lost executor cannot change them."""
    pieces = scratch.write(pieces, "pieces")
    groups = max(1, -(-pieces.count() // group_rows))

    def one_group(table: pa.Table) -> pa.Table:
        # a fixed order, so that a repeated task makes the same sequences
        table = table.take(pc.sort_indices(table, [("task", "ascending"), ("slot", "ascending")]))
        bins, offsets = sum_of_squares(table["length"].to_numpy(), capacity)
        group = table["g"][0].as_py()
        return pa.table({c: table[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")} | {"sequence_id": pa.array(bins + (group << 32)), "offset": pa.array(offsets)})

    dealt = pieces.withColumn("g", F.pmod(F.xxhash64("task", "slot"), F.lit(groups)))
    return dealt.groupBy("g").applyInArrow(one_group, _PACKED)


def op9_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json")), Scratch(spark, "packing"))
