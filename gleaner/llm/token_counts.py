"""Token counts from distinct pre-tokens: no id list is made.

Texts are split into pre-tokens where they are read. A task's documents form blocks; a block has a
vocabulary, its distinct pre-tokens, and each document its frequencies by place in that vocabulary.
Vocabularies are shuffled by pre-token, so that all blocks' copies of a pre-token meet where its
pieces are counted once; the counts go back to the blocks and are joined, by place, to the
documents' frequencies, which are written in buckets of blocks and never shuffled. A pre-token
crosses the network once for each block it is in, however often it stands there.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Encoder
from .common import Scratch, map_arrow, parts

#: Documents of more tokens are over the limit.
LIMIT = 1024
#: A block ends with the batch in which its vocabulary or its frequencies reach these numbers.
BLOCK_WORDS, BLOCK_PAIRS = 1 << 19, 1 << 22
#: Vocabulary entries in a partition of the count.
PARTITION_WORDS = 1 << 19
_SPLIT = "block long, doc_id long, n_bytes long, specials long, at binary, times binary, words array<string>"
_COUNTED = "doc_id long, n_bytes long, n_tokens long"


class Pieces:
    """Piece counts and ids of pre-tokens, by the merge loop of the tiktoken library over the
    vocabulary of a byte-level BPE file; ids there follow the merges' order, which is checked."""

    def __init__(self, path: str):
        self.enc = Encoder(path)
        v = self.enc.v
        news = [new for _, new in v.merges.values()]
        if news != sorted(news):
            raise ValueError("ids do not follow the order of the merges")
        self.special = v.special
        self.library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=v.id_of, special_tokens=v.special)
        self.one = self.library._core_bpe.encode_single_piece

    def split(self, text: str) -> tuple[list[str], int]:
        """(pre-tokens, number of special tokens)."""
        found = [s for s in self.special if s in text]
        if not found:
            return self.enc.pieces(text), 0
        parts = regex.split("|".join(map(regex.escape, found)), text)
        return [p for part in parts for p in self.enc.pieces(part)], len(parts) - 1


def frequencies(counts: Counter, places: dict[str, int]) -> tuple[bytes, bytes]:
    """A document's (places, times) in its block's vocabulary, which grows by new pre-tokens. Places are
    sorted and stand as differences; a pre-token of more than 255 times has several entries."""
    at = np.fromiter((places.setdefault(p, len(places)) for p in counts), np.int64, len(counts))
    times = np.fromiter(counts.values(), np.int64, len(counts))
    order = np.argsort(at)
    at, times = at[order], times[order]
    entries = -(-times // 255)
    last = np.cumsum(entries) - 1
    each = np.full(int(entries.sum()), 255, np.int64)
    each[last] = times - (entries - 1) * 255
    return np.diff(np.repeat(at, entries), prepend=0).astype("<u4").tobytes(), each.astype(np.uint8).tobytes()


def split_documents(docs: DataFrame, path: str) -> DataFrame:
    """A row for each document, and one for each block with its vocabulary (words)."""

    def run(batches):
        pieces = Pieces(path)
        block, pairs, places = TaskContext.get().partitionId() << 32, 0, {}

        def vocabulary():
            return pa.RecordBatch.from_arrays([pa.array([block]), *[pa.array([None], k) for k in (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())], pa.array([list(places)], pa.list_(pa.string()))], [f.split()[0] for f in _SPLIT.split(", ")])

        for batch in batches:
            if len(places) >= BLOCK_WORDS or pairs >= BLOCK_PAIRS:
                yield vocabulary()
                block, pairs, places = block + 1, 0, {}
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found, specials = pieces.split(text or "")
                counts = Counter(found)
                pairs += len(counts)
                rows.append((block, doc, len((text or "").encode()), specials, *frequencies(counts, places), None))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 7, kinds)], [f.split()[0] for f in _SPLIT.split(", ")])
        yield vocabulary()

    return map_arrow(docs, run, _SPLIT)


def piece_counts(words: DataFrame, path: str) -> DataFrame:
    """block, place, pieces of (block, place, word) rows that are dealt by word: a partition counts each
    of its distinct pre-tokens once."""

    def run(batches):
        one, known = Pieces(path).one, {}
        for batch in batches:
            found = pa.array(batch.column(2)).dictionary_encode()
            texts = found.dictionary.to_pylist()
            for w in texts:
                if w not in known:
                    known[w] = len(one(w.encode()))
            pieces = np.array([known[w] for w in texts], np.int32)[found.indices.to_numpy()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pieces, pa.int32())], ["block", "place", "pieces"])

    return map_arrow(words, run, "block long, place int, pieces int")


def block_sums(documents: pa.Table, vocabulary: pa.Table) -> pa.Table:
    """A block's documents with the sums of their frequencies times the pieces of its vocabulary."""
    pieces = np.zeros(vocabulary.num_rows, np.int64)
    pieces[vocabulary["place"].to_numpy()] = vocabulary["pieces"].to_numpy()
    totals = documents["specials"].to_numpy().copy()
    for i, (at, times) in enumerate(zip(documents["at"], documents["times"])):
        totals[i] += pieces[np.cumsum(np.frombuffer(at.as_py(), "<u4"), dtype=np.int64)] @ np.frombuffer(times.as_py(), np.uint8).astype(np.int64)
    return pa.table({"doc_id": documents["doc_id"], "n_bytes": documents["n_bytes"], "n_tokens": totals})


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", name: str = "token_counts") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs.

    A null text counts as empty. Null and repeated ids are passed through, row by row. A very long text,
    or pre-token, is handled whole; an empty table gives no rows; columns other than the id and the
    text are ignored, whatever their names.
    """
    scratch = Scratch(docs.sparkSession, name)
    split = scratch.write_bucketed(split_documents(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), path), "block", "split")
    words = split.filter("words is not null").select("block", F.posexplode("words").alias("place", "word"))
    words = words.repartition(max(parts(docs.sparkSession), -(-words.count() // PARTITION_WORDS)), "word")
    vocabulary = piece_counts(words, path)
    documents = split.filter("words is null").select("block", "doc_id", "n_bytes", "specials", "at", "times")
    counted = documents.groupBy("block").cogroup(vocabulary.groupBy("block")).applyInArrow(block_sums, _COUNTED)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
