"""Byte-level BPE as a streaming transducer with bounded lookahead, and its decoder.

The encoder takes text in chunks and keeps only what may still change: the last pre-token, and of
that at most twice the sufficient lookahead of the merge list (320 bytes for byte_bpe_50k.json), which
``sufficient_lookahead`` works out from the rules. A token is emitted once that many bytes follow it;
what is left when a pre-token ends is emitted then. Results of pre-tokens are remembered in a bounded
memory.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import struct
from collections.abc import Iterator

import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow

#: Pre-tokens that a worker remembers, and the characters of the longest of them.
REMEMBERED, LONG = 400_000, 256
#: From this many symbols on a heap finds the next merge.
HEAP = 64
#: Characters fed to the encoder at a time.
CHUNK = 1 << 16
#: Up to here the letter and number classes of the regex and of the tokenizer's library agree.
_ODD = regex.compile("[^\x00-԰‐-‧‰-‿€぀-ゖァ-ヺ一-龥가-힣]")


def byte_chars() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the rest follow from U+0100."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Merges and tokens of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        char = byte_chars()
        raw = lambda token: bytes(char[c] for c in token)
        ids = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: raw(t) for t, i in ids.items() if t not in self.special} | {i: t.encode() for t, i in self.special.items()}
        self.id_of = {b: i for i, b in self.bytes_of.items() if i not in self.special.values()}
        self.merges = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[ids[a], ids[b]] = (rank, ids[a + b])
        self.single = [self.id_of[bytes([b])] for b in range(256)]
        self.longest = max(map(len, self.id_of))
        #: Bytes after which a token cannot change any more.
        self.lookahead = max(self.longest, sufficient_lookahead(self.merges, {i: len(t) for i, t in self.bytes_of.items()}))

    def merge(self, data: bytes) -> list[int]:
        """Tokens of some bytes: the best-ranked pair, of equal ones the first, is merged until none is left."""
        ids = [self.single[b] for b in data]
        if len(ids) >= HEAP:
            return self._merge_by_heap(ids)
        none = (1 << 60, -1)
        merges = self.merges
        pairs = [merges.get(p, none) for p in zip(ids, ids[1:])]
        while pairs:
            best = min(pairs)
            if best == none:
                break
            i = pairs.index(best)
            ids[i : i + 2] = [best[1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = merges.get((ids[i], ids[i + 1]), none)
            if i:
                pairs[i - 1] = merges.get((ids[i - 1], ids[i]), none)
        return ids

    def _merge_by_heap(self, ids: list[int]) -> list[int]:
        merges, n = self.merges, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*merges[p], i, *p) for i, p in enumerate(zip(ids, ids[1:])) if p in merges]
        heapq.heapify(heap)

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < n and (found := merges.get((ids[i], ids[j]))):
                heapq.heappush(heap, (*found, i, ids[i], ids[j]))

        while heap:
            _, new, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # one of the two was merged with another
            ids[i], ids[j] = new, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [t for t in ids if t >= 0]


def sufficient_lookahead(merges: dict[tuple[int, int], tuple[int, int]], size: dict[int, int]) -> int:
    """How many bytes must follow a token so that no later byte can change it.

    Compare the encodings of a text and of the same text with more after it, rule by rule in the order
    of ranks, from the left end. Up to some place both have the same tokens. That place moves to the
    left only when a rule (a, b) merges the last common token a with what follows in one of the two,
    so by the length of a; after that one of them has the merged token there and the other one a, or
    tokens that grew from these to the right (that have them on their left edge), and the next such
    rule has a higher rank. So the way to the left is at most the largest sum over a chain of rules
    of rising rank in which each b has the rule before's a, or its merged token, on its left edge. The
    rules must be ordered: no rule may come before one that makes its parts.
    """
    born: dict[int, int] = {}
    lefts: dict[int, set[int]] = {}
    rules = sorted((rank, a, b, new) for (a, b), (rank, new) in merges.items())
    for rank, a, _, new in rules:
        born[new] = rank  # the last rule that makes it
        lefts.setdefault(new, set()).add(a)
    if any(born.get(part, -1) > rank for rank, a, b, _ in rules for part in (a, b)):
        raise ValueError("a rule comes before one that makes its parts")
    far: dict[int, int] = {}  # by token: the longest way left of rules done so far whose b has it on its left edge
    for _, a, b, new in reversed(rules):
        way = size[a] + max(far.get(a, 0), far.get(new, 0))
        edge = [b]
        while edge:
            token = edge.pop()
            if far.get(token, 0) < way:
                far[token] = way
                edge += lefts.get(token, ())
    return max(far.values(), default=0)


class Transducer:
    """Tokens of one pre-token of any length, from bytes in pieces. It holds fewer than twice the
    lookahead in bytes: at that size the tokens that have the lookahead behind them are emitted, and
    since no merge crosses the end of a token, the rest is encoded on its own from there."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.data = b""

    def feed(self, data: bytes) -> list[int]:
        out: list[int] = []
        room, sizes, at = 2 * self.v.lookahead, self.v.bytes_of, 0
        while len(self.data) + len(data) - at >= room:
            took = room - len(self.data)
            self.data += data[at : at + took]
            at += took
            end = 0
            for token in self.v.merge(self.data):
                if end + len(sizes[token]) > self.v.lookahead:
                    break
                end += len(sizes[token])
                out.append(token)
            self.data = self.data[end:]
        self.data += data[at:]
        return out

    def close(self) -> list[int]:
        rest, self.data = self.data, b""
        return self.v.merge(rest)


class Encoder:
    """Streams one text after another; ``encode`` yields packed little-endian 32-bit ids."""

    def __init__(self, path: str):
        self.v = Vocabulary(path)
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.known: dict[str, bytes] = {}
        self.odd: dict[int, str] = {}
        self.specials = regex.compile("|".join(map(regex.escape, self.v.special))) if self.v.special else None
        self.keep = max(map(len, self.v.special), default=1) - 1
        self.path = path
        self._pre = None

    def _shadow(self, text: str) -> str:
        """The text with characters whose class differs between the libraries replaced by ones of the same class."""
        if not _ODD.search(text):
            return text
        for c in set(_ODD.findall(text)):
            if ord(c) not in self.odd:
                if self._pre is None:
                    from tokenizers import Tokenizer

                    self._pre = Tokenizer.from_file(self.path).pre_tokenizer
                one = lambda s: len(self._pre.pre_tokenize_str(s)) == 1
                letter, number = one("a" + c), one("1" + c)
                same = letter == bool(regex.match(r"\p{L}", c)) and number == bool(regex.match(r"\p{N}", c))
                self.odd[ord(c)] = c if same else "a" if letter else "1" if number else "!"
        return text.translate(self.odd)

    def pieces(self, text: str) -> list[str]:
        shadow = self._shadow(text)
        if shadow is text or shadow == text:
            return self.pattern.findall(text)
        return [text[slice(*m.span())] for m in self.pattern.finditer(shadow)]

    def piece(self, p: str) -> bytes:
        got = self.known.get(p)
        if got is None:
            t = Transducer(self.v)
            got = _packed(t.feed(p.encode()) + t.close())
            if len(p) > LONG:
                return got
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[p] = got
        return got

    def _segment(self, chunks: Iterator[str]) -> Iterator[bytes]:
        """A stretch of text without special tokens, in chunks."""
        tail, open_, kind = "", None, None
        for chunk in chunks:
            tail += chunk
            if open_:  # inside a very long pre-token: what is of its class goes to the transducer
                run = kind.match(self._shadow(tail)).end()
                ended = run < len(tail)
                held = run - (kind is _SPACE or not ended)  # white space leaves its last character to what follows
                yield _packed(open_.feed(tail[:held].encode()))
                tail = tail[held:]
                if not ended:
                    continue
                yield _packed(open_.close())
                open_ = None
            found = self.pieces(tail)
            keep = 2 if len(found) > 1 and found[-2].endswith("'") and len(found[-1]) == 1 else 1
            for p in found[:-keep]:
                yield self.known.get(p) or self.piece(p)
            tail = "".join(found[-keep:])
            if keep == 1 and len(tail) > LONG:
                kind = next(k for k in _KINDS if k.match(self._shadow(tail[-1])).end())
                open_ = Transducer(self.v)
                yield _packed(open_.feed(tail[:-1].encode()))
                tail = tail[-1:]
        if open_:
            yield _packed(open_.feed(tail.encode()) + open_.close())
        else:
            for p in self.pieces(tail):
                yield self.piece(p)

    def encode(self, text: str, chunk: int = CHUNK) -> Iterator[bytes]:
        spans = [m.span() for m in self.specials.finditer(text)] if self.specials and any(s in text for s in self.v.special) else []
        at = 0
        for start, end in [*spans, (len(text), None)]:
            yield from self._segment(text[i : min(i + chunk, start)] for i in range(at, start, chunk))
            if end is not None:
                yield struct.pack("<I", self.v.special[text[start:end]])
                at = end


_SPACE = regex.compile(r"\s*")
_KINDS = [_SPACE, regex.compile(r"\p{L}*"), regex.compile(r"\p{N}*"), regex.compile(r"[^\s\p{L}\p{N}]*")]


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Decoder:
    """Ids to text, in pieces: bytes are held back until they make whole characters; a byte that
    cannot belong to a character becomes U+FFFD, as in the tokenizers library."""

    def __init__(self, vocabulary: Vocabulary):
        self.table = vocabulary.bytes_of
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids) -> str:
        table = self.table
        return self.state.decode(b"".join([table[i] for i in ids]))

    def close(self) -> str:
        return self.state.decode(b"", True)


def ids_of(packed: bytes):
    return memoryview(packed).cast("I")  # the ids are packed little-endian, as the machine has them


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row, no shuffle.

    A null text counts as empty (no tokens). Null and repeated ids are passed through, row by row. Very
    long texts are encoded and decoded in chunks; an empty table gives no rows; columns other than the
    id and the text are ignored, whatever their names.
    """

    def run(batches):
        enc = Encoder(path)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                ids, back, n = hashlib.sha256(), hashlib.sha256(), 0
                decoder, waiting = Decoder(enc.v), []
                size = 0
                for part in enc.encode(text.as_py() or ""):
                    waiting.append(part)
                    size += len(part)
                    if size >= 1 << 16:
                        packed, size = b"".join(waiting), 0
                        waiting.clear()
                        ids.update(packed)
                        n += len(packed) // 4
                        back.update(decoder.feed(ids_of(packed)).encode())
                packed = b"".join(waiting)
                ids.update(packed)
                back.update(decoder.feed(ids_of(packed)).encode())
                back.update(decoder.close().encode())
                rows.append((n + len(packed) // 4, ids.hexdigest(), back.hexdigest()))
            n, a, b = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
