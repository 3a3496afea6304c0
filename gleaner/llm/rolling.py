"""Hashes of spans of bytes or words, whole blocks at a time.

Span hashes are built like a tree: the hash of 2k symbols is a non-linear mix of the hashes of its two
halves, so no algebraic identity makes different spans collide, as it does for polynomials modulo
2**64 (Thue-Morse words). Equal spans have equal hashes wherever they stand. A polynomial is used for
grouping keys only (``grams``), where a collision costs time and not correctness.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes handled at once; a longer text is handled in overlapping blocks.
BLOCK = 1 << 19
#: Multipliers and increments of the SplitMix64 and MurmurHash3 mixers.
_GOLDEN, _M1, _M2 = U(0x9E3779B97F4A7C15), U(0xFF51AFD7ED558CCD), U(0xC4CEB9FE1A85EC53)
_LEFT, _RIGHT = U(0xD1342543DE82EF95), U(0xAF251AF3B0F025B5)
_BASE = 0x2545F4914F6CDD1D
#: Strings of more bytes are hashed one by one.
LONG_STRING = 512


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(33))
    x *= _M1
    x ^= x >> U(33)
    x *= _M2
    x ^= x >> U(33)
    return x


def paired(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The hash of two neighbours, in this order."""
    return mix(left * _LEFT + (right ^ (right >> U(29))) * _RIGHT)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of data on (zeros after the end), as numbers."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.lib.stride_tricks.as_strided(padded[:8].view(U), (len(data) + 1,), (1,), writeable=False)


def string_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each byte string data[start:end], eight bytes at a time; one to one for strings of one
    length of at most eight bytes."""
    size = end - start
    h = mix(size.astype(U) * _GOLDEN)
    if not len(h):
        return h
    words = eights(data)
    at = np.arange(len(h))
    for low in range(0, min(LONG_STRING, int(size.max())), 8):
        at = at[size[at] > low] if low else at[size[at] > 0]
        left = np.minimum(size[at] - low, 8).astype(U)
        h[at] = mix(h[at] * _LEFT + (words[start[at] + low] & (~U(0) >> (U(64) - left * U(8)))))
    for i in np.flatnonzero(size > LONG_STRING).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return h


@lru_cache(1)
def _symbols() -> np.ndarray:
    return mix((np.arange(256, dtype=U) + U(1)) * _GOLDEN)


@lru_cache(2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    def powers(base: int) -> np.ndarray:
        out = np.full(size, U(base), U)
        out[0] = U(1)
        return np.multiply.accumulate(out)

    return powers(_BASE), powers(pow(_BASE, -1, 1 << 64))


def grams(data: np.ndarray, k: int) -> np.ndarray:
    """A polynomial hash of the k bytes from each place on: a grouping key, no proof of equality."""
    power, inverse = _powers(1 << max(16, int(len(data)).bit_length()))
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(_symbols()[data] * power[: len(data)], out=sums[1:])
    n = max(0, len(sums) - k)
    return mix((sums[k:] - sums[:n]) * inverse[:n])


class Spans:
    """Hashes of spans of a block of values that are hashes themselves."""

    def __init__(self, data: np.ndarray):
        self.levels = [data]

    def _level(self, k: int) -> np.ndarray:
        """Hashes of the 2**k values from each place on."""
        while len(self.levels) <= k:
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(paired(last[: max(0, len(last) - half)], last[half:]))
        return self.levels[k]

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of spans of any length above 0: the length, and two overlapping spans of a power of two."""
        size = end - start
        out = np.empty(len(start), U)
        level = np.frexp(size.astype(np.float64))[1] - 1
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            whole = self._level(k)
            out[at] = paired(paired(whole[start[at]], whole[end[at] - (1 << k)]), mix(size[at].astype(U) * _GOLDEN))
        return out

    def every(self, k: int) -> np.ndarray:
        """The hash of the k values from each place on."""
        n = max(0, len(self.levels[0]) - k + 1)
        at = np.arange(n)
        return self.hash(at, at + k)


def sliding(x: np.ndarray, w: int, ufunc=np.minimum) -> np.ndarray:
    """The minimum (or maximum) of each w consecutive values: from running ones of blocks of w."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    fill = np.iinfo(x.dtype).max if ufunc is np.minimum else 0
    full = -(-len(x) // w) * w
    padded = np.full(full, fill, x.dtype)
    padded[: len(x)] = x
    rows = padded.reshape(-1, w)
    ahead = ufunc.accumulate(rows, axis=1).reshape(-1)
    back = ufunc.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return ufunc(back[:n], ahead[w - 1 : w - 1 + n])


def blocks(texts: pa.StringArray, overlap: int, size: int = BLOCK):
    """Yields (bytes, rows, starts, ends, offsets): texts i = rows[k] stand at [starts[k], ends[k]) of
    the bytes, from byte offsets[k] of the text on. A text longer than a block comes in several
    blocks that overlap by ``overlap`` bytes."""
    texts = texts.cast(pa.large_string())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
    i, n = 0, len(texts)
    while i < n:
        if bounds[i + 1] - bounds[i] > size:
            at = bounds[i]
            while True:
                end = min(at + size, bounds[i + 1])
                yield data[at:end], np.array([i]), np.array([0]), np.array([end - at]), np.array([at - bounds[i]])
                if end == bounds[i + 1]:
                    break
                at = end - overlap
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + size, "right")) - 1)
        part = bounds[i : j + 1] - bounds[i]
        yield data[bounds[i] : bounds[j]], np.arange(i, j), part[:-1], part[1:], np.zeros(j - i, np.int64)
        i = j


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of intervals [start, end); touching ones are joined."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    s, e = start[order], np.maximum.accumulate(end[order])
    first = np.flatnonzero(np.concatenate([[True], s[1:] > e[:-1]]))
    return s[first], e[np.concatenate([first[1:], [len(s)]]) - 1]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
