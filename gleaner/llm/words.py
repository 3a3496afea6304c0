"""Hashes of the words of whole columns of texts. A word is a run of bytes other than ASCII white space."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .rolling import BLOCK, blocks, string_hashes

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def _of_block(data, starts, ends, lower):
    """(hashes, number of words of each text)."""
    if lower:
        data = _LOWER[data]
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~_SPACE[data]
    opens = inside[1:-1] & ~inside[:-2]
    closes = inside[1:-1] & ~inside[2:]
    some = ends > starts
    edge = starts[some]
    opens[edge] |= inside[1:-1][edge]
    last = ends[some] - 1
    closes[last] |= inside[1:-1][last]
    a, b = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    counts = np.searchsorted(a, ends) - np.searchsorted(a, starts)
    return string_hashes(data, a, b), counts


def _cuts(text: bytes, size: int):
    """A long text in parts that end with white space, so no word is cut."""
    at = 0
    while at < len(text):
        stop = at + size
        if stop < len(text):
            window = np.frombuffer(text, np.uint8, min(size, len(text) - at), at)
            spaces = np.flatnonzero(_SPACE[window])
            if len(spaces):
                stop = at + int(spaces[-1]) + 1
            else:
                rest = np.flatnonzero(_SPACE[np.frombuffer(text, np.uint8, len(text) - stop, stop)])
                stop = stop + int(rest[0]) + 1 if len(rest) else len(text)
        yield text[at:stop]
        at = stop


def word_hashes(texts: pa.Array, lower: bool = False, size: int = BLOCK):
    """Yields (rows, hashes, bounds): the words of text rows[k] are hashes[bounds[k]:bounds[k + 1]]."""
    skip = -1
    for data, rows, starts, ends, offsets in blocks(texts, 0, size):
        if rows[0] == skip:
            continue
        if len(rows) == 1 and ends[0] - starts[0] == size and len(whole := texts[int(rows[0])].as_py().encode()) > size:
            skip = int(rows[0])  # this text comes in several blocks; they are cut here where a word ends
            parts = [np.frombuffer(p, np.uint8) for p in _cuts(whole, size)]
            h = np.concatenate([_of_block(p, np.array([0]), np.array([len(p)]), lower)[0] for p in parts])
            yield rows, h, np.array([0, len(h)])
            continue
        h, counts = _of_block(data, starts, ends, lower)
        yield rows, h, np.concatenate([[0], np.cumsum(counts)])
