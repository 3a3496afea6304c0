"""Suffix sorting by induction with disk-backed priority queues that carry common-prefix values.

Suffixes are S- or L-type by how they compare with the next one; the LMS suffixes (S after L) are
sorted first, on a string of names of their substrings, by the same method, and the others are
induced from them in two scans. A queue holds tuples (suffix, symbols shared with the tuple pushed
before) by first symbol: the smallest (or largest) symbol is popped first, and within a symbol first
in is first out, which is what the induction needs. All tuples of a symbol that are ready are popped
at once, so the work is done in whole arrays; beyond a memory limit the queues keep their arrays in
an anonymous file of the task (it has no name and goes with the task).

Common prefixes are compared for neighbouring LMS suffixes only. Two suffixes that are induced into
one queue one after the other share one symbol more than their inducers do, which is the least value
between these in the scan; where the L-type suffixes of a symbol meet its S-type ones it is the
shorter of both runs of that symbol. Values are cut at ``depth``, and the order is exact by that many
symbols: names are doubled in memory until they span them, or the method recurses where a name string
is longer than memory.
"""

from __future__ import annotations

import heapq
import tempfile

import numpy as np

from .rolling import eights

#: Bytes that the queues of one sort keep in memory.
MEMORY = 2 << 20
#: Name strings up to this length are sorted in memory.
IN_MEMORY = 1 << 22
_TUPLE = np.dtype([("at", np.int64), ("lcp", np.int16)])


def tuples(at: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    out = np.empty(len(at), _TUPLE)
    out["at"], out["lcp"] = at, lcp
    return out


class DiskQueue:
    """Arrays of suffix tuples by symbol; ``pop`` gives the arrays of the next symbol in order."""

    def __init__(self, largest_first: bool, memory: int = MEMORY):
        self.sign = -1 if largest_first else 1
        self.memory, self.held = memory, 0
        self.waiting: dict[int, list] = {}
        self.order: list[int] = []
        self.file = None
        #: Bytes that went to the file.
        self.spilled = 0

    def push(self, symbol: int, items: np.ndarray) -> None:
        if symbol not in self.waiting:
            self.waiting[symbol] = []
            heapq.heappush(self.order, self.sign * symbol)
        if self.held + items.nbytes > self.memory:
            if self.file is None:
                self.file = tempfile.TemporaryFile()
            at = self.file.seek(0, 2)
            self.file.write(items.tobytes())
            self.spilled += items.nbytes
            self.waiting[symbol].append((at, len(items)))
        else:
            self.held += items.nbytes
            self.waiting[symbol].append(items)

    def push_all(self, symbols: np.ndarray, items: np.ndarray) -> None:
        """Tuples in the order of their symbols, each symbol's in the given order."""
        if not len(items):
            return
        cuts = np.flatnonzero(symbols[1:] != symbols[:-1]) + 1
        for symbol, part in zip(symbols[np.concatenate([[0], cuts])].tolist(), np.split(items, cuts)):
            self.push(symbol, part)

    def next_symbol(self) -> int | None:
        return self.sign * self.order[0] if self.order else None

    def pop(self) -> np.ndarray:
        symbol = self.sign * heapq.heappop(self.order)
        out = []
        for part in self.waiting.pop(symbol):
            if isinstance(part, tuple):
                at, n = part
                self.file.seek(at)
                out.append(np.frombuffer(self.file.read(n * _TUPLE.itemsize), _TUPLE))
            else:
                self.held -= part.nbytes
                out.append(part)
        return np.concatenate(out)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class LeastSince:
    """For each symbol the least common-prefix value scanned since the last push to its queue."""

    def __init__(self, depth: int):
        self.depth = depth
        self.after: dict[int, tuple[int, int]] = {}  # by symbol: batches until its last push, least value after that in its batch
        self.scanned: list[int] = []  # the least value of each batch so far

    def induced(self, lcp: np.ndarray, symbols: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(order, values): the chosen places of a scanned batch, sorted by the symbols they go to, and the
        common-prefix value of each pushed suffix with the one pushed before it to the same queue."""
        n, least_here = len(lcp), int(lcp.min(initial=self.depth))
        if not len(chosen):
            self.scanned.append(least_here)
            return np.empty(0, np.int64), np.empty(0, np.int16)
        order = np.argsort(symbols, kind="stable")
        place, symbol = chosen[order], symbols[order]
        first = np.ones(len(order), bool)
        first[1:] = symbol[1:] != symbol[:-1]
        low = np.where(first, 0, np.concatenate([[0], place[:-1] + 1]))
        values = least(lcp, low, place + 1)
        heads, last = np.flatnonzero(first), np.append(np.flatnonzero(first)[1:], len(order)) - 1
        tails = least(lcp, place[last] + 1, np.full(len(last), n), self.depth)
        for h, s, end in zip(heads.tolist(), symbol[heads].tolist(), tails.tolist()):
            if s in self.after:
                batches, since = self.after[s]
                values[h] = min(values[h], since, min(self.scanned[batches:], default=self.depth))
            else:
                values[h] = -1  # nothing is before it
            self.after[s] = len(self.scanned) + 1, end
        self.scanned.append(least_here)
        return order, np.minimum(values + 1, self.depth)


def least(values: np.ndarray, low: np.ndarray, high: np.ndarray, empty: int = 1 << 14) -> np.ndarray:
    """The least of values[low:high] for each pair; ``empty`` where the range is empty."""
    out = np.full(len(low), empty, np.int16)
    size = high - low
    some = np.flatnonzero(size > 0)
    if not len(some):
        return out
    level = np.frexp(size[some].astype(np.float64))[1] - 1
    table = values.astype(np.int16)
    for k in range(int(level.max()) + 1):
        at = some[level == k]
        out[at] = np.minimum(table[low[at]], table[high[at] - (1 << k)])
        if len(table) > 1 << k:
            table = np.minimum(table[: len(table) - (1 << k)], table[1 << k :])
    return out


def suffix_types(text: np.ndarray) -> np.ndarray:
    """True: S-type (smaller than the next suffix). The empty suffix is smaller than all."""
    n = len(text)
    rises, falls = np.empty(n, bool), np.empty(n, bool)
    rises[:-1], falls[:-1] = text[:-1] < text[1:], text[:-1] > text[1:]
    rises[-1:], falls[-1:] = False, True
    settled = np.where(rises | falls, np.arange(n), n)
    nearest = np.minimum.accumulate(settled[::-1])[::-1]
    return rises[np.minimum(nearest, n - 1)] if n else rises


def run_length(text: np.ndarray, at: int, depth: int) -> int:
    """How often the symbol at a place is repeated from there on, at most depth times."""
    window = text[at : at + depth]
    other = np.flatnonzero(window != window[0])
    return int(other[0]) if len(other) else len(window)


def induce(text: np.ndarray, s_type: np.ndarray, lms: np.ndarray, lcp: np.ndarray, depth: int, memory: int = MEMORY) -> tuple[np.ndarray, np.ndarray]:
    """(all suffixes in order, symbols that each shares with the one before it, at most depth), from the
    LMS suffixes in order (each symbol's order is what counts) and their common prefixes."""
    n = len(text)
    left, seeds, right = DiskQueue(False, memory), DiskQueue(False, memory), DiskQueue(True, memory)
    order = np.argsort(text[lms], kind="stable")
    seeds.push_all(text[lms][order], tuples(lms[order], lcp[order]))
    left.push(int(text[n - 1]), tuples(np.array([n - 1]), np.array([0])))
    rows = DiskQueue(True, memory)  # L-type suffixes, for the second scan
    since = LeastSince(depth)
    since.after[int(text[n - 1])] = 0, 0  # the empty suffix, which comes first, has nothing in common with others

    starts: list[np.ndarray] = []  # where the run of each place begins, once it is needed

    def rest_of_runs(batch: np.ndarray) -> np.ndarray:
        """A batch of places in runs of more than depth symbols, with all places before them in their runs:
        these suffixes share depth symbols, so their order does not matter."""
        if not starts:
            new = np.ones(n, bool)
            new[1:] = text[1:] != text[:-1]
            starts.append(np.maximum.accumulate(np.where(new, np.arange(n), 0)))
        low = starts[0][batch["at"]]
        many = batch["at"] + 1 - low
        return tuples(np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many), np.full(int(many.sum()), depth))

    def scan(batch: np.ndarray, type_: bool, symbol: int, queue: DiskQueue, since: LeastSince, seed: bool = False) -> np.ndarray:
        """Pushes what a batch induces; what goes to the symbol itself is given back."""
        before = batch["at"] - 1
        chosen = np.flatnonzero((before >= 0) & (s_type[before] == type_))
        symbols = text[before[chosen]]
        order, values = since.induced(batch["lcp"], symbols, chosen)
        items, symbols = tuples(before[chosen][order], values), symbols[order]
        own = symbols == symbol
        queue.push_all(symbols[~own], items[~own])
        return items[own]

    while (symbol := min((x for x in (left.next_symbol(), seeds.next_symbol()) if x is not None), default=None)) is not None:
        batch = left.pop() if left.next_symbol() == symbol else tuples(np.empty(0, np.int64), np.empty(0, np.int16))
        last, turn = -1, 0
        while len(batch):
            last = int(batch["at"][-1])
            rows.push(symbol, batch)
            batch, turn = scan(batch, False, symbol, left, since), turn + 1
            if turn == depth and len(batch):
                batch = rest_of_runs(batch)
                last = int(batch["at"][-1])
                rows.push(symbol, batch)
                batch = scan(batch, False, symbol, left, since)[:0]
        if seeds.next_symbol() == symbol:
            batch = seeds.pop().copy()
            batch["lcp"][0] = min(run_length(text, last, depth), run_length(text, int(batch["at"][0]), depth)) if last >= 0 else 0
            scan(batch, False, symbol, left, since)
    left.close()
    seeds.close()
    out, since = [], LeastSince(depth)
    while (symbol := max((x for x in (right.next_symbol(), rows.next_symbol()) if x is not None), default=None)) is not None:
        # from the largest on: a tuple's value is what it shares with the one after it
        batch = right.pop() if right.next_symbol() == symbol else tuples(np.empty(0, np.int64), np.empty(0, np.int16))
        last, turn = -1, 0
        while len(batch):
            last = int(batch["at"][-1])
            out.append(batch)
            batch, turn = scan(batch, True, symbol, right, since), turn + 1
            if turn == depth and len(batch):
                batch = rest_of_runs(batch)
                last = int(batch["at"][-1])
                out.append(batch)
                batch = scan(batch, True, symbol, right, since)[:0]
        if rows.next_symbol() == symbol:
            large = rows.pop()[::-1]
            own = tuples(large["at"], np.concatenate([[0], large["lcp"][:-1]]))
            own["lcp"][0] = min(run_length(text, last, depth), run_length(text, int(own["at"][0]), depth)) if last >= 0 else 0
            out.append(own)
            scan(own, True, symbol, right, since)
    rows.close()
    right.close()
    all_ = np.concatenate(out)[::-1]
    return all_["at"], np.concatenate([[0], all_["lcp"][:-1]]).astype(np.int16)


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Symbols that each suffix of an order shares with the one before it, at most depth; bytes are
    compared eight at a time as long as they are equal."""
    n = len(text)
    out = np.zeros(len(order), np.int16)
    a, b = order[1:], order[:-1]
    room = np.minimum(n - np.maximum(a, b), depth)
    step = 8 if text.dtype == np.uint8 else 1
    words = eights(text) if step == 8 else text
    left, low = np.flatnonzero(room > 0), 0
    shared = np.zeros(len(a), np.int64)
    while len(left):
        x, y = words[a[left] + low], words[b[left] + low]
        if step == 8:
            differ = x ^ y
            lowest = differ & (~differ + np.uint64(1))
            equal = np.where(differ == 0, 8, (np.log2(np.maximum(lowest, np.uint64(1)).astype(np.float64)) // 8).astype(np.int64))
        else:
            equal = (x == y).astype(np.int64)
        shared[left] = np.minimum(low + equal, room[left])
        low += step
        left = left[(equal == step) & (room[left] > low)]
    out[1:] = shared
    return out


def same_spans(text: np.ndarray, a: np.ndarray, b: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether text[a:ends[a]] and text[b:ends[b]] are equal, pair by pair; bytes are compared eight at a time."""
    size = ends[a] - a
    same = size == ends[b] - b
    step = 8 if text.dtype == np.uint8 else 1
    words = eights(text) if step == 8 else text
    left, low = np.flatnonzero(same), 0
    while len(left):
        x, y = words[a[left] + low], words[b[left] + low]
        if step == 8:
            spare = (np.uint64(64) - np.minimum(size[left] - low, 8).astype(np.uint64) * np.uint64(8))
            x, y = x << spare, y << spare
        equal = x == y
        same[left[~equal]] = False
        low += step
        left = left[equal & (size[left] > low)]
    return same


def _names(text: np.ndarray, s_type: np.ndarray, lms: np.ndarray, depth: int, memory: int) -> np.ndarray:
    """For each LMS place, in text order, the rank of its substring (up to the next LMS place) by depth symbols
    at least; equal substrings that are longer may get several names."""
    ordered, _ = induce(text, s_type, lms, np.zeros(len(lms), np.int16), depth, memory)
    is_lms = np.zeros(len(text) + 1, bool)
    is_lms[lms] = True
    ordered = ordered[is_lms[ordered]]
    n = len(text)
    ends = np.empty(n + 1, np.int64)
    ends[lms] = np.append(lms[1:] + 1, n)  # the last substring reaches the end, which no other does
    new = np.ones(len(ordered), np.int64)
    if len(ordered) > 1:
        new[1:] = ~same_spans(text, ordered[:-1].astype(np.int64), ordered[1:].astype(np.int64), ends) | (ordered[1:] == lms[-1]) | (ordered[:-1] == lms[-1])
    names = np.empty(n, np.int64)
    names[ordered] = np.cumsum(new) - 1
    return names[lms]


def _doubled(names: np.ndarray, spans: int) -> np.ndarray:
    """The order of the suffixes of a name string by their first ``spans`` names at least. A suffix's rank is
    the first place of its group; only groups of several are sorted again, by the rank ``width`` on."""
    n = len(names)
    order = np.argsort(names, kind="stable")
    heads = np.flatnonzero(np.concatenate([[True], names[order][1:] != names[order][:-1]])) if n else np.empty(0, np.int64)
    size = np.diff(np.append(heads, n))
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(heads, size)
    active, width = order[np.repeat(size > 1, size)], 1
    while width < spans and len(active):
        second = np.full(len(active), 0, np.int64)
        inside = active + width < n
        second[inside] = rank[active[inside] + width] + 1
        key = rank[active] * (n + 1) + second
        by = np.argsort(key)
        active, key = active[by], key[by]
        place = np.arange(len(active))
        old = rank[active]
        first_old = np.maximum.accumulate(np.where(np.concatenate([[True], old[1:] != old[:-1]]), place, 0))
        new = np.concatenate([[True], key[1:] != key[:-1]])
        first_new = np.maximum.accumulate(np.where(new, place, 0))
        order[old + place - first_old] = active
        rank[active] = old + first_new - first_old
        heads = np.flatnonzero(new)
        size = np.diff(np.append(heads, len(active)))
        active, width = active[np.repeat(size > 1, size)], width * 2
    return order


def sort_suffixes(text: np.ndarray, depth: int, memory: int = MEMORY, in_memory: int = IN_MEMORY) -> tuple[np.ndarray, np.ndarray]:
    """(Places of the suffixes in the order of their first ``depth`` symbols at least, symbols that each
    shares with the one before it, at most depth)."""
    n = len(text)
    if n < 2:
        return np.arange(n), np.zeros(n, np.int16)
    s_type = suffix_types(text)
    lms = np.flatnonzero(s_type[1:] & ~s_type[:-1]) + 1
    if len(lms):
        names = _names(text, s_type, lms, depth, memory)
        if len(names) <= in_memory:
            lms = lms[_doubled(names, depth // 2 + 1)]  # a name stands for two symbols at least
        else:
            lms = lms[sort_suffixes(names, depth, memory, in_memory)[0]]
    return induce(text, s_type, lms, common_prefixes(text, lms, depth), depth, memory)
