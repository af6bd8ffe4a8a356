"""Suffix order of one shard by induced sorting, with bucket queues on disk.

A monotone priority queue of suffixes keyed by first symbol and arrival is a queue per
symbol.  Suffixes are induced a bucket at a time, so all of a bucket's waiting entries move in
one vector step; what waits beyond ``MEMORY_ENTRIES`` lies in a temporary file of the task.
"""

from __future__ import annotations

import tempfile

import numpy as np

#: Waiting entries that the queues keep in memory.
MEMORY_ENTRIES = 4_000_000
#: Largest alphabet that is induced by buckets; names beyond it are ranked by doubling.
ALPHABET = 4096


class BucketQueues:
    """One first-in-first-out queue per symbol; the oldest entries are written to disk."""

    def __init__(self, symbols: int):
        self.parts: list[list] = [[] for _ in range(symbols)]
        self.held, self.file = 0, None

    def push(self, symbol: int, places: np.ndarray) -> None:
        self.parts[symbol].append(places)
        self.held += len(places)
        if self.held > MEMORY_ENTRIES:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        for parts in self.parts:
            if any(isinstance(p, np.ndarray) for p in parts):
                joined = [p for p in parts if not isinstance(p, np.ndarray)]
                fresh = np.concatenate([p for p in parts if isinstance(p, np.ndarray)])
                self.file.seek(0, 2)
                joined.append((self.file.tell(), len(fresh)))
                fresh.astype(np.int64).tofile(self.file)
                parts[:] = joined
        self.held = 0

    def pop(self, symbol: int) -> np.ndarray | None:
        """All that waits for ``symbol``, oldest first."""
        parts, self.parts[symbol] = self.parts[symbol], []
        if not parts:
            return None
        out = []
        for p in parts:
            if isinstance(p, np.ndarray):
                self.held -= len(p)
            else:
                self.file.seek(p[0])
                p = np.fromfile(self.file, np.int64, p[1])
            out.append(p)
        return out[0] if len(out) == 1 else np.concatenate(out)


def rising(text: np.ndarray) -> np.ndarray:
    """Whether the suffix at each place is smaller than the next one; the last, a sentinel, is."""
    n = len(text)
    turn = np.full(n, n - 1)
    turn[:-1] = np.where(text[:-1] != text[1:], np.arange(n - 1), n - 1)
    turn = np.minimum.accumulate(turn[::-1])[::-1]
    out = np.ones(n, bool)
    inner = turn < n - 1
    out[inner] = text[turn[inner]] < text[turn[inner] + 1]
    return out


def _pushed(queues: BucketQueues, text: np.ndarray, places: np.ndarray, wanted: np.ndarray) -> None:
    """Queues the predecessors of ``places`` that are ``wanted`` by their symbols, in order."""
    before = places[places > 0] - 1
    before = before[wanted[before]]
    if len(before):
        symbols = text[before]
        order = np.argsort(symbols, kind="stable")
        before, symbols = before[order], symbols[order]
        cuts = [0, *(np.flatnonzero(symbols[1:] != symbols[:-1]) + 1).tolist(), len(before)]
        for lo, hi in zip(cuts, cuts[1:]):
            queues.push(int(symbols[lo]), before[lo:hi])


def induce(text: np.ndarray, up: np.ndarray, seeds: np.ndarray, symbols: int) -> np.ndarray:
    """Places of all suffixes in order, induced from ``seeds``: the leftmost rising places in
    order.  Falling suffixes first, from small symbols to large, then rising ones back."""
    order = np.argsort(text[seeds], kind="stable")
    seeds = seeds[order]
    bounds = np.searchsorted(text[seeds], np.arange(symbols + 1))
    queues, falling = BucketQueues(symbols), [[] for _ in range(symbols)]
    down = ~up
    for c in range(symbols):
        while (batch := queues.pop(c)) is not None:
            falling[c].append(batch)
            _pushed(queues, text, batch, down)
        own = seeds[bounds[c] : bounds[c + 1]]
        if len(own):
            _pushed(queues, text, own, down)
    queues, out = BucketQueues(symbols), []
    for c in range(symbols - 1, -1, -1):
        climbing = []
        while (batch := queues.pop(c)) is not None:
            climbing.append(batch)
            _pushed(queues, text, batch, up)
        first = np.concatenate(falling[c])[::-1] if falling[c] else None
        if first is not None:
            _pushed(queues, text, first, up)
        out += climbing if first is None else [*climbing, first]
    # The sentinel alone has no predecessor in order to be induced from.
    return np.concatenate([np.array([len(text) - 1]), np.concatenate(out)[::-1]]) if out else np.array([len(text) - 1])


def prefix_hashes(text: np.ndarray, seed: int = 1) -> tuple[np.ndarray, np.uint64]:
    """Sums that give the 64-bit hash of any substring, and their base."""
    rng = np.random.default_rng(seed)
    table = rng.integers(1, 2**63, int(text.max()) + 1, dtype=np.uint64)
    base = np.uint64(int(rng.integers(2**62, 2**63)) | 1)
    powers = np.full(len(text), base)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    sums = np.zeros(len(text) + 1, np.uint64)
    np.cumsum(table[text] * powers, out=sums[1:])
    return sums, base


def _inverse_powers(base: np.uint64, n: int) -> np.ndarray:
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    powers = np.full(n, inverse)
    powers[0] = 1
    return np.multiply.accumulate(powers)


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``text``, whose last symbol is a unique 0, in the order of at least their first
    ``depth`` symbols.  Substrings between leftmost rising places are named in order, the
    names are sorted by recursion, and all suffixes are induced from them."""
    symbols = int(text.max()) + 1
    if symbols > ALPHABET:
        return _doubled(text, depth)
    up = rising(text)
    marks = np.flatnonzero(up[1:] & ~up[:-1]) + 1
    if len(marks) < 2:
        return induce(text, up, marks, symbols)
    sorted_ = induce(text, up, marks, symbols)
    is_mark = np.zeros(len(text), bool)
    is_mark[marks] = True
    first = sorted_[is_mark[sorted_]]
    number = np.zeros(len(text), np.int64)
    number[marks] = np.arange(len(marks))
    ends = np.append(marks[1:], len(text) - 1) + 1
    sums, base = prefix_hashes(text)
    inverse = _inverse_powers(base, len(text))
    lengths = (ends - marks)[number[first]]
    hashes = (sums[first + lengths] - sums[first]) * inverse[first]
    new = np.ones(len(first), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (lengths[1:] != lengths[:-1])
    names = np.empty(len(marks), np.int64)
    names[number[first]] = np.cumsum(new) - 1
    # The sentinel is the last mark and has the smallest name, 0.
    order = first if new.all() else marks[suffix_order(names, max(2, depth // 2))]
    return induce(text, up, order, symbols)


def _doubled(text: np.ndarray, depth: int) -> np.ndarray:
    rank, reach = text.astype(np.int64), 1
    while True:
        after = np.zeros(len(rank), np.int64)
        after[:-reach] = rank[reach:] + 1
        keys = rank * (int(after.max()) + 1) + after
        order = np.argsort(keys, kind="stable")
        new = np.ones(len(order), bool)
        new[1:] = keys[order][1:] != keys[order][:-1]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(new) - 1
        reach *= 2
        if new.all() or reach >= depth or reach >= len(rank):
            return order


def repeated_starts(pieces: list[bytes], span: int) -> np.ndarray:
    """For the pieces one after another, whether the ``span`` bytes from each place on, within
    their piece, also start at another place of the shard."""
    lengths = np.array([len(p) for p in pieces])
    # Bytes are 2 to 257; 1 parts the pieces and 0 ends the text.
    text = np.zeros(int(lengths.sum()) + len(pieces) + 1, np.int16)
    ends = np.cumsum(lengths + 1)
    text[:-1] = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8).astype(np.int16) + 2
    text[ends - 1] = 1
    rest = np.repeat(ends - 1, lengths + 1) - np.arange(len(text) - 1)
    whole = np.append(rest >= span, False)
    order = suffix_order(text, span)
    order = order[whole[order]]
    sums, base = prefix_hashes(text, 2)
    hashes = (sums[order + span] - sums[order]) * _inverse_powers(base, len(text))[order]
    same = hashes[1:] == hashes[:-1]
    out = np.zeros(len(text), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    inside = np.ones(len(text) - 1, bool)
    inside[ends - 1] = False
    return out[:-1][inside]
