"""External induced sorting of the suffixes of a shard, with common-prefix values.

Suffixes are told apart as rising (S) or falling (L). The leftmost rising ones of each run (LMS) are sorted first; all
others follow by induction: a pass over the sorted suffixes hands each suffix's left neighbour to a priority queue
under its first symbol, first the falling suffixes from the left, then the rising ones from the right. The queue holds
tuples (place, common prefix with the tuple before) and leaves them by symbol and, within a symbol, by arrival; it
works in blocks and writes what exceeds its share of memory to disk. A tuple's common prefix is one more than the
least common prefix that the pass saw since it last handed over a suffix under the same symbol.

The LMS suffixes themselves are sorted by inducing their substrings, naming these, and sorting the reduced string of
names. Only prefixes up to a horizon must be in order, so that level doubles the ranks of names until they reach it.
"""

from __future__ import annotations

import os
import shutil
import tempfile

import numpy as np

#: Tuples that a queue keeps in memory, and how many it hands out at a time.
MEMORY_TUPLES = 4_000_000
BLOCK = 1 << 20
TUPLE = np.dtype([("place", "<i8"), ("lcp", "<i2")])


class BucketQueue:
    """A monotone priority queue: tuples leave by symbol, then in the order of their arrival."""

    def __init__(self, symbols: int, folder: str, memory: int = MEMORY_TUPLES):
        self._folder, self._memory, self._held = tempfile.mkdtemp(dir=folder), memory, 0
        self._blocks: list[list[np.ndarray]] = [[] for _ in range(symbols)]
        self._stored = [False] * symbols

    def push(self, symbol: int, places: np.ndarray, lcps: np.ndarray) -> None:
        rows = np.empty(len(places), dtype=TUPLE)
        rows["place"], rows["lcp"] = places, lcps
        self._blocks[symbol].append(rows)
        self._held += len(rows)
        if self._held > self._memory:
            self._spill()

    def _file(self, symbol: int) -> str:
        return os.path.join(self._folder, str(symbol))

    def _spill(self) -> None:
        for symbol, blocks in enumerate(self._blocks):
            if blocks:
                with open(self._file(symbol), "ab") as out:
                    for rows in blocks:
                        rows.tofile(out)
                self._stored[symbol] = True
        self._blocks = [[] for _ in self._blocks]
        self._held = 0

    def take(self, symbol: int):
        """What the symbol holds now, in blocks; what is pushed meanwhile waits for the next call."""
        held, self._blocks[symbol] = self._blocks[symbol], []
        self._held -= sum(map(len, held))
        if self._stored[symbol]:
            self._stored[symbol] = False
            taken = self._file(symbol) + ".taken"
            os.replace(self._file(symbol), taken)
            for at in range(0, os.path.getsize(taken) // TUPLE.itemsize, BLOCK):
                yield np.fromfile(taken, TUPLE, BLOCK, offset=at * TUPLE.itemsize)
            os.remove(taken)
        if held:
            yield np.concatenate(held)

    def take_reversed(self, symbol: int):
        """What the symbol holds, last first, in blocks."""
        held, self._blocks[symbol] = self._blocks[symbol], []
        self._held -= sum(map(len, held))
        if held:
            yield np.concatenate(held)[::-1]
        if self._stored[symbol]:
            self._stored[symbol] = False
            path = self._file(symbol)
            many = os.path.getsize(path) // TUPLE.itemsize
            for at in range((many - 1) // BLOCK * BLOCK, -1, -BLOCK):
                yield np.fromfile(path, TUPLE, BLOCK, offset=at * TUPLE.itemsize)[::-1]
            os.remove(path)

    def any(self, symbol: int) -> bool:
        return bool(self._blocks[symbol]) or self._stored[symbol]

    def close(self) -> None:
        shutil.rmtree(self._folder, ignore_errors=True)


class _Carry:
    """The least common prefix since the last suffix handed over, for each symbol."""

    def __init__(self, symbols: int, horizon: int):
        self.least = np.full(symbols, -1, dtype=np.int16)  # nothing handed over yet: the next one starts its bucket
        self.horizon = horizon

    def hand_over(self, queue: BucketQueue, rows: np.ndarray, symbols: np.ndarray, chosen: np.ndarray) -> None:
        """Push the left neighbours of the chosen rows under their symbols."""
        lcps = rows["lcp"]
        places = np.flatnonzero(chosen)
        own = symbols[places].astype(np.uint16)
        order = np.argsort(own, kind="stable")
        places, own = places[order], own[order]
        edges = np.flatnonzero(np.diff(own)) + 1
        after = np.minimum(self.least, lcps.min()) if len(lcps) else self.least
        for group in np.split(places, edges) if len(places) else ():
            symbol = int(symbols[group[0]])
            since = np.minimum.reduceat(lcps, np.concatenate([[0], group[:-1] + 1]))[: len(group)] if len(group) > 1 else None
            if since is None:
                since = np.array([lcps[: group[0] + 1].min()], dtype=np.int16)
            else:
                # reduceat's intervals end before the next start: exactly at the suffix handed over, but for the last
                since[-1] = lcps[group[-2] + 1 : group[-1] + 1].min()
            since[0] = min(since[0], self.least[symbol])
            queue.push(symbol, rows["place"][group] - 1, np.minimum(since + 1, self.horizon))
            rest = lcps[group[-1] + 1 :]
            after[symbol] = rest.min() if len(rest) else self.horizon
        self.least = after


def kinds(text: np.ndarray) -> np.ndarray:
    """True where the suffix is rising; the last symbol must be the only least one."""
    n = len(text)
    change = np.flatnonzero(text[1:] != text[:-1])
    rising = np.ones(n, dtype=bool)
    run_rises = text[change] < text[change + 1]
    sizes = np.diff(np.concatenate([[0], change + 1]))
    rising[: n - 1] = np.repeat(run_rises, sizes)[: n - 1]
    return rising


def _common(text: np.ndarray, a: int, b: int, horizon: int) -> int:
    n = min(horizon, len(text) - max(a, b))
    differ = np.flatnonzero(text[a : a + n] != text[b : b + n])
    return int(differ[0]) if len(differ) else n


def _induce(text: np.ndarray, seeds: np.ndarray, seed_lcps: np.ndarray, symbols: int, horizon: int, folder: str, memory: int):
    """Yield (places, lcps) of all suffixes but the last symbol's, greatest first, from sorted LMS suffixes."""
    falling, ordered, rising = (BucketQueue(symbols, folder, memory) for _ in range(3))
    try:
        carry = _Carry(symbols, horizon)
        starts = np.searchsorted(text[seeds], np.arange(symbols + 1))
        last = np.full(symbols, -1, dtype=np.int64)

        def neighbours(rows, c, keep):
            before = rows["place"] - 1
            found = text[before].astype(np.int64)  # place 0 looks at the last symbol, the least one
            return found, keep(found, c) & (before >= 0)

        for c in range(symbols):
            while falling.any(c):
                for rows in falling.take(c):
                    for at in range(0, len(rows), BLOCK):
                        part = rows[at : at + BLOCK]
                        ordered.push(c, part["place"], part["lcp"])
                        last[c] = part["place"][-1]
                        carry.hand_over(falling, part, *neighbours(part, c, np.greater_equal))
            for at in range(starts[c], starts[c + 1], BLOCK):
                stop = min(at + BLOCK, starts[c + 1])
                rows = np.empty(stop - at, dtype=TUPLE)
                rows["place"], rows["lcp"] = seeds[at:stop], seed_lcps[at:stop]
                if at == starts[c]:
                    rows["lcp"][0] = _common(text, int(last[c]), int(seeds[at]), horizon) if last[c] >= 0 else 0
                carry.hand_over(falling, rows, *neighbours(rows, c, np.greater))
        carry = _Carry(symbols, horizon)
        for c in range(symbols - 1, -1, -1):
            final = -1
            while rising.any(c):
                for rows in rising.take(c):
                    yield rows["place"], rows["lcp"]
                    final = int(rows["place"][-1])
                    for at in range(0, len(rows), BLOCK):
                        part = rows[at : at + BLOCK]
                        carry.hand_over(rising, part, *neighbours(part, c, np.less_equal))
            pending = None  # a suffix's common prefix with the next greater one stands in that one's tuple
            for rows in ordered.take_reversed(c):
                if not len(rows):
                    continue
                turned = rows.copy()
                turned["lcp"][1:] = rows["lcp"][:-1]
                if pending is None:
                    turned["lcp"][0] = _common(text, int(rows["place"][0]), final, horizon) if final >= 0 else 0
                else:
                    turned["lcp"][0] = pending
                pending = rows["lcp"][-1]
                yield turned["place"], turned["lcp"]
                for at in range(0, len(turned), BLOCK):
                    part = turned[at : at + BLOCK]
                    carry.hand_over(rising, part, *neighbours(part, c, np.less))
    finally:
        for queue in (falling, ordered, rising):
            queue.close()


def _words(text: np.ndarray) -> np.ndarray:
    """At each place the four symbols from there on, the first in the lowest bits."""
    padded = np.concatenate([text, np.zeros(3, text.dtype)]).astype(np.uint64)
    n = len(text)
    return padded[:n] | padded[1 : n + 1] << np.uint64(16) | padded[2 : n + 2] << np.uint64(32) | padded[3 : n + 3] << np.uint64(48)


def _equal_before(words: np.ndarray, places: np.ndarray, lengths: np.ndarray | None, horizon: int) -> np.ndarray:
    """Common prefix, up to the horizon and to lengths if given, of each place with the place before it."""
    n = len(words)
    most = np.minimum(horizon, n - np.maximum(places[1:], places[:-1]))
    if lengths is not None:
        most = np.minimum(most, np.minimum(lengths[1:], lengths[:-1]))
    common = most.astype(np.int16)
    active = np.arange(len(most))
    a, b = places[1:], places[:-1]
    for k in range(0, horizon, 4):
        differ = words[a + k] ^ words[b + k]
        stop = np.flatnonzero(differ)
        if len(stop):
            least = differ[stop]
            equal = (np.bitwise_count((least & -least) - np.uint64(1)) >> 4) + k
            common[active[stop]] = np.minimum(common[active[stop]], equal)
        go = np.flatnonzero((differ == 0) & (most[active] > k + 4))
        if not len(go):
            break
        active, a, b = active[go], a[go], b[go]
    return np.concatenate([np.zeros(1, np.int16), common])[: len(places)]


def _ranks(names: np.ndarray, horizon: int) -> np.ndarray:
    """The order of the suffixes of a string of names, as far as `horizon` names; only ties are sorted again."""
    n = len(names)
    rank = names - names.min()
    order = np.argsort(rank, kind="stable")
    span = 1
    ties = np.arange(n)  # places in the order whose ranks are not settled
    rank = _settled(rank[order], order, np.zeros(n, np.int64))
    while span < horizon:
        own = rank[order[ties]]
        joined = np.zeros(len(ties), dtype=bool)
        joined[1:] = own[1:] == own[:-1]
        joined[:-1] |= joined[1:]
        ties, own = ties[joined], own[joined]
        if not len(ties):
            break
        places = order[ties]
        further = np.where(places + span < n, rank[np.minimum(places + span, n - 1)] + 1, 0)
        joint = own * (n + 2) + further
        turn = np.argsort(joint, kind="stable")
        order[ties] = places[turn]
        joint, own = joint[turn], own[turn]
        # a rank is the place in the order of the first that has it
        heads = np.concatenate([[True], joint[1:] != joint[:-1]])
        rank[places[turn]] = np.repeat(ties[heads], np.diff(np.concatenate([np.flatnonzero(heads), [len(ties)]])))
        span *= 2
    return order


def _settled(values: np.ndarray, order: np.ndarray, rank: np.ndarray) -> np.ndarray:
    heads = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    rank[order] = np.repeat(heads, np.diff(np.concatenate([heads, [len(values)]])))
    return rank


def sorted_suffixes(text: np.ndarray, horizon: int, folder: str | None = None, memory: int = MEMORY_TUPLES):
    """Yield (places, lcps) of all suffixes, greatest first; lcps are with the suffix yielded before.

    Symbols are small unsigned numbers; the last must be the only least one. Order and common prefixes are exact up to
    the horizon; suffixes that agree so far come in any order.
    """
    folder = tempfile.mkdtemp(dir=folder)
    try:
        symbols = int(text.max()) + 1
        rising, words = kinds(text), _words(text)
        lms = np.flatnonzero(rising[1:] & ~rising[:-1]) + 1
        if len(lms) > 1:
            is_lms = np.zeros(len(text), dtype=bool)
            is_lms[lms] = True
            first = lms[np.argsort(text[lms], kind="stable")]
            parts = [p[is_lms[p]] for p, _ in _induce(text, first, np.zeros(len(first), np.int16), symbols, horizon, folder, memory)]
            by_substring = np.concatenate([lms[-1:], *[p[::-1] for p in reversed(parts)]])
            size = np.zeros(len(text), dtype=np.int32)
            size[lms[:-1]] = np.diff(lms) + 1
            size[lms[-1]] = 1
            sizes = size[by_substring]
            same = _equal_before(words, by_substring, sizes, horizon)
            new = np.ones(len(lms), dtype=bool)
            # substrings that agree as far as the horizon need no telling apart
            new[1:] = ~(((sizes[1:] == sizes[:-1]) & (same[1:] == sizes[1:])) | (same[1:] >= horizon))
            names = np.zeros(len(text), dtype=np.int64)
            names[by_substring] = np.cumsum(new)
            seeds = lms[_ranks(names[lms], -(-horizon // 2))]  # each name moves on by two symbols at least
        else:
            seeds = lms
        yield from _induce(text, seeds, _equal_before(words, seeds, None, horizon), symbols, horizon, folder, memory)
    finally:
        shutil.rmtree(folder, ignore_errors=True)
