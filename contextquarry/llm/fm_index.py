"""A compressed FM-index over words, searched for many patterns at once."""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector with rank: packed words and the number of ones before each."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(np.concatenate([bits.astype(np.uint8), np.zeros(-len(bits) % 64 + 64, np.uint8)]), bitorder="little")
        self.words = packed.view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]])
        self.zeros = len(bits) - int(bits.sum())

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)


    def select(self, k: np.ndarray) -> np.ndarray:
        """The positions of the ones with the numbers k, from 0."""
        word = np.searchsorted(self.before, k, side="right") - 1
        rest, bits, at = k - self.before[word], self.words[word], word << 6
        for width in (32, 16, 8, 4, 2, 1):
            low = bits & np.uint64((1 << width) - 1)
            count = np.bitwise_count(low).astype(np.int64)
            above = rest >= count
            rest, at = rest - count * above, at + width * above
            bits = np.where(above, bits >> np.uint64(width), low)
        return at


class WaveletTree:
    """The levels of a sequence's bits, highest first, each sorted stably by the bits above: rank in as many steps as bits."""

    def __init__(self, values: np.ndarray, largest: int):
        self.levels: list[tuple[int, Bits]] = []
        for bit in range(max(1, int(largest).bit_length()) - 1, -1, -1):
            one = (values >> bit) & 1
            self.levels.append((bit, Bits(one)))
            values = np.concatenate([values[one == 0], values[one == 1]])

    def rank(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the symbol's run begins on the last level, and how often it occurs before low and before high."""
        start = np.zeros_like(low)
        for bit, level in self.levels:
            one = ((symbol >> bit) & 1).astype(bool)
            ones = [level.ones(x) for x in (start, low, high)]
            start, low, high = (np.where(one, level.zeros + o, x - o) for x, o in zip((start, low, high), ones, strict=True))
        return start, low - start, high - start


class FMIndex:
    """An index of texts (arrays of symbols from 1 on) for patterns of up to `depth` symbols.

    Suffixes are sorted by their first 2 ** r >= depth symbols. Kept are the wavelet tree of the symbols before them, for each length up to depth a bit vector of
    the suffixes that differ from the one before within that length, and one of the suffixes of texts of weight 2 (the others weigh 1). A zero ends each text; patterns hold none.
    """

    def __init__(self, texts: list[np.ndarray], weights: np.ndarray, depth: int):
        ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
        n = int(ends[-1]) if len(texts) else 0
        symbols = np.zeros(n, np.int64)
        inside = np.ones(n, bool)
        inside[ends - 1] = False
        symbols[inside] = np.concatenate([*texts, np.zeros(0, np.int64)])
        self.size, self.depth = n, depth
        rank, have, ranks = symbols, 1, {1: symbols.astype(np.int32)}
        while have < depth:
            rank = self._double(rank, rank, have)
            have *= 2
            ranks[have] = rank.astype(np.int32)
        order = np.argsort(rank, kind="stable")
        # how many symbols a suffix shares with the one before it, up to depth: widths from the longest on, while ranks are equal
        shared = np.zeros(n, np.int64)
        for width in sorted(ranks, reverse=True):
            a, b = order[1:] + shared[1:], order[:-1] + shared[1:]
            good = np.flatnonzero((a < n) & (b < n))
            equal = good[ranks[width][a[good]] == ranks[width][b[good]]]
            shared[1 + equal] += width
        shared[:1] = -1
        self.differs = [Bits(shared < length) for length in range(1, depth + 1)]
        before = symbols[order - 1]  # the last text ends in a zero
        self.largest = int(symbols.max(initial=0))
        self.tree = WaveletTree(before, self.largest)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols))])
        self.heavy = Bits((np.repeat(weights, [len(t) + 1 for t in texts]) > 1)[order]) if n else Bits(np.zeros(0, bool))

    @staticmethod
    def _shifted(rank: np.ndarray, by: int) -> np.ndarray:
        return np.concatenate([rank[by:], np.zeros(min(by, len(rank)), rank.dtype)])

    def _double(self, rank: np.ndarray, other: np.ndarray, by: int) -> np.ndarray:
        pair = rank * (int(other.max(initial=0)) + 1) + self._shifted(other, by)
        order = np.argsort(pair, kind="stable")
        new = np.empty_like(rank)
        ordered = pair[order]
        new[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
        return new

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the patterns with one more symbol in front; empty for symbols that the index doesn't have."""
        known = (symbol > 0) & (symbol <= self.largest)
        own = np.where(known, symbol, 0)
        _, a, b = self.tree.rank(own, low, high)
        return self.first[own] + a, self.first[own] + np.where(known, b, a)

    def shorten(self, length: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the patterns' first `length` symbols, the same for all with that length."""
        low, high = low.copy(), high.copy()
        for k in np.unique(length):
            own = np.flatnonzero(length == k)
            if k == 0:
                low[own], high[own] = 0, self.size
                continue
            bits, ones = self.differs[k - 1], self.size - self.differs[k - 1].zeros
            group = bits.ones(low[own] + 1) - 1
            low[own] = bits.select(group)
            last = group + 1 >= ones
            high[own] = np.where(last, self.size, bits.select(np.minimum(group + 1, ones - 1)))
        return low, high

    def weight(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return high - low + self.heavy.ones(high) - self.heavy.ones(low)

    def matching(self, texts: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The matching statistics of any texts: for each start, how many symbols from there on stand somewhere in the index, up to depth, and the weight of all places where they do.

        The texts are read from their ends, all in step. Where no place has one more symbol in front, the pattern loses symbols at its end until one
        has, or none is left.
        """
        size = np.array([len(t) for t in texts], np.int64)
        flat, starts = np.concatenate([*texts, np.zeros(0, np.int64)]).astype(np.int64), np.concatenate([[0], np.cumsum(size)])
        lengths, weights = np.zeros(int(starts[-1]), np.int64), np.zeros(int(starts[-1]), np.int64)
        own = np.flatnonzero(size > 0)
        low, high, length = np.zeros(len(own), np.int64), np.full(len(own), self.size, np.int64), np.zeros(len(own), np.int64)
        for step in range(int(size.max(initial=0))):
            on = size[own] > step
            own, low, high, length = own[on], low[on], high[on], length[on]
            place = starts[own] + size[own] - 1 - step
            full = np.flatnonzero(length == self.depth)
            length[full] -= 1
            low[full], high[full] = self.shorten(length[full], low[full], high[full])
            todo = np.arange(len(own))
            while len(todo):
                a, b = self.extend(flat[place[todo]], low[todo], high[todo])
                found = a < b
                good, rest = todo[found], todo[~found]
                low[good], high[good] = a[found], b[found]
                length[good] += 1
                todo = rest[length[rest] > 0]
                length[todo] -= 1
                low[todo], high[todo] = self.shorten(length[todo], low[todo], high[todo])
            lengths[place] = length
            some = length > 0
            weights[place[some]] = self.weight(low[some], high[some])
        return [(lengths[a:b], weights[a:b]) for a, b in zip(starts, starts[1:], strict=False)]
