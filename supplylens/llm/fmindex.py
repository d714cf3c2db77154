"""An FM-index over a sequence of symbols, on numpy arrays and for many patterns at once."""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Starts of the sorted suffixes; a suffix that is a prefix of another comes first."""
    n = len(symbols)
    _, rank = np.unique(symbols, return_inverse=True)
    rank, step = rank.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while n:
        later = np.zeros(n, np.int64)
        later[:n - step] = rank[step:] + 1
        key = rank * (n + 1) + later
        order = np.argsort(key, kind="stable")
        new = np.ones(n, np.int64)
        new[0] = 0
        new[1:] = key[order[1:]] != key[order[:-1]]
        names = np.cumsum(new)
        rank = np.empty(n, np.int64)
        rank[order] = names
        step *= 2
        if names[-1] == n - 1 or step >= n:
            break
    return order


class WaveletTree:
    """Counts of any symbol in any prefix: one bit of the symbols per level, stably parted."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.zeros, self.ones = bits, [], []
        for level in range(bits - 1, -1, -1):
            bit = (symbols >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]))
            self.zeros.append(len(symbols) - int(bit.sum()))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        start, stop = np.zeros_like(stop), stop
        for level, (zeros, ones) in enumerate(zip(self.zeros, self.ones, strict=True)):
            one = (symbol >> (self.bits - 1 - level)) & 1 == 1
            start = np.where(one, zeros + ones[start], start - ones[start])
            stop = np.where(one, zeros + ones[stop], stop - ones[stop])
        return stop - start

    def at(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place and how often it occurs before."""
        symbol, start = np.zeros_like(place), np.zeros_like(place)
        for zeros, ones in zip(self.zeros, self.ones, strict=True):
            one = ones[place + 1] > ones[place]
            symbol = symbol * 2 + one
            start = np.where(one, zeros + ones[start], start - ones[start])
            place = np.where(one, zeros + ones[place], place - ones[place])
        return symbol, place - start


class FMIndex:
    """Symbols are 1 and up. ``sample`` is the distance of the suffix positions that are stored."""

    def __init__(self, symbols: np.ndarray, sample: int = 8):
        symbols = np.append(symbols, 0).astype(np.int64)
        order = suffix_array(symbols)
        last = symbols[order - 1]
        self.n, self.sigma = len(symbols), int(symbols.max()) + 1
        self.tree = WaveletTree(last, max(1, (self.sigma - 1).bit_length()))
        self.below = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=self.sigma))])
        known = order % sample == 0
        self.known = known
        self.known_before = np.concatenate([[0], np.cumsum(known)])
        self.positions = order[known]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that begin with each pattern (rows, right-aligned)."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        width = patterns.shape[1]
        for k in range(width - 1, -1, -1):
            live = np.flatnonzero((lengths >= width - k) & (low < high))
            symbol = patterns[live, k]
            inside = symbol < self.sigma
            high[live[~inside]] = low[live[~inside]]
            live, symbol = live[inside], symbol[inside]
            low[live] = self.below[symbol] + self.tree.rank(symbol, low[live])
            high[live] = self.below[symbol] + self.tree.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, places: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: steps back to the nearest stored one."""
        out, steps = np.empty(len(places), np.int64), 0
        waiting = np.arange(len(places))
        while len(waiting):
            done = self.known[places]
            out[waiting[done]] = self.positions[self.known_before[places[done]]] + steps
            waiting, places = waiting[~done], places[~done]
            symbol, before = self.tree.at(places)
            places = self.below[symbol] + before
            steps += 1
        return out
