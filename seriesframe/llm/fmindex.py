"""A compressed full-text index over integers: Burrows-Wheeler transform in a wavelet matrix of packed bits.

Many searches run side by side: one backward step takes arrays of symbols and intervals.
"""

from __future__ import annotations

import numpy as np


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Sorted suffixes of seq, whose last value is its unique least one, by prefix doubling."""
    n = len(seq)
    order = np.argsort(seq, kind="stable")
    sorted_ = seq[order]
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(np.concatenate([[0], sorted_[1:] != sorted_[:-1]]))
    step = 1
    while rank[order[-1]] < n - 1:
        second = np.zeros(n, np.int64)
        second[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        sorted_ = key[order]
        rank[order] = np.cumsum(np.concatenate([[0], sorted_[1:] != sorted_[:-1]]))
        step *= 2
    return order


class _Bits:
    """A packed bit vector with counts of ones before each word of 64 bits."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        words = np.zeros(len(bits) // 64 + 1, np.uint64)
        words.view(np.uint8)[: len(packed)] = packed
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words))]).astype(np.int64)
        self.zeros = int(len(bits) - self.before[-1])

    def ones(self, at: np.ndarray) -> np.ndarray:
        """How many ones stand before each place."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class FMIndex:
    """Counts occurrences of patterns in seq (non-negative integers) by backward search.

    weight: how often each place of seq counts (once, if not given), so that repeated parts are stored once.
    """

    def __init__(self, seq: np.ndarray, weight: np.ndarray | None = None):
        seq = np.concatenate([np.asarray(seq, np.int64) + 1, [0]])  # the end sorts before all
        order = suffix_array(seq)
        last = seq[order - 1]
        weight = np.ones(len(seq), np.int64) if weight is None else np.append(weight, 1)
        self.before = np.concatenate([[0], np.cumsum(weight[order])])  # weights of the suffixes before each place in their order
        self.size = len(seq)
        self.symbols = int(seq.max()) + 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=self.symbols))])
        self.depth = max(1, int(self.symbols - 1).bit_length())
        self.levels: list[_Bits] = []
        for level in range(self.depth - 1, -1, -1):
            bits = (last >> level & 1).astype(bool)
            self.levels.append(_Bits(bits))
            last = np.concatenate([last[~bits], last[bits]])
        self.starts = self._down(np.arange(self.symbols), np.zeros(self.symbols, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where places lie in the last level's order, along the path of each symbol."""
        for k, level in enumerate(self.levels):
            ones = level.ones(at)
            up = (symbol >> (self.depth - 1 - k) & 1).astype(bool)
            at = np.where(up, level.zeros + ones, at - ones)
        return at

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of (symbol + pattern), from the intervals of the patterns; symbols as given to the constructor."""
        symbol = symbol + 1
        both = self._down(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        base = np.tile(self.first[symbol] - self.starts[symbol], 2)
        both = both + base
        return both[: len(low)], both[len(low) :]


def repeated_windows(index: FMIndex, seq: np.ndarray, begin: np.ndarray, end: np.ndarray, window: int, least: int = 2) -> list[np.ndarray]:
    """For each stream seq[begin:end]: whether the window at each of its places occurs `least` times or more in the index (by weight).

    All streams are searched side by side, each from its right end.  A window's left half goes first: where it already fails, at place f, all
    windows over [f, end of the half) fail.  Otherwise the whole window is searched, and as long as it goes on to the left, the windows
    on the way are found in one search (matching statistics above the threshold).
    """
    n = len(begin)
    places = np.maximum(end - begin - window + 1, 0)
    found = np.zeros(int(places.sum()), bool)
    base = np.concatenate([[0], np.cumsum(places)])
    half = (window + 1) // 2
    at = places - 1  # the window in question
    live = np.flatnonzero(at >= 0)
    whole = np.zeros(n, bool)
    low, high = np.zeros(n, np.int64), np.full(n, index.size, np.int64)
    next_ = begin + at + half - 1  # the next symbol to the left
    while len(live):
        lo, hi = index.step(seq[next_[live]], low[live], high[live])
        ok = index.before[hi] - index.before[lo] >= least
        place = next_[live] - begin[live]  # where the match starts now
        # failures
        bad = live[~ok]
        f = place[~ok]
        was_whole = whole[bad]
        # a half that ends before place e fails at f: windows from e - window to f fail
        skip = np.where(was_whole, np.minimum(at[bad], f), at[bad] + half - window - 1)
        # a whole search that fails at f: the window at `at` fails if f >= at, else those over f are found already
        skip = np.where(was_whole, np.where(f >= at[bad], at[bad] - 1, f), skip)
        at[bad] = skip
        whole[bad] = False
        # successes
        good = live[ok]
        low[good], high[good] = lo[ok], hi[ok]
        p = place[ok]
        hit = good[whole[good] & (p <= at[good])]
        found[base[hit] + (next_[hit] - begin[hit])] = True
        done_half = ~whole[good] & (p == at[good])
        next_[good] -= 1
        turn = good[done_half]  # the half occurs often enough: now the whole window
        whole[turn] = True
        reset = np.concatenate([bad, turn])
        low[reset], high[reset] = 0, index.size
        next_[bad] = begin[bad] + at[bad] + half - 1
        next_[turn] = begin[turn] + at[turn] + window - 1
        # a whole search that has come to the stream's start ends
        over = good[whole[good] & (next_[good] < begin[good])]
        at[over] = -1
        live = live[(at[live] >= 0)]
    return [found[a:b] for a, b in zip(base[:-1], base[1:], strict=True)]
