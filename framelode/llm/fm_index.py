"""An FM-index over a sequence of symbols: suffix order, wavelet-tree ranks, sampled suffix positions."""

from __future__ import annotations

import numpy as np


def suffix_order(seq: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; each round sorts only the suffixes that still tie. seq ends with its one 0."""
    order = np.argsort(seq, kind="stable")
    own = seq[order]
    head = np.concatenate([[True], own[1:] != own[:-1]])
    group = np.maximum.accumulate(np.where(head, np.arange(len(seq)), 0))
    rank = np.empty(len(seq), np.int64)
    rank[order] = group
    step = 1
    tied = np.flatnonzero(~(head & np.concatenate([head[1:], [True]])))
    while len(tied):
        at = order[tied]
        key = (rank[at] << 32) | rank[at + step]
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[tied] = at
        head = np.concatenate([[True], key[1:] != key[:-1]])
        place = np.maximum.accumulate(np.where(head, tied, 0))
        rank[at] = place
        tied = tied[~(head & np.concatenate([head[1:], [True]]))]
        step *= 2
    return order


class Bits:
    """A bit vector with ranks: 64-bit words, and the ones before each."""

    def __init__(self, flags: np.ndarray):
        padded = np.zeros((len(flags) // 64 + 1) * 64, bool)
        padded[: len(flags)] = flags
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words).astype(np.int64))])[:-1]

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones among the first `at` bits."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


class Wavelet:
    """A wavelet tree laid out level by level, high bits first."""

    def __init__(self, seq: np.ndarray, depth: int):
        self.depth, self.levels, self.zeros = depth, [], []
        for level in reversed(range(depth)):
            flags = (seq >> level) & 1 == 1
            self.levels.append(Bits(flags))
            self.zeros.append(len(seq) - int(flags.sum()))
            seq = np.concatenate([seq[~flags], seq[flags]])

    def ranks(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol among the first `at`."""
        low, high = np.zeros(len(at), np.int64), at
        for level, (bits, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            one = (symbol >> (self.depth - 1 - level)) & 1 == 1
            a, b = bits.ones(low), bits.ones(high)
            low, high = np.where(one, zeros + a, low - a), np.where(one, zeros + b, high - b)
        return high - low

    def step(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place and how often it occurs before."""
        symbol, low, high = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), at
        for bits, zeros in zip(self.levels, self.zeros, strict=True):
            one = bits.get(high)
            a, b = bits.ones(low), bits.ones(high)
            low, high = np.where(one, zeros + a, low - a), np.where(one, zeros + b, high - b)
            symbol = symbol * 2 + one
        return symbol, high - low


class FMIndex:
    """Counts and locates phrases. seq: symbols from 1 up to `symbols`; a 0 is put at its end."""

    def __init__(self, seq: np.ndarray, symbols: int, sample: int = 8):
        seq = np.concatenate([seq, [0]]).astype(np.int64)
        order = suffix_order(seq)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=symbols + 1))])
        self.tree = Wavelet(seq[order - 1], max(1, int(symbols).bit_length()))
        marked = (order % sample == 0) | (order == 0)
        self.marked, self.samples, self.size = Bits(marked), order[marked], len(seq)

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of all phrases at once. phrases: right-aligned rows; returns the range of suffixes of each."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size)
        width = phrases.shape[1]
        for back in range(width):
            on = np.flatnonzero((lengths > back) & (low < high))
            if not len(on):
                break
            symbol = phrases[on, width - 1 - back]
            low[on], high[on] = self.first[symbol] + self.tree.ranks(symbol, low[on]), self.first[symbol] + self.tree.ranks(symbol, high[on])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of the suffixes in these rows: back through the text up to a sampled position."""
        found, steps, at, own = np.empty(len(rows), np.int64), 0, rows, np.arange(len(rows))
        while len(at):
            done = self.marked.get(at)
            found[own[done]] = self.samples[self.marked.ones(at[done])] + steps
            at, own = at[~done], own[~done]
            symbol, before = self.tree.step(at)
            at = self.first[symbol] + before
            steps += 1
        return found
