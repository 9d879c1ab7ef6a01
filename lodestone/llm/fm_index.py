"""A compressed FM-index of word sequences, with matching statistics for many queries at once.

The index holds the Burrows-Wheeler transform of the segments as a wavelet matrix of
packed bit vectors with block ranks. Backward search narrows a suffix range by one word
to the left; where a word can't be added, the range goes to its parent, that of the
longest proper prefix that occurs more often, found from the longest common prefixes
by binary descent. All queries advance in step, so each step is a few array operations.

Beside the packed bits, the index keeps 32-bit ranges and weights and 8- or 16-bit prefix
lengths; an index without sequences matches nothing. Sequences and queries may be empty.
"""

from __future__ import annotations

import numpy as np

_LOW = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)


class Bits:
    """A packed bit vector with the number of ones before each 64-bit block."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, np.uint8)
        padded[:n] = bits
        self.blocks = np.packbits(padded, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.blocks).astype(np.int32)
        self.before = np.concatenate([[0], np.cumsum(ones)[:-1]]).astype(np.int32)
        self.zeros = n - int(ones.sum())

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        block = i >> 6
        return self.before[block] + np.bitwise_count(self.blocks[block] & _LOW[i & 63])


class WaveletMatrix:
    """Ranks of symbols in a sequence of small integers."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.depth = max(1, int(size - 1).bit_length())
        self.levels: list[Bits] = []
        for level in range(self.depth - 1, -1, -1):
            bit = (symbols >> level) & 1
            self.levels.append(Bits(bit))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])
        self.first = self.follow(np.arange(size), np.zeros(size, np.int64))

    def follow(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, bits in enumerate(self.levels):
            one = ((symbol >> (self.depth - 1 - k)) & 1).astype(bool)
            r = bits.rank(i)
            i = np.where(one, bits.zeros + r, i - r)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        return self.follow(symbol, i) - self.first[symbol]


def suffix_ranks(text: np.ndarray, depth: int) -> list[np.ndarray]:
    """Dense ranks of the suffixes by their first 1, 2, 4, ... symbols, up to ``depth`` of them."""
    n = len(text)
    _, rank = np.unique(text, return_inverse=True)
    ranks, h = [rank.astype(np.int32)], 1
    while h < depth and ranks[-1].max(initial=0) < n - 1:
        key = ranks[-1] * np.int64(n + 1)
        key[:-h] += ranks[-1][h:] + 1
        order = np.argsort(key)
        key = key[order]
        new = np.zeros(n, np.int32)
        new[order[1:]] = np.cumsum(key[1:] != key[:-1], dtype=np.int32)
        ranks.append(new)
        h *= 2
    return ranks


class FMIndex:
    """Index of weighted word sequences; a sequence of weight w counts as w copies."""

    def __init__(self, words: np.ndarray, lengths: np.ndarray, weights: np.ndarray):
        self.alphabet, symbol = np.unique(words, return_inverse=True)
        count, total = len(lengths), len(words) + len(lengths)
        ends = np.cumsum(lengths + 1) - 1
        text = np.empty(total, np.int64)
        is_end = np.zeros(total, bool)
        is_end[ends] = True
        text[~is_end] = symbol + count  # words rank after the separators, each of which is a symbol of its own
        text[ends] = np.arange(count)
        longest = int(lengths.max(initial=0)) + 1
        ranks = suffix_ranks(text, longest)
        order = np.argsort(ranks[-1], kind="stable")
        self.size = total
        self.common = self._common(ranks, order).astype(np.int8 if longest < 128 else np.int16 if longest < 1 << 15 else np.int32)
        del ranks
        self.weight = np.zeros(total + 1, np.int32)
        np.cumsum(np.repeat(np.minimum(weights, 2), lengths + 1)[order], out=self.weight[1:])  # at most two a suffix
        plain = np.where(is_end, 0, text - count + 1).astype(np.int32)
        del text, is_end
        self.bwt = WaveletMatrix(plain[order - 1], len(self.alphabet) + 1)
        occurrences = np.bincount(plain, minlength=len(self.alphabet) + 1)
        self.before = np.concatenate([[0], np.cumsum(occurrences)[:-1]])
        self._minima()

    @staticmethod
    def _common(ranks: list[np.ndarray], order: np.ndarray) -> np.ndarray:
        """Longest common prefix of each suffix with the one before it in order; 0 at both ends."""
        n = len(order)
        if not n:
            return np.zeros(1, np.int64)
        a, b = order[:-1], order[1:]
        size = np.zeros(n - 1, np.int64)
        for k in range(len(ranks) - 1, -1, -1):
            x, y = a + size, b + size
            inside = np.maximum(x, y) < n
            x, y = np.where(inside, x, 0), np.where(inside, y, 0)
            size += np.where(inside & (ranks[k][x] == ranks[k][y]), 1 << k, 0)
        return np.concatenate([[0], size, [0]])

    def _minima(self) -> None:
        """Minima of 1, 2, 4, ... consecutive common prefixes."""
        self.minima = [self.common]
        h = 1
        while 2 * h <= len(self.common):
            last = self.minima[-1]
            self.minima.append(np.minimum(last[:-h], last[h:]))
            h *= 2

    def parent(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Range and length of the longest proper prefix with a larger range."""
        length = np.maximum(self.common[lo], self.common[hi])
        lo, hi = lo.copy(), hi.copy()
        n = len(self.common)
        for k in range(len(self.minima) - 1, -1, -1):
            m, h = self.minima[k], 1 << k
            at = lo - h + 1
            ok = at >= 0
            ok &= m[np.where(ok, at, 0)] >= length
            lo = np.where(ok, lo - h, lo)
            ok = hi + h <= n
            ok &= m[np.where(ok, hi, 0)] >= length
            hi = np.where(ok, hi + h, hi)
        return np.maximum(lo, 0), np.minimum(hi, self.size), length.astype(np.int64)

    def matching_statistics(self, words: np.ndarray, lengths: np.ndarray, least: int = 2) -> np.ndarray:
        """For each word of each query: how many words from it on occur at least ``least`` times in the index.

        Words that the index doesn't have match nothing.
        """
        at = np.searchsorted(self.alphabet, words)
        known = at < len(self.alphabet)
        known[known] = self.alphabet[at[known]] == words[known]
        symbol = np.where(known, at + 1, 0)
        out = np.zeros(len(words), np.int32)
        stop = np.cumsum(lengths)
        begin = stop - lengths
        live = np.flatnonzero(lengths > 0)
        pos, floor = stop[live] - 1, begin[live]
        lo, hi, size = np.zeros(len(live), np.int64), np.full(len(live), self.size, np.int64), np.zeros(len(live), np.int64)
        while len(pos):
            c = symbol[pos]
            a = self.before[c] + self.bwt.rank(c, lo)
            b = self.before[c] + self.bwt.rank(c, hi)
            ok = (c > 0) & (self.weight[b] - self.weight[a] >= least)
            lo, hi, size = np.where(ok, a, lo), np.where(ok, b, hi), size + ok
            out[pos[ok]] = size[ok]
            none = ~ok & ((size == 0) | (c == 0))
            lo[none], hi[none], size[none] = 0, self.size, 0
            up = np.flatnonzero(~ok & ~none)
            if len(up):
                lo[up], hi[up], size[up] = self.parent(lo[up], hi[up])
                bare = up[size[up] == 0]
                lo[bare], hi[bare] = 0, self.size
            pos = pos - (ok | none)
            go = pos >= floor
            if not go.all():
                pos, floor, lo, hi, size = pos[go], floor[go], lo[go], hi[go], size[go]
        return out
