"""An FM-index over the words of one shard: suffix order, wavelet matrix, sampled positions.

Everything is arrays: a search takes all phrases at once and goes one word back per step.
"""

from __future__ import annotations

import numpy as np

BITS = 20
#: Symbols of one index, words and ends together; a rank and a position fit in 20 bits each.
MOST_SYMBOLS = (1 << BITS) - 2
_MASK = np.uint64((1 << BITS) - 1)
_U = np.uint64


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Positions of all suffixes in order, by prefix doubling; only ties are sorted again.

    A suffix that ends sorts before those that go on. Keys, ranks and positions share one 64-bit
    word, so that each round is one plain sort.
    """
    n = len(symbols)
    rank = np.zeros(n + 1, np.uint64)
    rank[:n] = symbols + _U(1)
    order = np.arange(n, dtype=np.uint64)
    places = np.arange(n)
    step = 1
    while len(places):
        index = order[places]
        follow = rank[np.minimum(index + _U(step), _U(n))]
        keys = np.sort(((rank[index] << _U(BITS)) | follow) << _U(BITS) | index)
        index = keys & _MASK
        order[places] = index
        keys >>= _U(BITS)
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        first = np.flatnonzero(new)
        rank[index] = (places[first][np.cumsum(new) - 1] + 1).astype(np.uint64)
        tied = ~new
        tied[:-1] |= ~new[1:]
        places = places[tied]
        step *= 2
    return order.astype(np.int64)


class BitRank:
    """Bits with the number of ones before any place."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words) + 1, np.int32)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])
        self.ones = int(self.before[-1])

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & _U(1) == 1

    def rank(self, at: np.ndarray) -> np.ndarray:
        low = (_U(1) << (at & 63).astype(np.uint64)) - _U(1)
        return self.before[at >> 6] + np.bitwise_count(self.words[at >> 6] & low).astype(np.int64)


class Wavelet:
    """Wavelet matrix: for any symbol and place, how often it stands before that place."""

    def __init__(self, symbols: np.ndarray, largest: int):
        self.levels: list[tuple[int, BitRank, int]] = []
        for bit in range(max(1, int(largest).bit_length()) - 1, -1, -1):
            ones = (symbols >> bit) & 1
            level = BitRank(ones)
            self.levels.append((bit, level, len(symbols) - level.ones))
            is_one = ones.astype(bool)
            symbols = np.concatenate([symbols[~is_one], symbols[is_one]])

    def place(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the symbol's next occurrence from ``at`` on stands after the last level."""
        for bit, level, zeros in self.levels:
            ones = level.rank(at)
            at = np.where((symbols >> bit) & 1 == 1, zeros + ones, at - ones)
        return at

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and its place after the last level."""
        symbols = np.zeros(len(at), np.int64)
        for bit, level, zeros in self.levels:
            one, ones = level.get(at), level.rank(at)
            symbols |= one.astype(np.int64) << bit
            at = np.where(one, zeros + ones, at - ones)
        return symbols, at


class FMIndex:
    """Index of pieces of word hashes; pieces are separated, so no phrase spans two of them."""

    def __init__(self, pieces: list[np.ndarray], sample: int = 16):
        sizes = np.array([len(p) for p in pieces], np.int64)
        n = int(sizes.sum()) + len(pieces)
        if n > MOST_SYMBOLS:
            raise ValueError(f"{n} symbols in one index, at most {MOST_SYMBOLS}")
        ends = np.cumsum(sizes + 1) - 1
        is_word = np.ones(n, bool)
        is_word[ends] = False
        at = np.flatnonzero(is_word)
        hashes = np.concatenate(pieces) if pieces else np.zeros(0, np.uint64)
        # words by the upper 44 bits of their hash, packed with their place: one sort names them all
        keys = np.sort((hashes & ~_MASK) | np.arange(len(hashes), dtype=np.uint64))
        names = keys >> _U(BITS)
        new = np.ones(len(keys), bool)
        new[1:] = names[1:] != names[:-1]
        self.vocabulary = names[new]
        symbols = np.ones(n, np.uint64)  # 0: end of all, 1: end of a piece, words from 2
        symbols[-1:] = 0
        symbols[at[(keys & _MASK).astype(np.int64)]] = (np.cumsum(new) + 1).astype(np.uint64)
        order = suffix_order(symbols)
        symbols = symbols.astype(np.int64)
        self.size = n
        self.word_at = np.cumsum(is_word) - 1  # text place -> place among the words
        self.counts = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=len(self.vocabulary) + 2))])
        self.wavelet = Wavelet(symbols[order - 1], len(self.vocabulary) + 1)
        everything = np.arange(len(self.vocabulary) + 2)
        self.origin = self.wavelet.place(everything, np.zeros(len(everything), np.int64))
        sampled = order % sample == 0
        self.sampled = BitRank(sampled)
        self.samples = order[sampled]

    def names(self, hashes: np.ndarray) -> np.ndarray:
        """Symbols of words, 0 for words this shard does not have."""
        if not len(self.vocabulary):
            return np.zeros(hashes.shape, np.int64)
        wanted = hashes >> _U(BITS)
        at = np.minimum(np.searchsorted(self.vocabulary, wanted), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == wanted, at + 2, 0)

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search: (phrases found, first row, last row exclusive).

        ``phrases`` holds word hashes, aligned to the right; only the last ``lengths`` count.
        """
        width = phrases.shape[1]
        symbols = self.names(phrases)
        within = np.arange(width)[None, :] >= width - lengths[:, None]
        alive = np.flatnonzero(((symbols > 0) | ~within).all(axis=1) & (lengths > 0))
        low, high = np.zeros(len(alive), np.int64), np.full(len(alive), self.size, np.int64)
        for back in range(1, width + 1):
            now = np.flatnonzero(lengths[alive] >= back)
            if not len(now):
                break
            symbol = symbols[alive[now], width - back]
            shift = self.counts[symbol] - self.origin[symbol]
            low[now] = shift + self.wavelet.place(symbol, low[now])
            high[now] = shift + self.wavelet.place(symbol, high[now])
            keep = high > low
            alive, low, high = alive[keep], low[keep], high[keep]
        return alive, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text places of suffix rows: go back word by word to the next sampled row."""
        found = np.zeros(len(rows), np.int64)
        left, steps = np.arange(len(rows)), 0
        rows = rows.copy()
        while len(left):
            hit = self.sampled.get(rows)
            found[left[hit]] = self.samples[self.sampled.rank(rows[hit])] + steps
            left, rows = left[~hit], rows[~hit]
            symbol, place = self.wavelet.access(rows)
            rows = self.counts[symbol] + place - self.origin[symbol]
            steps += 1
        return found
