"""An FM-index over sequences of integer codes, queried for many patterns at once.

The sequences are joined with separators and their suffixes sorted by their
first ``depth`` codes or more (prefix doubling), which is all that patterns up
to that length can tell apart. The Burrows-Wheeler transform is held in a
wavelet tree laid out level by level: one packed bit vector per bit of the
code, with a running count for every 64 bits. Backward search takes one step
for all patterns together.
"""

from __future__ import annotations

import numpy as np


class BitVector:
    """Packed bits with rank in constant time; one and a half bits for each bit stored."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(np.concatenate((bits, np.zeros(-len(bits) % 64 + 64, dtype=bool))), bitorder="little")
        self.words = packed.view("<u8").astype(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words)))).astype(np.int32)
        self.zeros = int(len(bits) - bits.sum())

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many bits before ``at`` are set."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask).astype(np.int32)


class WaveletTree:
    def __init__(self, codes: np.ndarray, bits: int):
        self.levels = []
        for level in range(bits - 1, -1, -1):
            ones = (codes >> level & 1).astype(bool)
            self.levels.append((level, BitVector(ones)))
            codes = np.concatenate((codes[~ones], codes[ones]))

    def locate(self, code: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where position ``at`` of the sequence falls in the last level, on the path of ``code``."""
        for level, bits in self.levels:
            ones = bits.rank(at)
            at = np.where(code >> level & 1, bits.zeros + ones, at - ones)
        return at


class FMIndex:
    def __init__(self, codes: np.ndarray, lengths: np.ndarray, depth: int):
        """``codes`` (from 0) holds the sequences one after another, ``lengths`` theirs."""
        starts = np.cumsum(lengths) - lengths
        owner = np.repeat(np.arange(len(lengths)), lengths)
        # Behind each sequence comes the separator 0; codes move up by one.
        text = np.zeros(len(codes) + len(lengths), dtype=np.int64)
        text[np.arange(len(codes)) + owner] = codes + 1
        self.starts = starts + np.arange(len(lengths))
        self.text = text
        n = len(text)
        rank, reach = text, 1
        while True:
            ahead = np.zeros(n, dtype=np.int64)
            if reach < n:
                ahead[: n - reach] = rank[reach:] + 1
            key = rank * (n + 2) + ahead
            self.suffixes = np.argsort(key, kind="stable")
            ordered = key[self.suffixes]
            rank = np.empty(n, dtype=np.int64)
            rank[self.suffixes] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
            reach *= 2
            if reach >= depth or rank.max() == n - 1:
                break
        transform = text[self.suffixes - 1]
        sigma = int(text.max()) + 1
        self.tree = WaveletTree(transform, max(1, int(sigma - 1).bit_length()))
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma))))
        every = np.arange(sigma)
        self.origin = self.tree.locate(every, np.zeros(sigma, dtype=np.int64))

    def rank(self, code: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.tree.locate(code, at) - self.origin[code]

    def search(self, begins: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals [low, high) of the patterns of ``length`` codes that begin at the given text positions."""
        low = np.zeros(len(begins), dtype=np.int64)
        high = np.full(len(begins), len(self.text), dtype=np.int64)
        for back in range(length - 1, -1, -1):
            code = self.text[begins + back]
            low = self.first[code] + self.rank(code, low)
            high = self.first[code] + self.rank(code, high)
        return low, high


def interval_minima(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least of ``values[low:high]`` for each interval (none empty); one level of doubling is held at a time."""
    out = np.empty(len(low), dtype=values.dtype)
    span = high - low
    level = np.floor(np.log2(np.maximum(span, 1))).astype(int)
    table, size = values, 1
    for k in range(int(level.max()) + 1 if len(level) else 0):
        own = np.flatnonzero(level == k)
        out[own] = np.minimum(table[low[own]], table[high[own] - size])
        if len(table) > size:
            table = np.minimum(table[:-size], table[size:])
        size *= 2
    return out
