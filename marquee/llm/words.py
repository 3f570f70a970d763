"""Words, hashes and shingles of a batch of texts, in numpy.

A word is a maximal run of bytes other than space, tab, line feed, vertical
tab, form feed and carriage return (``[^\\x20\\x09-\\x0D]+``). A word's hash is a
sum of table values of its bytes times powers of an odd number, modulo 2**64,
so that all words of a batch come from one running sum over its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

M64 = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
LOWER = BYTE.copy()
LOWER[ord("A"): ord("Z") + 1] = BYTE[ord("a"): ord("z") + 1]
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base**2, ... (n values)."""
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Words:
    """The words of several texts: ``hash``, ``start`` and ``stop`` (in ``buffer``) and ``doc`` of each,
    and for each text the bounds of its words, ``first[i]`` to ``first[i + 1]``."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        self.buffer = b" ".join(texts) + b" "
        raw = np.frombuffer(self.buffer, dtype=np.uint8)
        blank = SPACE[raw]
        edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        if not blank[0]:
            edge = np.concatenate(([0], edge))
        self.start, self.stop = edge[0::2], edge[1::2]
        up = powers(BASE, len(raw))
        sums = np.empty(len(raw) + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum((LOWER if lower else BYTE)[raw] * up, out=sums[1:])
        down = powers(INVERSE, len(raw))
        self.hash = mix((sums[self.stop] - sums[self.start]) * down[self.start])
        ends = np.cumsum([len(t) + 1 for t in texts])
        self.first = np.concatenate(([0], np.searchsorted(self.start, ends)))
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.count)

    def windows(self, n: int) -> np.ndarray:
        """The index of every word that starts a window of ``n`` words inside its text."""
        at = np.arange(len(self.hash))
        return at[at + n <= self.first[1:][self.doc]] if len(at) else at

    def rolled(self, n: int) -> np.ndarray:
        """The hash of the ``n`` words from each word on; only values at ``windows(n)`` count."""
        h = self.hash
        out = np.zeros(len(h), dtype=np.uint64)
        for k in range(min(n, len(h))):
            out[: len(h) - k] += h[k:] * np.uint64(pow(BASE, k + 1, 1 << 64))
        return mix(out)


def shingle_sets(words: Words, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of the distinct shingles of ``n`` words, sorted by text and hash.

    A text of fewer than ``n`` words has all its words as its one shingle; one without words has none.
    """
    at = words.windows(n)
    doc, value = words.doc[at], words.rolled(n)[at]
    short = np.flatnonzero((words.count > 0) & (words.count < n))
    if len(short):
        whole = []
        for i in short:
            x = words.hash[words.first[i]: words.first[i + 1]]
            whole.append((x * powers(BASE, n + 1)[1: len(x) + 1]).sum(dtype=np.uint64) + np.uint64(len(x)))
        doc, value = np.concatenate((doc, short)), np.concatenate((value, mix(np.array(whole, dtype=np.uint64))))
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    keep = np.ones(len(doc), dtype=bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return doc[keep], value[keep]


def chunks(batch, *columns: str, size: int = 1 << 19) -> Iterator[tuple[list, list[bytes]]]:
    """Parts of an Arrow batch of at most ``size`` bytes of ``text`` or one text; a null text is empty.

    With each part come the values of one column, or tuples of several. Rows are
    turned into Python values a few hundred at a time.
    """
    part, own, total = [], [], 0
    for at in range(0, len(batch), 256):
        some = batch.slice(at, 256)
        values = [some[c].to_pylist() for c in columns]
        ids = values[0] if len(values) == 1 else list(zip(*values)) if values else [None] * len(some)
        for i, t in zip(ids, some["text"]):
            raw = (t.as_py() or "").encode()
            if part and total + len(raw) > size:
                yield own, part
                part, own, total = [], [], 0
            part.append(raw)
            own.append(i)
            total += len(raw) + 1
    if part:
        yield own, part
