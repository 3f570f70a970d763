"""Benchmark passages in documents, edits allowed, by the q-gram lemma.

Texts and items are compared after folding: lower case, and every run of white
space one space. A region of a document matches an item when its edit distance
to the whole item is at most ``rate`` of the item's length, ``k``. The q-gram
lemma: such a region keeps at least ``n - k * q`` of any ``n`` q-grams of the
item, and the places of the kept ones differ from their places in the item by
diagonals that lie within ``2 k + 1`` of each other. So for each item ``n`` of
its q-grams are chosen, those that other items share least, the document's
q-grams are looked up among them, and hits are counted per item in overlapping
bands of diagonals. Bands that reach the bound are verified by a banded
alignment; the diagonals are wide enough that no match is lost.

Items are taken in blocks of ``BLOCK_CHARS``; each block is a broadcast of that
size, whatever the size of the benchmark. Items too short for one surviving
q-gram (``q - 1 + k q`` characters) are matched exactly, without edits.

Defined results: null, empty and blank texts or items match nothing; equal items
each match; repeated documents each match; a null id is carried. Overlapping
regions of one item are reported once, by the smallest distance and then the
first end. Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from marquee.llm.words import BASE, mix

Q = 8
RATE = 0.1  # edits for each character of an item
CHOSEN = 24  # q-grams of an item beyond the k * q that edits may break
BLOCK_CHARS = 4_000_000
PIECE = 1 << 20  # characters of a text searched at once

MATCHES = "doc_id bigint, item_id bigint, distance int, begin bigint, stop bigint"


def fold(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def grams(c: np.ndarray, q: int = Q) -> np.ndarray:
    """The hash of the q-gram from each place on."""
    n = len(c) - q + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    wide, out = c.astype(np.uint64), np.zeros(n, dtype=np.uint64)
    for j in range(q):
        out = out * np.uint64(BASE) + wide[j: j + n] + np.uint64(1)
    return mix(out)


class Block:
    """The chosen q-grams of some items: sorted hashes with item and place, and a bit map before the search."""

    BITS = 24

    def __init__(self, items: list[tuple[int | None, str]], rate: float):
        self.ids = [i for i, _ in items]
        self.text = [codes(t) for _, t in items]
        self.k = np.array([int(len(c) * rate) for c in self.text], dtype=np.int64)
        all_grams = [grams(c) for c in self.text]
        names, times = np.unique(np.concatenate([*all_grams, np.zeros(0, np.uint64)]), return_counts=True)
        h, item, place, need = [], [], [], []
        for i, g in enumerate(all_grams):
            if len(g) < self.k[i] * Q + 1:
                self.k[i] = 0  # too short for a gram to be sure to survive: no edits
            n = min(len(g), int(self.k[i]) * Q + CHOSEN)
            # Rare ones first; among equally rare ones spread over the item by their hash.
            rank = np.lexsort((mix(g), times[np.searchsorted(names, g)]))[:n]
            h.append(g[rank])
            item.append(np.full(n, i))
            place.append(rank)
            need.append(max(1, n - int(self.k[i]) * Q) if n else 0)
        self.need = np.array(need, dtype=np.int64)
        h = np.concatenate([*h, np.zeros(0, np.uint64)])
        item, place = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (item, place))
        order = np.argsort(h, kind="stable")
        self.h, self.item, self.place = h[order], item[order], place[order]
        self.map = np.zeros(1 << self.BITS, dtype=bool)
        self.map[(self.h & np.uint64((1 << self.BITS) - 1)).astype(np.int64)] = True
        self.short = [(i, t) for i, (_, t) in enumerate(items) if t and len(codes(t)) < Q]

    def candidates(self, c: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, first diagonal, last diagonal) of the bands with enough hits, neighbours merged."""
        g = grams(c)
        at = np.flatnonzero(self.map[(g & np.uint64((1 << self.BITS) - 1)).astype(np.int64)])
        if not len(at):
            return []
        low, high = np.searchsorted(self.h, g[at], "left"), np.searchsorted(self.h, g[at], "right")
        many = high - low
        at, low, many = at[many > 0], low[many > 0], many[many > 0]
        if not len(at):
            return []
        entry = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        item, diagonal = self.item[entry], np.repeat(at, many) - self.place[entry]
        order = np.lexsort((diagonal, item))
        item, diagonal = item[order], diagonal[order]
        # Bands overlap: one begins at every hit and reaches 2 k diagonals on.
        width = 2 * self.k[item]
        far = np.int64(1) << 40
        key = item * far + diagonal + (far >> 1)
        count = np.searchsorted(key, key + width, "right") - np.arange(len(key))
        out: list[list[int]] = []
        for j in np.flatnonzero(count >= self.need[item]).tolist():
            i, a = int(item[j]), int(diagonal[j])
            b = int(diagonal[j + count[j] - 1])
            if out and out[-1][0] == i and a <= out[-1][2] + 1:
                out[-1][2] = max(out[-1][2], b)
            else:
                out.append([i, a, b])
        return [tuple(x) for x in out]

    def verify(self, c: np.ndarray, item: int, first: int, last: int) -> tuple[int, int, int] | None:
        """(distance, begin, stop) of the best region for the item on diagonals ``first - k`` to ``last + k``.

        The alignment may begin and end anywhere in the text; cells outside the
        band count as too far. Work: item length times band width, in bands of
        limited width for texts that repeat an item over and over.
        """
        p, k = self.text[item], int(self.k[item])
        best = None
        step = max(4 * k + 64, 1024)
        for lo in range(first - k, last + k + 1, step):
            hi = min(lo + step + 2 * k, last + k)
            found = _banded(p, c, lo, hi, k)
            if found is not None and (best is None or found < best):
                best = found
        return best


def _banded(p: np.ndarray, c: np.ndarray, lo: int, hi: int, k: int) -> tuple[int, int, int] | None:
    """Semi-global alignment of all of ``p`` within ``c`` on diagonals lo..hi; None when the distance exceeds ``k``."""
    width = hi - lo + 1
    big = 1 << 20
    shift = np.arange(width)
    # Column d of row i stands for text place i + lo + d. Row 0: begin anywhere.
    place = lo + shift
    inside = (place >= 0) & (place <= len(c))
    cost = np.where(inside, 0, big).astype(np.int64)
    begin = place.astype(np.int64)
    padded = np.zeros(len(p) + width + 2, dtype=np.uint32)
    a = lo
    source = np.arange(a, a + len(padded))
    ok = (source >= 0) & (source < len(c))
    padded[ok] = c[source[ok]]
    padded[~ok] = 0xFFFFFFFF
    for i in range(1, len(p) + 1):
        window = padded[i - 1: i - 1 + width]  # text character consumed by a step on the diagonal
        match = cost + (window != p[i - 1])
        up = np.append(cost[1:], big) + 1  # a character of the item without one of the text
        take = up < match
        new, origin = np.where(take, up, match), np.where(take, np.append(begin[1:], 0), begin)
        place = i + lo + shift
        new = np.where((place >= 0) & (place <= len(c)), new, big)
        # A character of the text without one of the item: running minimum from the left.
        lead = np.minimum.accumulate(new - shift)
        src = np.maximum.accumulate(np.where(new - shift == lead, shift, 0))
        cost, begin = lead + shift, origin[src]
        if cost.min() > k:
            return None
    j = int(np.argmin(cost))
    return (int(cost[j]), int(begin[j]), int(len(p) + lo + j)) if cost[j] <= k else None


def matches(docs: DataFrame, items: DataFrame, rate: float = RATE, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, item_id, distance, begin, stop (places in the folded text) of every match."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = None
    for block in blocks(items, rate):
        one = _matches(rows, block)
        found = one if found is None else found.unionByName(one)
    return found if found is not None else docs.sparkSession.createDataFrame([], MATCHES)


def blocks(items: DataFrame, rate: float) -> Iterator[Block]:
    """The items in blocks of a fixed size, read one after another, each held by itself."""
    held, size = [], 0
    for r in items.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        text = fold(r["text"])
        if not text:
            continue
        held.append((r["item_id"], text))
        size += len(text)
        if size >= BLOCK_CHARS:
            yield Block(held, rate)
            held, size = [], 0
    if held:
        yield Block(held, rate)


def _matches(rows: DataFrame, block: Block) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(block)  # a few times BLOCK_CHARS
    longest = max(len(c) for c in block.text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = shared.value
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                folded = fold(text.as_py())
                best: dict[tuple[int, int], tuple[int, int, int]] = {}
                # Very long texts in overlapping parts, so that a match lies whole in one of them.
                whole = codes(folded)
                overlap = 2 * longest + 64
                for start in range(0, max(len(whole), 1), PIECE):
                    c = whole[start: start + PIECE + overlap]
                    for item, first, last in b.candidates(c):
                        got = b.verify(c, item, first, last)
                        if got is not None:
                            got = (got[0], got[1] + start, got[2] + start)
                            key = (item, got[2] // max(1, len(b.text[item])))
                            best[key] = min(best.get(key, got), got)
                for item, t in b.short:
                    at = folded.find(t)
                    if at >= 0:
                        best[item, 0] = (0, at, at + len(t))
                out += [(doc_id, b.ids[item], *got) for (item, _), got in sorted(best.items())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[j] for r in out], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()))],
                names=["doc_id", "item_id", "distance", "begin", "stop"])

    return rows.mapInArrow(run, MATCHES)


def contaminated(docs: DataFrame, items: DataFrame, rate: float = RATE) -> DataFrame:
    """(doc_id, item_id, distance): the smallest distance of each pair."""
    return matches(docs, items, rate).groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"), F.min("begin").alias("begin"))


def clean(docs: DataFrame, items: DataFrame, rate: float = RATE) -> DataFrame:
    """The rows of ``docs`` whose text holds no item, all columns kept; decided row by row, so ids need not be unique."""
    kept = docs
    for block in blocks(items, rate):
        kept = _without(kept, block)
    return kept


def _without(docs: DataFrame, block: Block) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(block)
    longest = max(len(c) for c in block.text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [not _any(shared.value, longest, fold(t.as_py())) for t in batch["text"]]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def _any(b: Block, longest: int, folded: str) -> bool:
    whole = codes(folded)
    for start in range(0, max(len(whole), 1), PIECE):
        c = whole[start: start + PIECE + 2 * longest + 64]
        if any(b.verify(c, *x) is not None for x in b.candidates(c)):
            return True
    return any(t in folded for _, t in b.short)
