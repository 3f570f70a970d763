"""Ranked lexical search by dense blocked matrix products.

A term is a run of characters other than ASCII controls, blanks and punctuation,
with A-Z lowered. For ``N`` documents with a term, ``L`` terms in all, ``n`` in a
document, ``df`` documents with the term and ``tf`` occurrences in a document,

    w = floor(1000 ln((2 N + 2) / (2 df + 1)))      m = 25 + (75 n N) div L
    score = sum over the item's terms, repeats included, of w ((10**9 tf) div (1000 tf + 8 m))

Items are read in blocks with a bounded vocabulary. One scan of the documents
counts, for each block of items, only the terms of that vocabulary; the counts
(a small part of the texts) are written, summed to ``df``, ``N`` and ``L``, and
read again to score. A tile of items has a compact vocabulary of its own; in
panels of ``PANEL`` terms its weights are multiplied (BLAS, float64) with the
impacts of a tile of documents. An impact is below 10**6 and weights are cut into
digits below 2**20, so that every partial sum stays below 2**53 and is exact; digits
and panels are added up in 64-bit integers. Each task keeps the best ``k`` of every
item over its tiles: whatever reaches the score at the edge stays in until the
smaller ids are known, so ties are cut by id alone. Tasks send ``k`` rows an item.

Defined results: rows with one item id are one item with all their terms; null
and empty texts have no terms; every row of the documents ranks on its own, also
with an id that others have; a null id comes after all others; items without a
match have no rows. Ids of documents are whole numbers.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from marquee.llm.words import chunks
from marquee.session import cut_lineage

K = 10
BLOCK_TERMS = 1 << 18  # terms of the items taken together
TILE_TERMS = 1 << 13  # terms of the items of a tile
TILE_ITEMS = 256
TILE_DOCS = 1024
PANEL = 2048
DIGIT = 20  # bits: PANEL * 2**DIGIT * 10**6 < 2**53
CHUNK = 1 << 22
# Every byte of a separator becomes a blank, A-Z become a-z.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
DOCS, TERMS = -1, -2  # in place of a term: the number of documents, of terms


def terms(raw: bytes) -> list[bytes]:
    return raw.translate(FOLD).split()


def item_blocks(items: DataFrame) -> Iterator[dict]:
    """item id -> Counter of its terms, for blocks of items of about ``BLOCK_TERMS`` terms or one item."""
    block: dict = {}
    held, last = 0, object()
    for r in items.select("item_id", "text").orderBy("item_id").toLocalIterator():
        found = terms((r["text"] or "").encode())
        if block and r["item_id"] != last and held + len(found) > BLOCK_TERMS:
            yield block
            block, held = {}, 0
        last = r["item_id"]
        block.setdefault(last, Counter()).update(found)
        held += len(found)
    if block:
        yield block


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """A row per chunk of documents: ids, numbers of terms, and how often each has which terms of the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # BLOCK_TERMS entries, or one item's
    longs, ints = T.ArrayType(T.LongType()), T.ArrayType(T.IntegerType())
    schema = T.StructType([
        T.StructField("doc_id", longs), T.StructField("n", longs), T.StructField("held", longs),
        T.StructField("term", ints), T.StructField("tf", ints)])

    def run(batches):
        known = shared.value.get
        for batch in batches:
            for ids, raw in chunks(batch, "doc_id", size=CHUNK):
                n, held, term, tf = [], [0], [], []
                for x in raw:
                    words = terms(x)
                    at = np.fromiter(map(known, words, repeat(-1)), dtype=np.int32, count=len(words))
                    found, times = np.unique(at[at >= 0], return_counts=True)
                    n.append(len(words))
                    held.append(held[-1] + len(found))
                    term.append(found)
                    tf.append(times)
                columns = [pa.array([ids], type=pa.list_(pa.int64())), pa.array([n], type=pa.list_(pa.int64())),
                           pa.array([held], type=pa.list_(pa.int64()))]
                columns += [pa.array([np.concatenate(x).astype(np.int32)], type=pa.list_(pa.int32())) for x in (term, tf)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def _rows(batches) -> Iterator[tuple]:
    """Ids (None where null), and ``n``, ``held``, ``term``, ``tf`` as arrays, of each chunk."""
    for batch in batches:
        for k in range(len(batch)):
            row = [batch.column(c)[k].values for c in ("doc_id", "n", "held", "term", "tf")]
            yield row[0], *(x.to_numpy(zero_copy_only=False).astype(np.int64) for x in row[1:])


def frequencies(counted: DataFrame, size: int) -> dict[int, int]:
    """Documents per term of a vocabulary of ``size`` terms, and the numbers of documents and terms."""

    def run(batches):
        df = np.zeros(size, dtype=np.int64)
        docs = total = 0
        for _, n, _, term, _ in _rows(batches):
            df += np.bincount(term, minlength=size)
            docs += int((n > 0).sum())
            total += int(n.sum())
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array([DOCS, TERMS, *seen.tolist()], type=pa.int64()), pa.array([docs, total, *df[seen].tolist()], type=pa.int64())],
            names=["term", "n"])

    summed = counted.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {r["term"]: r["n"] for r in summed.collect()}  # the size of the vocabulary at most


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


class Tile:
    """Some items, the terms they use, and their weights: panels of (first term, first beyond, digit matrices)."""

    def __init__(self, weights: list[dict[int, int]]):
        self.vocabulary = np.array(sorted({t for w in weights for t in w}), dtype=np.int64)
        where = {t: k for k, t in enumerate(self.vocabulary.tolist())}
        self.items = len(weights)
        self.panels = []
        for low in range(0, len(where), PANEL):
            high = min(low + PANEL, len(where))
            whole = np.zeros((self.items, high - low), dtype=np.int64)
            for i, w in enumerate(weights):
                for t, x in w.items():
                    if low <= where[t] < high:
                        whole[i, where[t] - low] = x
            digits = []
            while not digits or whole.any():
                digits.append((whole & ((1 << DIGIT) - 1)).astype(np.float64))
                whole >>= DIGIT
            self.panels.append((low, high, digits))

    def scores(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, docs: int) -> np.ndarray:
        """Items by documents, from the impacts of (document, term)."""
        out = np.zeros((self.items, docs), dtype=np.int64)
        at = np.searchsorted(self.vocabulary, term)
        mine = at < len(self.vocabulary)
        mine[mine] = self.vocabulary[at[mine]] == term[mine]
        at, doc, impact = at[mine], doc[mine], impact[mine]
        for low, high, digits in self.panels:
            here = (at >= low) & (at < high)
            impacts = np.zeros((high - low, docs))
            impacts[at[here] - low, doc[here]] = impact[here]
            for d, q in enumerate(digits):
                out += (q @ impacts).astype(np.int64) << (DIGIT * d)
        return out


class Best:
    """The best ``k`` (score, id) of each item so far; ``none`` tells whether the id is null."""

    def __init__(self, items: int, k: int):
        self.k, self.edge = k, np.ones(items, dtype=np.int64)
        self.item, self.score, self.id = (np.zeros(0, dtype=np.int64) for _ in range(3))
        self.none = np.zeros(0, dtype=bool)

    def add(self, scores: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        item, doc = np.nonzero(scores >= self.edge[:, None])
        if not len(item):
            return
        item, score = np.concatenate((self.item, item)), np.concatenate((self.score, scores[item, doc]))
        own, null = np.concatenate((self.id, ids[doc])), np.concatenate((self.none, none[doc]))
        order = np.lexsort((own, null, -score, item))
        item = item[order]
        first = np.searchsorted(item, np.arange(len(self.edge)))
        place = np.arange(len(item)) - first[item]
        keep = place < self.k
        self.item, order = item[keep], order[keep]
        self.score, self.id, self.none = score[order], own[order], null[order]
        full = place[keep] == self.k - 1
        self.edge[self.item[full]] = self.score[full]


def impacts(n: np.ndarray, tf: np.ndarray, docs: int, total: int) -> np.ndarray:
    """The impact of ``tf`` occurrences in documents of ``n`` terms."""
    wide = n if 75 * docs * int(n.max(initial=0)) < 1 << 63 else n.astype(object)
    m = 25 + ((75 * docs * wide) // total).astype(np.int64)
    return (10**9 * tf) // (1000 * tf + 8 * m)


def _tiles(block: dict, names: dict[bytes, int], df: dict[int, int]) -> list[tuple[int, Tile]]:
    """The items' tiles, each with the number of its first item."""
    found, part, held, first = [], [], set(), 0
    for k, counted in enumerate(block.values()):
        own = {names[t]: x * weight(df[DOCS], df.get(names[t], 0)) for t, x in counted.items()}
        if part and (len(part) == TILE_ITEMS or len(held | own.keys()) > TILE_TERMS):
            found.append((first, Tile(part)))
            part, held, first = [], set(), k
        part.append(own)
        held |= own.keys()
    return [*found, (first, Tile(part))]


def _block_best(docs: DataFrame, items: DataFrame, block: dict, k: int) -> DataFrame:
    names = {t: i for i, t in enumerate(sorted(set().union(*block.values())))}
    counted = cut_lineage(postings(docs, names))
    df = frequencies(counted, len(names))
    schema = T.StructType([
        T.StructField("item_id", items.schema["item_id"].dataType), T.StructField("doc_id", T.LongType()),
        T.StructField("score", T.LongType())])
    if not df.get(TERMS) or not names:
        return docs.sparkSession.createDataFrame([], schema)
    shared = docs.sparkSession.sparkContext.broadcast((list(block), _tiles(block, names, df)))  # dense tiles of one block
    n_docs, n_terms = df[DOCS], df[TERMS]

    def run(batches):
        item_ids, tiles = shared.value
        best = [Best(tile.items, k) for _, tile in tiles]
        for ids, n, held, term, tf in _rows(batches):
            none = ids.is_null().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
            for low in range(0, len(n), TILE_DOCS):
                high = min(low + TILE_DOCS, len(n))
                part = slice(held[low], held[high])
                doc = np.repeat(np.arange(high - low), np.diff(held[low: high + 1]))
                impact = impacts(n[low:high][doc], tf[part], n_docs, n_terms)
                for own, (_, tile) in zip(best, tiles):
                    own.add(tile.scores(doc, term[part], impact, high - low), ids[low:high], none[low:high])
        for own, (first, _) in zip(best, tiles):
            yield pa.RecordBatch.from_arrays([
                pa.array([item_ids[first + i] for i in own.item], type=kind), pa.array(own.id, mask=own.none), pa.array(own.score)],
                names=schema.names)

    kind = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[schema["item_id"].dataType.simpleString()]
    return counted.mapInArrow(run, schema)


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id``, ``score``: the ``k`` best documents with a score above 0 of each item."""
    found = None
    for block in item_blocks(items):
        best = _block_best(docs, items, block, k)
        found = best if found is None else found.unionByName(best)
    if found is None:
        kind = items.schema["item_id"].dataType.simpleString()
        found = docs.sparkSession.createDataFrame([], f"item_id {kind}, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
