"""Quality scores from random-indexing word vectors and a small network.

Every word has a sparse random *index vector* given by its hash. A word's
*context vector* is the sum of the index vectors of the words near it, over all
documents. Words share a row by their hash, so the table has ``ROWS`` rows
however large the corpus is (a few MB, broadcast). A word is entered twice: as
written, and as its shape (letters and digits reduced to classes), so unseen
words still have a vector. A text is the mean of its words' normalised vectors
beside a few ratios; a two-layer network scores it, and a temperature fitted on
a part of the labelled rows that the network did not see calibrates the scores.

The network is fitted on at most ``FIT_ROWS`` labelled rows, chosen by a hash of
the id; counts and vectors cover all texts, and all texts are scored whole.

Defined results: an empty, blank or null text has the zero vector and gets the
score of that vector; repeated rows get equal scores; a null id is scored and
not used for fitting; without usable labels of both kinds every score is 0.5.
Of repeated or conflicting labels the highest counts, a null label none. Only
id and text are read, further columns stay with the caller.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from marquee.llm.words import BASE, INVERSE, SPACE, Words, chunks, mix, powers

ROWS = 1 << 14
DIM = 32
NEAR = 2  # words on either side that make the context
ENTRIES = 2  # of an index vector, each plus or minus one
FIT_ROWS = 20_000
HIDDEN = 32
SEED = 11
THRESHOLD = 0.3
CLASSES = np.arange(256, dtype=np.uint8)
CLASSES[ord("a"): ord("z") + 1] = ord("a")
CLASSES[ord("A"): ord("Z") + 1] = ord("A")
CLASSES[ord("0"): ord("9") + 1] = ord("0")
CLASSES[128:] = ord("a")  # bytes of letters outside ASCII, as a rule
RATIOS = 8


def shapes(words: Words) -> np.ndarray:
    """A hash of each word's classes, runs of one class counted once."""
    raw = CLASSES[np.frombuffer(words.buffer, dtype=np.uint8)]
    keep = np.ones(len(raw), dtype=bool)
    keep[1:] = raw[1:] != raw[:-1]
    keep[words.start] = True
    place = np.cumsum(keep)
    value = np.where(keep, mix(raw.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(raw) + 1)[place], np.uint64(0))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value)))
    return mix((sums[words.stop] - sums[words.start]) * powers(INVERSE, len(raw) + 1)[place[words.start]])


def rows_of(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(20)).astype(np.int64) % ROWS


def index_vectors() -> np.ndarray:
    """The sparse index vector of every row, dense (``ROWS`` x ``DIM``)."""
    out = np.zeros((ROWS, DIM), dtype=np.float32)
    for k in range(ENTRIES):
        h = mix(np.arange(ROWS, dtype=np.uint64) * np.uint64(ENTRIES) + np.uint64(k + 977))
        np.add.at(out, (np.arange(ROWS), (h >> np.uint64(8)).astype(np.int64) % DIM), np.where(h & np.uint64(1), 1, -1))
    return out


def context_sums(docs: DataFrame) -> np.ndarray:
    """The context vectors of all rows, summed over every text (``ROWS`` x ``DIM``).

    A task adds up its own texts and sends each row it touched; the sums over
    tasks are formed by row and come back as one table of fixed size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(ROWS * DIM)
        slots = [(mix(np.arange(ROWS, dtype=np.uint64) * np.uint64(ENTRIES) + np.uint64(k + 977))) for k in range(ENTRIES)]
        slots = [((h >> np.uint64(8)).astype(np.int64) % DIM, np.where(h & np.uint64(1), 1.0, -1.0)) for h in slots]
        for batch in batches:
            for _, texts in chunks(batch):
                words = Words(texts)
                own, shape = rows_of(words.hash), rows_of(shapes(words))
                for away in range(1, NEAR + 1):
                    if len(own) <= away:
                        break
                    same = words.doc[away:] == words.doc[:-away]
                    for left, right in ((own[:-away], own[away:]), (shape[:-away], shape[away:])):
                        left, right = left[same], right[same]
                        for place, sign in slots:
                            for a, b in ((left, right), (right, left)):
                                sums += np.bincount(a * DIM + place[b], weights=sign[b], minlength=ROWS * DIM)
        table = sums.reshape(ROWS, DIM).astype(np.float32)
        used = np.flatnonzero(table.any(axis=1))
        if len(used):
            yield pa.RecordBatch.from_arrays(
                [pa.array(used, pa.int32()), pa.array(list(table[used]), pa.list_(pa.float32()))], names=["r", "v"])

    added = docs.select("text").mapInArrow(run, "r int, v array<float>").groupBy("r").agg(
        *[F.sum(F.get("v", F.lit(k))).alias(f"s{k}") for k in range(DIM)])
    table = np.zeros((ROWS, DIM), dtype=np.float32)
    found = added.toPandas()  # at most ROWS rows
    if len(found):
        table[found["r"].to_numpy()] = found[[f"s{k}" for k in range(DIM)]].to_numpy(dtype=np.float32)
    return table


def vectors(table: np.ndarray) -> np.ndarray:
    """Unit context vectors beside the index vectors, for each row."""
    norm = np.linalg.norm(table, axis=1, keepdims=True)
    return np.hstack((table / np.maximum(norm, 1e-6), index_vectors())).astype(np.float32)


def pooled(words: Words, table: np.ndarray) -> np.ndarray:
    """One feature row per text: means over words and over shapes, and some ratios."""
    n, count = len(words.count), np.maximum(words.count, 1)[:, None]
    own, shape = rows_of(words.hash), rows_of(shapes(words))
    width = table.shape[1]
    out = np.zeros((n, 2 * width + RATIOS), dtype=np.float32)
    for k, rows in enumerate((own, shape)):
        # Counting a text's rows first makes the mean a small product.
        pair, times = np.unique(words.doc * ROWS + rows, return_counts=True)
        doc, row = pair // ROWS, pair % ROWS
        cut = np.searchsorted(doc, np.arange(n))
        if len(pair):
            weighted = table[row] * times[:, None].astype(np.float32)
            sums = np.add.reduceat(weighted, np.minimum(cut, len(pair) - 1), axis=0)
            sums[np.diff(np.append(cut, len(pair))) == 0] = 0
            out[:, k * width: (k + 1) * width] = sums / count
    raw = np.frombuffer(words.buffer, dtype=np.uint8)
    letters = np.concatenate(([0], np.cumsum(CLASSES[raw] == ord("a"))))
    upper = np.concatenate(([0], np.cumsum(CLASSES[raw] == ord("A"))))
    blank = np.concatenate(([0], np.cumsum(SPACE[raw])))
    some = np.flatnonzero(words.count)
    if len(some):
        a, b = words.start[words.first[some]], words.stop[words.first[some + 1] - 1]
        length = (b - a).astype(np.float64)
        repeat = np.zeros(len(own))
        repeat[1:] = (own[1:] == own[:-1]) & (words.doc[1:] == words.doc[:-1])
        seen = np.unique(words.doc * ROWS + own) // ROWS
        doubles = np.add.reduceat(repeat, words.first[some])
        ratios = np.stack([
            (letters[b] - letters[a]) / length, (upper[b] - upper[a]) / length, (blank[b] - blank[a]) / length,
            np.log1p(words.count[some]) / 8, np.bincount(seen, minlength=n)[some] / words.count[some],
            doubles / words.count[some], length / words.count[some] / 10, np.ones(len(some))], axis=1)
        out[some, 2 * width:] = ratios
    return out


class Network:
    """Two layers of weights over standardised features; ``temperature`` divides the logit."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 60, batch: int = 128):
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        self.weights = [rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN),
                        rng.normal(0, HIDDEN ** -0.5, (HIDDEN, 1)), np.zeros(1)]
        self.temperature = 1.0
        hold = rng.random(len(y)) < 0.2
        if len(set(y[hold])) < 2 or len(set(y[~hold])) < 2:
            hold[:] = False
        self._fit(x[~hold], y[~hold], rng, rounds, batch)
        if hold.any():
            z, t = self.logits(x[hold]), y[hold] * 0.98 + 0.01  # certainty beyond the few rows held back is not rewarded
            options = np.exp(np.linspace(-1.5, 2.5, 81))
            self.temperature = float(options[np.argmin([np.mean(np.logaddexp(0, z / o) - t * z / o) for o in options])])

    def _fit(self, x, y, rng, rounds, batch):
        x = (x - self.mean) / self.scale
        m, v, step = [np.zeros_like(w) for w in self.weights], [np.zeros_like(w) for w in self.weights], 0
        for _ in range(rounds):
            order = rng.permutation(len(y))
            for at in range(0, len(y), batch):
                rows = order[at: at + batch]
                a, t = x[rows], y[rows][:, None]
                w1, b1, w2, b2 = self.weights
                h = np.tanh(a @ w1 + b1)
                g = (1 / (1 + np.exp(-np.clip(h @ w2 + b2, -30, 30))) - t) / len(rows)
                gh = (g @ w2.T) * (1 - h * h)
                grads = [a.T @ gh + 1e-4 * w1, gh.sum(axis=0), h.T @ g + 1e-4 * w2, g.sum(axis=0)]
                step += 1
                for i, d in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * d
                    v[i] = 0.999 * v[i] + 0.001 * d * d
                    self.weights[i] = self.weights[i] - 0.004 * (m[i] / (1 - 0.9 ** step)) / (np.sqrt(v[i] / (1 - 0.999 ** step)) + 1e-8)

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return (np.tanh((x - self.mean) / self.scale @ w1 + b1) @ w2 + b2)[:, 0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether ``crc32(doc_id as text) mod parts`` is ``part``; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, label: str, parts: int, part: int, most: int) -> DataFrame:
    """doc_id, text, y of at most about ``most`` labelled rows outside the held-out part, chosen by a hash of the id."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    known = known.filter(~held_out(F.col("doc_id"), parts, part))
    n = known.count()
    if n > most:
        known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 30)) < int(most / n * (1 << 30)))
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # about ``most`` ids at most


def fit(docs: DataFrame, labels: DataFrame, table: np.ndarray, most: int = FIT_ROWS) -> Network | None:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, texts in chunks(batch, "doc_id", "y"):
                x = pooled(Words(texts), table)
                yield pa.RecordBatch.from_arrays([
                    pa.array([i for i, _ in own], pa.int64()), pa.array([y for _, y in own], pa.int32()),
                    pa.array(list(x), pa.list_(pa.float32()))], names=["doc_id", "y", "x"])

    rows = labelled(docs, labels, "quality", 5, 0, most).mapInArrow(run, "doc_id bigint, y int, x array<float>").toPandas()
    rows = rows.sort_values("doc_id", kind="stable")
    if rows["y"].nunique() < 2:
        return None
    return Network(np.stack(rows["x"].to_numpy()).astype(np.float64), rows["y"].to_numpy(dtype=np.float64))


def scored(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> DataFrame:
    """All columns of ``docs`` and ``quality_score``; a column of that name is replaced."""
    table = vectors(context_sums(docs))
    network = fit(docs, labels, table, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [
                np.full(len(texts), 0.5) if network is None else network.score(pooled(Words(texts), table).astype(np.float64))
                for _, texts in chunks(batch)]
            yield batch.append_column("quality_score", pa.array(np.concatenate(scores) if scores else [], pa.float64()))

    rest = docs.drop("quality_score")
    return rest.mapInArrow(run, T.StructType([*rest.schema.fields, T.StructField("quality_score", T.DoubleType())]))
