"""Toxicity scores by weak supervision.

*Voters.* A voter looks for one thing in a text: a word of a lexicon, a word
beginning of a lexicon, or a pattern. Lexicons are mined from labelled rows
outside the held-out part: entries that toxic rows have far more often than
their share, and a group of general pattern voters (shouting, repeated marks,
very short or repetitive texts) that say little by themselves. A voter that
finds nothing abstains; that no lexicon voter fires at all is evidence by itself.

*Label model.* The votes of all documents are counted together: how often each
voter and each pair of voters fires. From these counts and the fit rows' labels
a generative model is estimated: a prior for toxic texts, the rate at which each
voter fires in toxic and in other texts (its accuracies; refined by expectation
maximisation over the distinct vote patterns of all documents), and the
correlations of voters that fire together more often than their rates explain.
A voter's weight in the posterior is divided by the correlations it is part of,
so five voters that see the same thing count as one.

*Classifier.* A logistic regression on the words and word beginnings that go with
a high posterior learns the posterior labels of the fit rows and scores every
whole text.

Defined results: null, empty and blank texts have no features and get the score
of the intercept; repeated rows get equal scores; a null id is scored and not
used for fitting; without labelled rows of both kinds only patterns vote. Of
conflicting labels the highest counts, a null label none. Only id and text are
read, further columns stay with the caller.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from marquee.llm.quality import labelled
from marquee.llm.words import BASE, INVERSE, LOWER, SPACE, Words, chunks, mix, powers
from marquee.session import cut_lineage

FIT_ROWS = 40_000  # labelled rows that voters and classifier are fitted on
LEXICON = 600  # voters mined at most
LEAST_ROWS = 4  # toxic rows an entry must occur in
STEMS = (4, 5, 6, 7)  # bytes of a word beginning
OFTEN = (2, 4)  # a term found so often is a further term
FEATURES = 5_000  # terms of the classifier at most
SAME = 0.6  # correlation from which two voters count as seeing the same thing
LABEL_ACCURACY = 0.99  # of the given labels, as a voter
LEAST_STRENGTH = 4.0  # of a term, in standard deviations
SEED = 23
THRESHOLD = 0.3
PATTERNS = ("shouting", "marks", "repetition", "brief")
LETTER = np.zeros(256, dtype=bool)
LETTER[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(128, 256)]] = True


class Terms:
    """The distinct words and word beginnings of each text as hashes: ``doc`` and ``term``, by text.

    Words are lower-cased and taken without marks around them; beginnings are
    counted in bytes of UTF-8, whole words carry a tag of their own.
    """

    def __init__(self, texts: list[bytes]):
        plain = Words(texts)
        self.plain = plain
        raw = np.frombuffer(plain.buffer, dtype=np.uint8)
        letter = LETTER[raw]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], letter, [False])).astype(np.int8)))
        start, stop = edge[0::2], edge[1::2]
        ends = np.cumsum([len(t) + 1 for t in texts])
        doc = np.searchsorted(ends, start, "right")
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(LOWER[raw] * powers(BASE, len(raw)))))
        down = powers(INVERSE, len(raw))
        parts = [(doc, mix(((sums[stop] - sums[start]) * down[start]) ^ np.uint64(1)))]
        for n in STEMS:
            long = stop - start > n
            a = start[long]
            parts.append((doc[long], mix(((sums[a + n] - sums[a]) * down[a]) ^ np.uint64(n))))
        doc, term = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((term, doc))
        doc, term = doc[order], term[order]
        keep = np.ones(len(doc), dtype=bool)
        keep[1:] = (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])
        first = np.flatnonzero(keep)
        times = np.diff(np.append(first, len(doc)))
        doc, term = doc[first], term[first]
        more = [(doc[times >= k], mix(term[times >= k] + np.uint64(k))) for k in OFTEN]
        doc, term = (np.concatenate(x) for x in zip((doc, term), *more))
        order = np.argsort(doc, kind="stable")
        self.doc, self.term, self.n = doc[order], term[order], len(texts)

    def patterns(self) -> np.ndarray:
        """n x len(PATTERNS) booleans, from the words as written."""
        w = self.plain
        raw = np.frombuffer(w.buffer, dtype=np.uint8)
        out = np.zeros((self.n, len(PATTERNS)), dtype=bool)
        some = np.flatnonzero(w.count)
        if len(some):
            a, b = w.start[w.first[some]], w.stop[w.first[some + 1] - 1]
            part = lambda mask: (lambda s: s[b] - s[a])(np.concatenate(([0], np.cumsum(mask))))
            letters = np.maximum(part(LETTER[raw]), 1)
            upper = part((raw >= ord("A")) & (raw <= ord("Z")))
            marks = part(~LETTER[raw] & ~SPACE[raw])
            same = np.zeros(len(w.hash))
            same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
            out[some] = np.stack((
                upper > 0.5 * letters, marks > 0.2 * letters,
                np.add.reduceat(same, w.first[some]) > 0.2 * w.count[some], w.count[some] < 8), axis=1)
        return out


def _pieces(batches: Iterator[pa.RecordBatch], *columns: str):
    for batch in batches:
        yield from chunks(batch, *columns)


def mine_lexicon(fit_rows: DataFrame) -> np.ndarray:
    """The terms that mark toxic rows: counted over all fit rows, the most telling kept (a fixed number)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, raw in _pieces(batches, "y"):
            terms = Terms(raw)
            y = np.array(own, dtype=np.int64)
            names, code = np.unique(terms.term, return_inverse=True)
            toxic = np.bincount(code, weights=y[terms.doc], minlength=len(names)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.array(names.view(np.int64)), pa.array(np.bincount(code, minlength=len(names)).astype(np.int64)), pa.array(toxic)],
                names=["term", "n", "toxic"])

    n, toxic = fit_rows.agg(F.count("*"), F.sum("y")).first()
    if not toxic or toxic == n:
        return np.zeros(0, dtype=np.int64)
    base = toxic / n
    counts = fit_rows.mapInArrow(run, "term bigint, n bigint, toxic bigint").groupBy("term").agg(
        F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    share = F.col("toxic") / F.col("n")
    telling = counts.filter((F.col("toxic") >= LEAST_ROWS) & (share >= min(0.9, 0.5 + base / 2))).withColumn(
        "strength", (F.col("toxic") - F.col("n") * base) / F.sqrt(F.col("n") * base * (1 - base) + 1)).filter(
        F.col("strength") > LEAST_STRENGTH)
    rows = telling.orderBy(F.desc("strength"), "term").limit(LEXICON).select("term").toPandas()
    return np.sort(rows["term"].to_numpy(dtype=np.int64))


def votes(terms: Terms, lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, voter) of every vote; lexicon voters first, patterns behind them."""
    own, entry = found_in(terms, lexicon)
    doc, voter = np.nonzero(terms.patterns())
    return np.concatenate((own, doc)), np.concatenate((entry, voter + len(lexicon)))


def vote_counts(docs: DataFrame, lexicon: np.ndarray) -> tuple[int, np.ndarray]:
    """Over all documents: their number and how often each pair of voters fires together (the diagonal: each voter)."""
    m = len(lexicon) + len(PATTERNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n = np.zeros((m, m), dtype=np.int64), 0
        for own, raw in _pieces(batches):
            doc, voter = votes(Terms(raw), lexicon)
            n += len(raw)
            fired = np.zeros((len(raw), m), dtype=np.float32)
            fired[doc, voter] = 1
            used = np.flatnonzero(fired.any(axis=1))
            pairs += (fired[used].T @ fired[used]).astype(np.int64)
        i, j = np.nonzero(pairs)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.append(i, -1), pa.int32()), pa.array(np.append(j, -1), pa.int32()), pa.array(np.append(pairs[i, j], n))],
            names=["i", "j", "n"])

    found = docs.select("text").mapInArrow(run, "i int, j int, n bigint").groupBy("i", "j").agg(F.sum("n").alias("n")).toPandas()
    total = int(found.loc[found["i"] < 0, "n"].sum())
    found = found[found["i"] >= 0]
    pairs = np.zeros((m, m))
    pairs[found["i"].to_numpy(), found["j"].to_numpy()] = found["n"].to_numpy()  # m * m numbers
    return total, pairs


class LabelModel:
    """Prior, firing rates by label and correlations of the voters."""

    def __init__(self, total: int, pairs: np.ndarray, fired: np.ndarray, y: np.ndarray):
        self.prior = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.1
        overall = np.diag(pairs) / max(total, 1)
        toxic, clean = fired[y == 1], fired[y == 0]
        smooth = 0.5
        self.rate = np.stack((
            (clean.sum(axis=0) + smooth * overall) / (len(clean) + smooth), (toxic.sum(axis=0) + smooth * overall) / (len(toxic) + smooth)))
        self._damp(total, pairs, overall)
        # Expectation maximisation against the rates that all documents show.
        for _ in range(10):
            implied = (1 - self.prior) * self.rate[0] + self.prior * self.rate[1]
            self.rate *= np.clip((overall + 1e-9) / (implied + 1e-9), 0.5, 2.0) ** 0.5
            self.rate = np.clip(self.rate, 1e-6, 1 - 1e-6)
            if len(y):
                p = self.posterior(fired) * 0.2 + y * 0.8
                self.prior = float(np.clip(p.mean(), 0.01, 0.99))
                own = np.stack((((1 - p)[:, None] * fired).sum(axis=0) + smooth * overall, (p[:, None] * fired).sum(axis=0) + smooth * overall))
                self.rate = np.clip(own / np.array([[(1 - p).sum() + smooth], [p.sum() + smooth]]), 1e-6, 1 - 1e-6)
        self._damp(total, pairs, overall)

    def _damp(self, total: int, pairs: np.ndarray, overall: np.ndarray) -> None:
        """Correlation of each pair beyond what the shared label explains; a voter's weight is one over its sum."""
        joint = pairs / max(total, 1)
        explained = (1 - self.prior) * np.outer(self.rate[0], self.rate[0]) + self.prior * np.outer(self.rate[1], self.rate[1])
        spread = np.sqrt(np.outer(overall * (1 - overall), overall * (1 - overall))) + 1e-12
        self.correlation = np.clip((joint - explained) / spread, 0, 1)
        np.fill_diagonal(self.correlation, 0)
        # Weaker ones come of languages and topics, within which voters still see different things.
        self.correlation[self.correlation < SAME] = 0
        self.weight = 1 / (1 + self.correlation.sum(axis=1))

    def posterior(self, fired: np.ndarray, y: np.ndarray | None = None) -> np.ndarray:
        """The probability that each text is toxic, given its votes and, on fit rows, the given label as one more vote."""
        lexical = np.ones(fired.shape[1], dtype=bool)
        lexical[-len(PATTERNS):] = False
        ratio = np.log(self.rate[1] / self.rate[0]) * self.weight
        # Absence is taken together: that no lexicon voter fires at all is one piece of evidence.
        silent = np.log((1 - self.rate[1][lexical]) / (1 - self.rate[0][lexical])).sum() if lexical.any() else 0.0
        none = ~fired[:, lexical].any(axis=1)
        z = np.log(self.prior / (1 - self.prior)) + fired @ ratio + np.where(none, silent, 0.0)
        if y is not None:
            z += np.where(y == 1, 1, -1) * np.log(LABEL_ACCURACY / (1 - LABEL_ACCURACY))
        return _sigmoid(z)


def telling_terms(fit_rows: DataFrame, lexicon: np.ndarray, model: LabelModel) -> np.ndarray:
    """The classifier's vocabulary: terms that go with a high posterior, counted over all fit rows."""
    base = model.prior

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, raw in _pieces(batches, "y"):
            terms = Terms(raw)
            y = np.array(own)
            p = model.posterior(_fired(len(raw), *votes(terms, lexicon), model.rate.shape[1]), y)
            names, code = np.unique(terms.term, return_inverse=True)
            yield pa.RecordBatch.from_arrays([
                pa.array(names.view(np.int64)), pa.array(np.bincount(code, minlength=len(names)).astype(np.int64)),
                pa.array(np.bincount(code, weights=p[terms.doc], minlength=len(names)).astype(np.float64))], names=["term", "n", "p"])

    counts = fit_rows.mapInArrow(run, "term bigint, n bigint, p double").groupBy("term").agg(F.sum("n").alias("n"), F.sum("p").alias("p"))
    strength = (F.col("p") - F.col("n") * base) / F.sqrt(F.col("n") * base * (1 - base) + 1)
    rows = counts.withColumn("strength", strength).filter(f"strength > {LEAST_STRENGTH} and p > 0.5 * n").orderBy(
        F.desc("strength"), "term").limit(FEATURES).select("term").toPandas()
    return np.sort(rows["term"].to_numpy(dtype=np.int64))


def found_in(terms: Terms, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, index in ``known``) of the terms that are in it, by text."""
    if not len(known):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    value = terms.term.view(np.int64)
    at = np.minimum(np.searchsorted(known, value), len(known) - 1)
    hit = np.flatnonzero(known[at] == value)
    return terms.doc[hit], at[hit]


def _fired(n: int, doc: np.ndarray, voter: np.ndarray, m: int) -> np.ndarray:
    out = np.zeros((n, m), dtype=bool)
    out[doc, voter] = True
    return out


def _lists(n: int, doc: np.ndarray, value: np.ndarray) -> pa.Array:
    order = np.argsort(doc, kind="stable")
    ends = np.searchsorted(doc[order], np.arange(n + 1))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(value[order], pa.int32()))


def collected(fit_rows: DataFrame, per_text) -> tuple[np.ndarray, np.ndarray, list]:
    """doc_id, y and a short list of numbers of each fit row, in order of id; at most about ``most`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, raw in _pieces(batches, "doc_id", "y"):
            yield pa.RecordBatch.from_arrays([
                pa.array([x[0] for x in own], pa.int64()), pa.array([x[1] for x in own], pa.int32()),
                _lists(len(raw), *per_text(Terms(raw)))], names=["doc_id", "y", "found"])

    rows = fit_rows.mapInArrow(run, "doc_id bigint, y int, found array<int>").toPandas().sort_values("doc_id", kind="stable")
    return rows["doc_id"].to_numpy(), rows["y"].to_numpy(dtype=np.int64), [np.asarray(x, dtype=np.int64) for x in rows["found"]]


class Linear:
    """Logistic regression on the presence of terms, with soft labels and adaptive steps."""

    def __init__(self, rows: list[np.ndarray], p: np.ndarray, size: int, rounds: int = 30, batch: int = 64):
        rng = np.random.default_rng(SEED)
        self.weights, scale = np.zeros(size), np.full(size, 0.1)
        self.bias, grown = -2.0, 1.0
        for _ in range(rounds):
            order = rng.permutation(len(rows))
            for at in range(0, len(rows), batch):
                own = order[at: at + batch]
                term = np.concatenate([rows[i] for i in own])
                which = np.repeat(np.arange(len(own)), [len(rows[i]) for i in own])
                g = _sigmoid(np.bincount(which, weights=self.weights[term], minlength=len(own)) + self.bias) - p[own]
                np.add.at(scale, term, g[which] ** 2)
                np.add.at(self.weights, term, -0.5 * g[which] / np.sqrt(scale[term]))
                grown += float((g * g).sum())
                self.bias -= 0.5 * float(g.sum()) / grown ** 0.5

    def score(self, n: int, doc: np.ndarray, term: np.ndarray) -> np.ndarray:
        return _sigmoid(np.bincount(doc, weights=self.weights[term], minlength=n) + self.bias)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def scored(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> DataFrame:
    """All columns of ``docs`` and ``toxicity_score``; a column of that name is replaced."""
    fit_rows = cut_lineage(labelled(docs, labels, "toxic", 4, 2, most))
    lexicon = mine_lexicon(fit_rows)
    total, pairs = vote_counts(docs, lexicon)
    m = len(lexicon) + len(PATTERNS)
    _, y, voters = collected(fit_rows, lambda terms: votes(terms, lexicon))
    fired = _fired(len(y), np.repeat(np.arange(len(y)), [len(v) for v in voters]), np.concatenate([*voters, np.zeros(0, dtype=np.int64)]), m)
    model = LabelModel(total, pairs, fired, y)
    known = telling_terms(fit_rows, lexicon, model)
    # Same rows in the same order: sorted by id, which is unique among labelled ids unless rows repeat.
    _, _, rows = collected(fit_rows, lambda terms: found_in(terms, known))
    linear = Linear(rows, model.posterior(fired, y), len(known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [linear.score(len(raw), *found_in(Terms(raw), known))
                      for _, raw in chunks(batch)]
            yield batch.append_column("toxicity_score", pa.array(np.concatenate(scores) if scores else [], pa.float64()))

    rest = docs.drop("toxicity_score")
    return rest.mapInArrow(run, T.StructType([*rest.schema.fields, T.StructField("toxicity_score", T.DoubleType())]))
