"""Removal of word sequences that an earlier document already has.

A window is ``WINDOW`` consecutive words of one document. A word is removed if
a window over it also starts in a document with a smaller id. The work:

1. Every window has an anchor, the least hash among its runs of ``ANCHOR``
   words. Neighbouring windows with one anchor form a fragment. Equal windows
   have equal anchors, so an anchor that occurs in one document only settles
   all its windows. Anchors (8 bytes for about six words) are shuffled, packed.
2. Fragments with a shared anchor go, as text, to the shard of their anchor.
   Anchors with more than ``HOT_SHARE`` of all fragments (at most
   1 / ``HOT_SHARE``, so their list is broadcast) would crowd one shard: their
   windows go one by one to the shard of the window's own hash.
3. Each shard builds an FM-index over its distinct fragments. Backward search
   gives every window its suffix interval; the least document id in it decides.
4. The intervals found are taken out of the texts.

Tasks combine before shuffling: of equal fragments in one block only those of
the smallest document travel on, the others are known to be repeats. So a
passage in a third of all documents is sent once per task.

Defined results: a null or blank text has no words, and keeps the empty text.
A null id counts as larger than all others and is never the smaller one. Rows
with the same id are one document for the comparison, each with its own result;
fully repeated rows give repeated results. An empty table gives no rows. Only
id and text are read, other columns stay with the caller.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from marquee.llm.fm_index import FMIndex, interval_minima
from marquee.llm.words import Words, chunks, mix
from marquee.session import cut_lineage

WINDOW = 13
ANCHOR = 5
HOT_SHARE = 1e-4
SHARD_BYTES = 8 << 20  # of all texts, for each shard
NO_ID = (1 << 63) - 1
DONE, HOT = -1, -2  # kinds of rows that pass a shard by

ANCHORS = "shard int, kind int, doc array<bigint>, anchor array<bigint>, start array<int>, docs array<int>"
FRAGMENTS = "shard int, kind int, row array<bigint>, doc array<bigint>, route array<bigint>, start array<int>, windows array<int>, text array<binary>"
SPANS = "row array<bigint>, start array<int>, windows array<int>"


def fragments(words: Words, window: int, anchor: int):
    """(text index, first word, windows, anchor) of each fragment, words counted inside their text."""
    at = words.windows(window)
    if not len(at):
        return [np.zeros(0, dtype=np.int64)] * 3 + [np.zeros(0, dtype=np.uint64)]
    low, width, need = words.rolled(anchor), 1, window - anchor + 1
    while width * 2 <= need:  # minima over runs of ``width`` values
        low = np.minimum(low, np.concatenate((low[width:], low[-1:].repeat(width))))
        width *= 2
    least = np.minimum(low[at], low[at + need - width])
    doc = words.doc[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (least[1:] != least[:-1])
    first = np.flatnonzero(new)
    return doc[first], at[first] - words.first[doc[first]], np.diff(np.append(first, len(at))), least[first]


def _ints(values) -> np.ndarray:
    return np.array([NO_ID if v is None else v for v in values], dtype=np.int64)


def _lists(arrays: list[np.ndarray], kind) -> pa.Array:
    ends = np.cumsum([0] + [len(a) for a in arrays])
    flat = np.concatenate(arrays) if arrays else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, kind))


def _first_of_runs(*keys: np.ndarray) -> np.ndarray:
    new = np.ones(len(keys[0]), dtype=bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def _shard_of(route: np.ndarray, shards: int) -> np.ndarray:
    return ((route.view(np.uint64) >> np.uint64(17)) % np.uint64(shards)).astype(np.int64)


def _by_shard(shard: np.ndarray, shards: int) -> list[np.ndarray]:
    order = np.argsort(shard, kind="stable")
    cut = np.searchsorted(shard[order], np.arange(shards + 1))
    return [order[a:b] for a, b in zip(cut, cut[1:])]


def anchor_rows(docs: DataFrame, shards: int, window: int, anchor: int) -> DataFrame:
    """The anchors of all texts, packed by shard; those repeated inside a block are settled there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = np.zeros(0, dtype=np.int64)  # anchors shared by documents of this task that a shard knows of
        for batch in batches:
            for ids, texts in chunks(batch, "doc_id"):
                own, start, _, value = fragments(Words(texts), window, anchor)
                doc, value = _ints(ids)[own], value.view(np.int64)
                order = np.lexsort((start, doc, value))
                doc, start, value = doc[order], start[order], value[order]
                new = _first_of_runs(value)
                run_id = np.cumsum(new) - 1
                pair = _first_of_runs(value, doc)
                n_docs = np.bincount(run_id, weights=pair).astype(np.int32) if len(value) else np.zeros(0, np.int32)
                first_doc = doc[new]
                shared = n_docs[run_id] > 1
                known = np.isin(value, sent)
                # To the shard: every fragment of an unshared anchor, one of a shared one.
                send = np.flatnonzero(~known & (~shared | new))
                done = np.flatnonzero(shared | known)
                sent = np.union1d(sent, value[shared])
                rows = [(s, 0, x) for s, at in enumerate(_by_shard(_shard_of(value[send], shards), shards)) if len(x := send[at])]
                if len(done):
                    rows.append((int(first_doc[0]) % shards if len(first_doc) else 0, DONE, done))
                if rows:
                    took = [x for _, _, x in rows]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
                        _lists([doc[x] for x in took], pa.int64()),
                        _lists([value[x] if k != DONE else value[:0] for (_, k, _), x in zip(rows, took)], pa.int64()),
                        _lists([start[x] for x in took], pa.int32()),
                        _lists([n_docs[run_id[x]] if k != DONE else n_docs[:0] for (_, k, _), x in zip(rows, took)], pa.int32()),
                    ], names=["shard", "kind", "doc", "anchor", "start", "docs"])

    return docs.select("doc_id", "text").mapInArrow(run, ANCHORS)


def _flat(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch[name].flatten().to_numpy(zero_copy_only=False)


def shared_anchors(rows: DataFrame, shards: int, hot_from: int) -> DataFrame:
    """kind, shard, docs, starts: the fragments whose anchor another document has, packed by a hash of the
    document; hot anchors as rows of kind HOT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []

        def out(kind: int, doc: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
            rows = [(s, x) for s, x in enumerate(_by_shard(_shard_of(mix(doc.view(np.uint64)), shards), shards)) if len(x)]
            return pa.RecordBatch.from_arrays([
                pa.array([kind] * len(rows), pa.int32()), pa.array([s for s, _ in rows], pa.int32()),
                _lists([doc[x] for _, x in rows], pa.int64()), _lists([start[x] for _, x in rows], pa.int32())],
                names=["kind", "shard", "doc", "start"])

        for batch in batches:
            kinds = batch["kind"].to_numpy()
            done = batch.filter(pa.array(kinds == DONE))
            if len(done):
                yield out(DONE, _flat(done, "doc"), _flat(done, "start"))
            todo = batch.filter(pa.array(kinds != DONE))
            if len(todo):
                held.append([_flat(todo, c) for c in ("anchor", "doc", "start", "docs")])
        if not held:
            return
        value, doc, start, docs_in_block = (np.concatenate(x) for x in zip(*held))
        held.clear()
        order = np.lexsort((doc, value))
        value, doc, start, docs_in_block = value[order], doc[order], start[order], docs_in_block[order]
        new = _first_of_runs(value)
        run_id = np.cumsum(new) - 1
        apart = np.bincount(run_id, weights=_first_of_runs(value, doc))[run_id] > 1
        # A fragment that stands for several documents is settled where it comes from.
        answer = apart & (docs_in_block == 1)
        if answer.any():
            yield out(DONE, doc[answer], start[answer])
        total = np.bincount(run_id, weights=docs_in_block)
        hot = value[new][total > hot_from]
        if len(hot):
            yield out(HOT, hot, np.zeros(len(hot), dtype=np.int64))

    return rows.repartition(shards, "shard").mapInArrow(run, "kind int, shard int, doc array<bigint>, start array<int>")


def starts_by_document(packed: DataFrame, shards: int) -> DataFrame:
    """doc, starts: one row for each document with shared fragments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(_flat(x, "doc"), _flat(x, "start")) for x in batches]
        if held:
            doc, start = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((start, doc))
            doc, start = doc[order], start[order]
            cut = np.flatnonzero(_first_of_runs(doc)) if len(doc) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.array(doc[cut], pa.int64()),
                pa.ListArray.from_arrays(pa.array(np.append(cut, len(doc)), pa.int32()), pa.array(start, pa.int32()))], names=["doc", "starts"])

    return packed.select("shard", "doc", "start").repartition(shards, "shard").mapInArrow(run, "doc bigint, starts array<int>")


def fragment_rows(flagged: DataFrame, hot: list[int], shards: int, window: int, anchor: int) -> DataFrame:
    """The flagged fragments with their text, packed by shard; repeats inside a block are settled there."""
    hot_values = np.array(sorted(hot), dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, raw in chunks(batch, "doc_id", "row", "starts"):
                words = Words(raw)
                which, start, n, value = fragments(words, window, anchor)
                value = value.view(np.int64)
                wanted = np.concatenate([np.asarray(x[2], dtype=np.int64) + (i << 40) for i, x in enumerate(own)])
                keep = np.isin(start + (which << 40), wanted)
                which, start, n, value = which[keep], start[keep], n[keep], value[keep]
                if not len(which):
                    continue
                crowded = np.isin(value, hot_values)
                if crowded.any():  # one fragment for each window, on its way by its own hash
                    single = np.repeat(np.flatnonzero(crowded), n[crowded])
                    offset = np.arange(len(single)) - np.repeat(np.cumsum(n[crowded]) - n[crowded], n[crowded])
                    s_which, s_start = which[single], start[single] + offset
                    s_route = words.rolled(window)[words.first[s_which] + s_start].view(np.int64)
                    rest = ~crowded
                    which, start, n, value = (np.concatenate(p) for p in (
                        (which[rest], s_which), (start[rest], s_start), (n[rest], np.ones(len(single), dtype=n.dtype)), (value[rest], s_route)))
                doc, row = _ints([x[0] for x in own])[which], np.array([x[1] for x in own], dtype=np.int64)[which]
                a = words.first[which] + start
                begin, end = words.start[a], words.stop[a + n + window - 2]
                pieces = [words.buffer[b:e] for b, e in zip(begin.tolist(), end.tolist())]
                least: dict[bytes, int] = {}
                for p, d in zip(pieces, doc.tolist()):
                    if least.get(p, NO_ID) >= d:
                        least[p] = d
                minimum = np.array([least[p] for p in pieces], dtype=np.int64)
                repeat = doc > minimum
                send, done = np.flatnonzero(~repeat), np.flatnonzero(repeat)
                rows = [(s, 0, x) for s, i in enumerate(_by_shard(_shard_of(value[send], shards), shards)) if len(x := send[i])]
                if len(done):
                    rows.append((int(abs(row[done[0]])) % shards, DONE, done))
                took = [x for _, _, x in rows]
                yield pa.RecordBatch.from_arrays([
                    pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
                    _lists([row[x] for x in took], pa.int64()), _lists([doc[x] for x in took], pa.int64()),
                    _lists([value[x] for x in took], pa.int64()), _lists([start[x] for x in took], pa.int32()),
                    _lists([n[x] for x in took], pa.int32()),
                    pa.array([[pieces[i] for i in x] if k != DONE else [] for (_, k, _), x in zip(rows, took)], pa.list_(pa.binary())),
                ], names=["shard", "kind", "row", "doc", "route", "start", "windows", "text"])

    return flagged.select("doc_id", "row", "text", "starts").mapInArrow(run, FRAGMENTS)


def repeated_windows(pieces: list[bytes], doc: np.ndarray, n: np.ndarray, route: np.ndarray, window: int):
    """(fragment, offset) of every window that a fragment of a smaller document also has."""
    code: dict[bytes, int] = {}
    content = np.array([code.setdefault(b" ".join(p.split()), len(code)) for p in pieces], dtype=np.int64)
    pieces.clear()  # the distinct ones stay
    distinct = list(code)
    least = np.full(len(distinct), NO_ID, dtype=np.int64)
    np.minimum.at(least, content, doc)
    repeat = np.flatnonzero(doc > least[content])
    found = [(np.repeat(repeat, n[repeat]), _offsets(n[repeat]))]
    # A content whose anchor has no other content is done; the others are indexed and searched.
    where = np.zeros(len(distinct), dtype=np.int64)
    where[content] = route
    size = np.zeros(len(distinct), dtype=np.int64)
    size[content] = n
    order = np.argsort(where, kind="stable")
    new = _first_of_runs(where[order]) if len(order) else np.zeros(0, dtype=bool)
    run_id = np.cumsum(new) - 1
    crowd = np.flatnonzero(np.bincount(run_id)[run_id] > 1) if len(order) else order
    chosen = np.sort(order[crowd])
    if len(chosen):
        hashes, counts = word_hashes([distinct[i] for i in chosen])
        _, codes = np.unique(hashes, return_inverse=True)
        del hashes
        index = FMIndex(codes, counts, window)
        owner = np.repeat(np.arange(len(chosen)), counts + 1)  # of every text position
        ids = least[chosen]
        begins = np.repeat(index.starts, size[chosen]) + _offsets(size[chosen])
        low, high = index.search(begins, window)
        earliest = interval_minima(ids[owner][index.suffixes], low, high)
        pattern_owner = np.repeat(np.arange(len(chosen)), size[chosen])
        hit = earliest < ids[pattern_owner]
        # Back to the fragments that hold this content for the first time.
        offset = _offsets(size[chosen])[hit]
        back = np.full(len(distinct), -1, dtype=np.int64)
        back[chosen] = np.arange(len(chosen))
        asks = np.flatnonzero((doc == least[content]) & (back[content] >= 0))
        cut = np.searchsorted(pattern_owner[hit], np.arange(len(chosen) + 1))
        mine = back[content[asks]]
        many = cut[mine + 1] - cut[mine]
        at = np.repeat(cut[mine], many) + _offsets(many)
        found.append((np.repeat(asks, many), offset[at]))
    return (np.concatenate(x) for x in zip(*found))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words and the words of each text; worked off in parts, for ``Words`` takes many times its text."""
    hashes, counts = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
    for at in range(0, len(texts), 4096):
        words = Words(texts[at: at + 4096])
        hashes.append(words.hash)
        counts.append(words.count)
    return np.concatenate(hashes), np.concatenate(counts)


def _offsets(sizes: np.ndarray) -> np.ndarray:
    """0 .. size - 1 for each size, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def search_shards(rows: DataFrame, shards: int, window: int) -> DataFrame:
    """row, start, windows: runs of repeated windows, from one FM-index per shard.

    A shard packs its runs into one row: a row for each of its texts would make
    as many rows as texts times shards.
    """

    def spans(row: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((start, row))
        row, start = row[order], start[order]
        new = np.ones(len(row), dtype=bool)
        new[1:] = (row[1:] != row[:-1]) | (start[1:] > start[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(row)) - 1
        return pa.RecordBatch.from_arrays([
            _lists([row[first]], pa.int64()), _lists([start[first]], pa.int32()), _lists([start[last] - start[first] + 1], pa.int32())],
            names=["row", "start", "windows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, pieces = [], []
        for batch in batches:
            kinds = batch["kind"].to_numpy()
            done = batch.filter(pa.array(kinds == DONE))
            if len(done):
                n = _flat(done, "windows").astype(np.int64)
                yield spans(np.repeat(_flat(done, "row"), n), np.repeat(_flat(done, "start").astype(np.int64), n) + _offsets(n))
            todo = batch.filter(pa.array(kinds != DONE))
            if len(todo):
                held.append([_flat(todo, c) for c in ("row", "doc", "route", "start", "windows")])
                pieces += todo["text"].flatten().to_pylist()
        if held:
            row, doc, route, start, n = (np.concatenate(x).astype(np.int64) for x in zip(*held))
            which, offset = repeated_windows(pieces, doc, n, route, window)
            if len(which):
                yield spans(row[which], start[which] + offset)

    packed = rows.repartition(shards, "shard").mapInArrow(run, SPANS)
    return packed.select(F.explode(F.arrays_zip("row", "start", "windows")).alias("s")).select("s.row", "s.start", "s.windows")


def cut_texts(flagged: DataFrame, spans: DataFrame, window: int) -> DataFrame:
    """row, n_removed and kept (words joined by one space) of the rows that lose words."""
    found = spans.groupBy("row").agg(
        F.collect_list("start").alias("start"), F.collect_list("windows").alias("windows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, kept = [], []
            for text, start, n in zip(*(batch[c] for c in ("text", "start", "windows"))):
                words = (text.as_py() or "").encode().split()
                start, n = np.array(start.as_py()), np.array(n.as_py())
                step = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(step, start, 1)
                np.add.at(step, start + n + window - 1, -1)
                stay = np.cumsum(step)[:-1] == 0
                removed.append(len(words) - int(stay.sum()))
                kept.append(b" ".join([w for w, s in zip(words, stay.tolist()) if s]).decode())
            yield pa.RecordBatch.from_arrays(
                [batch["row"], pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["row", "n_removed", "kept"])

    rows = flagged.join(found, "row").select("row", "text", "start", "windows")
    return rows.mapInArrow(run, "row bigint, n_removed bigint, kept string")


def row_key() -> Column:
    return F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(NO_ID)), F.coalesce("text", F.lit("")))


def repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """row, n_removed, kept: one row for every (id, text) that loses words; ``row`` is ``row_key()``."""
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = base.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    # About six words and as many letters each make a fragment.
    hot_from = max(64, int(size / 36 * HOT_SHARE))
    shared = cut_lineage(shared_anchors(anchor_rows(base, shards, window, anchor), shards, hot_from))
    hot = [r[0] for r in shared.filter(F.col("kind") == HOT).select(F.explode("doc")).collect()]
    starts = starts_by_document(shared.filter(F.col("kind") == DONE), shards)
    keyed = base.select("doc_id", "text", F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"))
    flagged = cut_lineage(keyed.join(starts, "doc").select("doc_id", "text", "starts", row_key().alias("row")))
    spans = search_shards(fragment_rows(flagged, hot, shards, window, anchor), shards, window)
    return cut_texts(flagged.select("row", "text").dropDuplicates(["row"]), spans, window)
