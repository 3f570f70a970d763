"""Exact Jaccard join of shingle sets by vertical partitioning, down to its groups.

Documents link when their sets of distinct 5-word shingles have a Jaccard score
of at least ``NUM / DEN``; the result is the connected groups of the links.

All shingles have one global order: those common in a sample of documents last,
the others by hash. The order is only a matter of speed; any gives the same
result. Linked sets share a shingle among the first ``n - ceil(0.75 n) + 1`` of
each, so only these prefixes are shuffled. The order is cut into fragments in
two ways: each *shard* holds the prefix entries of its own shingles and finds
who meets there; and each set has its counts in ``CELLS`` ranges of hashes,
whose minima, summed over the ranges, bound the overlap of a pair from above.
Pairs that stay are verified exactly: overlaps are counted fragment by fragment
and summed per pair.

No pairs of a group are listed:

* equal sets are one class, and a block of texts sends each class once;
* where several classes meet at a shingle, each first meets one hub only, inside
  its block and then, with the hubs of other blocks, in the shard;
* only classes that are still in different groups and meet at a shingle are then
  compared in their shard by the bound, without leaving it unless they pass.

Defined results: texts without words (or null) have the empty set and are linked
with nothing; with fewer than five words all words are the one shingle. Repeated
rows are equal sets. A null id never names a group unless all ids in it are
null. An empty table gives no rows. Only id and text are read. Set hashes have
64 bits; that two of N different sets share one has a chance of N * N / 2**65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from marquee.llm.substring import NO_ID, _by_shard, _first_of_runs, _flat, _lists, _offsets, _shard_of
from marquee.llm.words import Words, chunks, mix, shingle_sets
from marquee.operators.resolve import connected_components
from marquee.session import cut_lineage

SHINGLE = 5
NUM, DEN = 75, 100
CELLS = 512
COARSE = 128  # cells of the first look at a pair
FRAGMENTS = 8
SAMPLE_RATE = 4  # one document in so many tells which shingles are common
SAMPLE_MOST = 1_000_000  # documents in that sample at most, so the list of common shingles is bounded
MAP_BITS = 1 << 25  # of the set of common shingles (4 MB), a hash may share its bit
SHARD_BYTES = 32 << 20
BROADCAST_IDS = 4_000_000  # 32 MB of ids; beyond that the join is a shuffled one
PAIRS, MEMBERS = 1, 2


def prefix_length(n: np.ndarray) -> np.ndarray:
    return np.where(n > 0, n - (NUM * n + DEN - 1) // DEN + 1, 0)


def class_of(doc: np.ndarray, value: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A hash of each text's set; independent of the order of its shingles."""
    sums = np.zeros(len(count), dtype=np.uint64)
    np.add.at(sums, doc, mix(value ^ np.uint64(0x5851F42D4C957F2D)))
    return mix(sums + count.astype(np.uint64)).view(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for ids, raw in chunks(batch, "doc_id"):
            doc, value = shingle_sets(Words(raw, lower=True), SHINGLE)
            count = np.bincount(doc, minlength=len(raw))
            yield ids, doc, value, count, class_of(doc, value, count)


def document_sets(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, class, and the counts of the set in hash ranges (one byte each, 255 for more): ``cells``
    in ``CELLS`` ranges, ``coarse`` in ``COARSE`` ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, doc, value, count, cls in _blocks(batches):
            fine = np.bincount(doc * CELLS + (value >> np.uint64(55)).astype(np.int64), minlength=len(ids) * CELLS)
            rows = [np.minimum(x, 255).astype(np.uint8).reshape(len(ids), -1) for x in (
                fine, fine.reshape(-1, CELLS // COARSE).sum(axis=1))]
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array(count, pa.int64()), pa.array(cls, pa.int64()),
                *[pa.array([c.tobytes() for c in x], pa.binary()) for x in rows]],
                names=["doc_id", "n_shingles", "class", "cells", "coarse"])

    return docs.mapInArrow(run, "doc_id bigint, n_shingles bigint, class bigint, cells binary, coarse binary")


def common_shingles(docs: DataFrame, rate: int, shards: int) -> np.ndarray:
    """A bit map of the shingles that at least two sampled documents have."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, value, _, _ in _blocks(batches):
            value = value.view(np.int64)
            rows = [(s, x) for s, at in enumerate(_by_shard(_shard_of(value, shards), shards)) if len(x := value[at])]
            yield pa.RecordBatch.from_arrays(
                [pa.array([s for s, _ in rows], pa.int32()), _lists([x for _, x in rows], pa.int64())], names=["shard", "value"])

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [_flat(b, "value") for b in batches]
        if held:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            places = np.unique(values[counts > 1].view(np.uint64) % np.uint64(MAP_BITS)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(places + 1, pa.int64())], names=["place"])  # from 1 on

    sample = docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(rate)) == 0)
    places = sample.mapInArrow(spread, "shard int, value array<bigint>").repartition(shards, "shard").mapInArrow(bits, "place bigint")
    rows = places.groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")).collect()  # at most MAP_BITS bits
    common = np.zeros(MAP_BITS // 8, dtype=np.uint8)
    for r in rows:
        at = (r["bucket"] - 1) * len(r["bits"])
        piece = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)[: max(0, len(common) - at)]
        common[at: at + len(piece)] |= piece
    return common


def _is_common(common: np.ndarray, value: np.ndarray) -> np.ndarray:
    bit = (value % np.uint64(MAP_BITS)).astype(np.int64)
    return (common[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)


def _meet(token: np.ndarray, cls: np.ndarray, n: np.ndarray, rare: np.ndarray):
    """Entries of shingles with several classes, in order, and the hub of each.

    The hub is the class with the fewest rare shingles, of equals the least by a
    hash: among edited copies of a text those near the original are linked most.
    """
    order = np.lexsort((mix(cls.view(np.uint64)), rare, token))
    token, cls, n, rare = token[order], cls[order], n[order], rare[order]
    distinct = _first_of_runs(token, cls) if len(token) else np.zeros(0, dtype=bool)
    token, cls, n, rare = token[distinct], cls[distinct], n[distinct], rare[distinct]
    new = _first_of_runs(token) if len(token) else distinct
    run_id = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    many = np.bincount(run_id)[run_id] > 1 if len(token) else new
    return token, cls, n, rare, first[run_id] if len(token) else run_id, many


def _near_sizes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum(a, b) * DEN >= np.maximum(a, b) * NUM


def _distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low, high = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((high, low))
    low, high = low[order], high[order]
    keep = _first_of_runs(low, high) if len(low) else np.zeros(0, dtype=bool)
    return low[keep], high[keep]


ENTRIES = "shard int, kind int, token array<bigint>, class array<bigint>, n array<int>, rare array<int>"


def prefix_entries(docs: DataFrame, common: np.ndarray, shards: int) -> DataFrame:
    """The prefixes of all classes, packed by shard (kind 0), with the pairs and members settled inside a block."""
    shared_map = docs.sparkSession.sparkContext.broadcast(common)  # MAP_BITS / 8 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, doc, value, count, cls in _blocks(batches):
            if not len(value):
                continue
            first = np.zeros(len(ids), dtype=bool)
            first[np.unique(cls, return_index=True)[1]] = True  # of equal sets one
            keep = first[doc]
            doc, value = doc[keep], value[keep]
            late = _is_common(shared_map.value, value)
            rare = np.bincount(doc[~late], minlength=len(ids)).astype(np.int32)
            order = np.lexsort((value, late, doc))
            doc, value = doc[order], value[order]
            size = np.bincount(doc, minlength=len(ids))
            place = _offsets(size)
            keep = place < prefix_length(count)[doc]
            token, own = value[keep].view(np.int64), doc[keep]
            token, c, n, few, hub, many = _meet(token, cls[own], count[own].astype(np.int32), rare[own])
            at_hub = np.zeros(len(token), dtype=bool)
            at_hub[hub] = True
            rest = np.flatnonzero(many)
            ok = rest[(hub[rest] != rest) & _near_sizes(n[rest], n[hub[rest]])]
            a, b = _distinct_pairs(c[ok], c[hub[ok]])
            send = np.flatnonzero(at_hub)
            rows = [(s, 0, token[x], c[x], n[x], few[x]) for s, i in enumerate(_by_shard(_shard_of(token[send], shards), shards)) if len(x := send[i])]
            spread = int(abs(int(cls[0]))) % shards
            if len(a):
                rows.append((spread, PAIRS, a, b, n[:0], n[:0]))
            if len(rest):
                rows.append((spread, MEMBERS, token[rest], c[rest], n[rest], n[:0]))
            yield _packed(rows)

    return docs.mapInArrow(run, ENTRIES)


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
        _lists([r[2] for r in rows], pa.int64()), _lists([r[3] for r in rows], pa.int64()),
        _lists([r[4] for r in rows], pa.int32()), _lists([r[5] for r in rows], pa.int32())],
        names=["shard", "kind", "token", "class", "n", "rare"])


def meetings(entries: DataFrame, shards: int) -> DataFrame:
    """Per shard the pairs of classes and hubs, and all members of shingles that several classes have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            settled = batch.filter(pa.array(batch["kind"].to_numpy() != 0))
            if len(settled):
                yield settled
            todo = batch.filter(pa.array(batch["kind"].to_numpy() == 0))
            if len(todo):
                held.append([_flat(todo, c) for c in ("token", "class", "n", "rare")])
        if not held:
            return
        token, c, n, rare = (np.concatenate(x) for x in zip(*held))
        held.clear()
        token, c, n, _, hub, many = _meet(token, c, n, rare)
        at = np.flatnonzero(many)
        pairs = at[(hub[at] != at) & _near_sizes(n[at], n[hub[at]])]
        a, b = _distinct_pairs(c[pairs], c[hub[pairs]])
        yield _packed([(0, PAIRS, a, b, n[:0], n[:0]), (0, MEMBERS, token[at], c[at], n[at], n[:0])])

    return entries.repartition(shards, "shard").mapInArrow(run, ENTRIES)


def bounded(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs whose overlap may suffice, by the coarse counts first and the fine ones then."""

    def passed(pairs: DataFrame, cells: str, width: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, y = (np.frombuffer(b"".join(batch[c].to_pylist()), dtype=np.uint8).reshape(-1, width) for c in ("x", "y"))
                keep = _may_link(x, y, batch["n"].to_numpy(), batch["m"].to_numpy())
                yield batch.select(["a", "b"]).filter(pa.array(keep))

        one = classes.select(F.col("class").alias("a"), "n", F.col(cells).alias("x"))
        two = classes.select(F.col("class").alias("b"), F.col("n").alias("m"), F.col(cells).alias("y"))
        return pairs.join(one, "a").join(two, "b").mapInArrow(run, "a bigint, b bigint")

    return passed(passed(pairs, "coarse", COARSE), "cells", CELLS)


def _may_link(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    least = np.minimum(x, y)
    most = least.sum(axis=1, dtype=np.int64)
    open_end = (least == 255).any(axis=1)
    return open_end | (most * (NUM + DEN) >= (n + m) * NUM)


def residual_pairs(members: DataFrame, shards: int) -> DataFrame:
    """Distinct pairs of classes of different groups that meet at a shingle and pass the bound.

    A pair may be found in many shards. Shards pack their pairs by a hash of the
    pair, and are made distinct while packed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[b[c].to_numpy(zero_copy_only=False) for c in ("token", "class", "n", "root")] + [
            np.frombuffer(b"".join(b["cells"].to_pylist()), dtype=np.uint8).reshape(-1, CELLS)] for b in batches if len(b)]
        if not held:
            return
        token, cls, n, root, cells = (np.concatenate(x) for x in zip(*held))
        held.clear()
        names, first, code = np.unique(cls, return_index=True, return_inverse=True)
        n, root, cells = n[first].astype(np.int64), root[first], cells[first]
        order = np.lexsort((n[code], token))
        token, code = token[order], code[order]
        cut = np.append(np.flatnonzero(_first_of_runs(token)), len(token))
        tested: set[bytes] = set()
        found = []
        for lo, hi in zip(cut, cut[1:]):
            own = np.unique(code[lo:hi])
            key = own.tobytes()
            if len(own) < 2 or key in tested:  # neighbouring shingles have the same members
                continue
            tested.add(key)
            own = own[np.argsort(n[own], kind="stable")]
            sizes = n[own]
            reach = np.searchsorted(sizes, sizes * DEN // NUM, "right")
            for i in range(len(own) - 1):
                other = own[i + 1: reach[i]]
                other = other[root[other] != root[own[i]]]
                if len(other):
                    ok = other[_may_link(cells[other], cells[own[i]], n[other], n[own[i]])]
                    if len(ok):
                        found.append(np.stack((np.full(len(ok), own[i]), ok)))
        if found:
            a, b = np.concatenate(found, axis=1)
            a, b = _distinct_pairs(names[a], names[b])
            target = _shard_of(mix(a.view(np.uint64) + mix(b.view(np.uint64))), shards)
            rows = [(s, a[x], b[x]) for s, x in enumerate(_by_shard(target, shards)) if len(x)]
            yield pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in rows], pa.int32()), _lists([r[1] for r in rows], pa.int64()),
                _lists([r[2] for r in rows], pa.int64())], names=["shard", "a", "b"])

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(_flat(x, "a"), _flat(x, "b")) for x in batches]
        if held:
            a, b = _distinct_pairs(*(np.concatenate(x) for x in zip(*held)))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    packed = members.select("token", "class", "n", "root", "cells").repartition(shards, "token").mapInArrow(
        run, "shard int, a array<bigint>, b array<bigint>")
    return packed.repartition(shards, "shard").mapInArrow(once, "a bigint, b bigint")


def fragment_sets(docs: DataFrame) -> DataFrame:
    """class and ``parts``: its shingles in ``FRAGMENTS`` ranges of the order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, doc, value, count, cls in _blocks(batches):
            part = doc * FRAGMENTS + (value >> np.uint64(61)).astype(np.int64)  # values are sorted inside a text
            ends = np.searchsorted(part, np.arange(len(ids) * FRAGMENTS + 1)).astype(np.int32)
            inner = pa.ListArray.from_arrays(pa.array(ends), pa.array(value.view(np.int64)))
            outer = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * FRAGMENTS), inner)
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), outer], names=["class", "parts"])

    return docs.mapInArrow(run, "class bigint, parts array<array<bigint>>")


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs that link: partial overlaps are counted for each fragment and summed."""
    pairs = cut_lineage(pairs)
    used = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    ids = cut_lineage(used.join(classes, "class").select(F.col("any_id").alias("doc_id")).distinct())
    few = ids.count() <= BROADCAST_IDS
    of = docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    sets = cut_lineage(fragment_sets(of.select("doc_id", "text")).join(used, "class", "left_semi").dropDuplicates(["class"]))
    joined = pairs.join(sets.select(F.col("class").alias("a"), F.col("parts").alias("x")), "a").join(
        sets.select(F.col("class").alias("b"), F.col("parts").alias("y")), "b")
    partial = F.zip_with("x", "y", lambda p, q: F.size(F.array_intersect(p, q)))
    size = lambda c: F.aggregate(c, F.lit(0), lambda acc, p: acc + F.size(p))
    counted = joined.select(
        "a", "b", F.aggregate(partial, F.lit(0), lambda acc, k: acc + k).cast("long").alias("both"),
        (size("x") + size("y")).cast("long").alias("sum"))
    return counted.filter(F.col("both") * DEN >= (F.col("sum") - F.col("both")) * NUM).select("a", "b")


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) for every row."""
    spark = docs.sparkSession
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text")
    rows, size = base.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    sets = cut_lineage(document_sets(base))
    full = sets.filter("n_shingles > 0")
    # Equal sets have equal cells and counts.
    classes = cut_lineage(full.groupBy("class").agg(
        F.min("doc_id").alias("any_id"), F.first("n_shingles").alias("n"), F.first("cells").alias("cells"), F.first("coarse").alias("coarse")))
    common = common_shingles(base, max(SAMPLE_RATE, -(-rows // SAMPLE_MOST)), shards)
    met = cut_lineage(meetings(prefix_entries(base, common, shards), shards))
    stars = met.filter(F.col("kind") == PAIRS).select(F.explode(F.arrays_zip("token", "class")).alias("p")).select(
        F.col("p.token").alias("a"), F.col("p.class").alias("b")).distinct()

    first = cut_lineage(verified(bounded(stars, classes), base, classes))
    roots = cut_lineage(connected_components(first))
    members = met.filter(F.col("kind") == MEMBERS).select(F.explode(F.arrays_zip("token", "class", "n")).alias("m")).select("m.*")
    labelled = cut_lineage(members.join(roots.select(F.col("node").alias("class"), "root"), "class", "left").select(
        "token", "class", "n", F.coalesce("root", "class").alias("root")))
    unsettled = labelled.groupBy("token").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("members")).filter(
        "low < high and members > 2").select("token")
    rest = labelled.join(unsettled, "token", "left_semi").join(classes.select("class", "cells"), "class")
    second = cut_lineage(verified(residual_pairs(rest, shards), base, classes))
    linked = connected_components(first.unionByName(second)).select(F.col("node").alias("class"), "root")
    rooted = cut_lineage(classes.select("class", "any_id").join(linked, "class", "left").select(
        "class", "any_id", F.coalesce("root", "class").alias("root")))
    least = rooted.groupBy("root").agg(F.min("any_id").alias("component_id"))
    named = rooted.join(least, "root").select("class", "component_id")
    own = F.when(F.col("n_shingles") > 0, F.col("class"))
    known = lambda c: F.when(c != NO_ID, c)
    return sets.select("doc_id", "n_shingles", own.alias("class")).join(named, "class", "left").select(
        known(F.col("doc_id")).alias("doc_id"), "n_shingles",
        known(F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))).alias("component_id"))
