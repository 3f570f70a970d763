"""Alignment of two tokenizers' tokens over the same bytes.

Every text, with one space in front, is cut into tokens by a byte-level BPE (A)
and by a merge model with byte fallback (B). Where a token of both ends, a group
ends. Groups are found by skipping along diagonals: at the current shift (A
index minus B index) the end arrays are compared by slices of doubling length,
so a stretch of one-to-one groups costs a logarithm of its length in probes;
where the ends differ, the smaller end is moved on until both agree again, which
closes an irregular group and sets the next shift.

``aligned`` returns the tokens and groups of each document. ``link_statistics``
adds what the corpus says about each link (an A token and a B token whose bytes
overlap): links of a block of texts are folded to distinct pairs of ids in its
task; only a block's distinct pairs are shuffled to be counted over the corpus
and back. A pair that is frequent everywhere is one row a block, a block holds a
bounded number of bytes or one text, and no vocabulary table is broadcast beyond
the tokenizers and one row per id of B.

Defined results: null and empty texts, and texts whose tokens of A or B do not
join to the text with its space, have no tokens; rows with one id are rows of
their own; an empty table gives an empty result; columns other than ``doc_id``
and ``text`` are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from marquee.llm.words import chunks
from marquee.session import cut_lineage

SPACE_MARK = "▁"
BLOCK_BYTES = 1 << 22
PAIR_BITS = 40  # of a pair of ids; the rest tells the texts of a block apart
# Fixed value: how the byte-level BPE cuts a text before it merges.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteLevel:
    """A byte-level BPE from its JSON file: ``encode`` and the bytes of each id."""

    def __init__(self, file: bytes):
        import tiktoken

        spec = json.loads(file)
        letters = byte_letters()
        special = {t["id"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(letters[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if i not in special}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        made = [spec["model"]["vocab"][a + b] for a, b in pairs]
        if made != sorted(made) or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec.get("normalizer"):
            raise ValueError("not a byte-level BPE whose ids follow its merges")
        self.bytes = [b""] * (max(ranks.values(), default=-1) + 1)
        for piece, i in ranks.items():
            self.bytes[i] = piece
        self.own = tiktoken.Encoding("own", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text; the strings of special tokens are plain text."""
        return [self.own.encode_ordinary(t) for t in texts]


class Pieces:
    """A merge model with byte fallback: ``encode``, which puts the space in front itself, and the bytes of each id."""

    def __init__(self, file: bytes):
        import sentencepiece

        self.own = sentencepiece.SentencePieceProcessor(model_proto=file)
        ids = range(self.own.get_piece_size())
        names = [self.own.id_to_piece(i) for i in ids]
        self.bytes = [
            bytes([int(p[3:5], 16)]) if self.own.is_byte(i) else p.replace(SPACE_MARK, " ").encode() for i, p in zip(ids, names)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.own.encode(texts, num_threads=1)


def align(a: list[int], b: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens of A and of B there are up to the end of each group.

    ``a`` and ``b`` hold the increasing ends of the tokens and close with the same end.
    """
    i = j = 0
    n, m = len(a), len(b)
    if (a[-1] if n else 0) != (b[-1] if m else 0):
        raise ValueError("the tokens cover different bytes")
    from_a: list[int] = []
    from_b: list[int] = []
    runs: list[int] = []
    while i < n:
        left, right = a[i], b[j]
        while left != right:  # an irregular group: move the smaller end on
            if left < right:
                i += 1
                left = a[i]
            else:
                j += 1
                right = b[j]
        # A group ends here; along the shift that it leaves, further ends may agree.
        from_a.append(i)
        from_b.append(j)
        x, y, step = i + 1, j + 1, 4
        most = min(n - i, m - j) + i
        while x + step <= most and a[x: x + step] == b[y: y + step]:
            x += step
            y += step
            step += step
        while step > 4:  # the end of the run lies within the last probe
            step >>= 1
            if x + step <= most and a[x: x + step] == b[y: y + step]:
                x += step
                y += step
        while x < most and a[x] == b[y]:
            x += 1
            y += 1
        runs.append(x - i)
        i, j = x, y
    runs = np.array(runs, dtype=np.int64)
    along = np.arange(1, int(runs.sum()) + 1) - np.repeat(np.cumsum(runs) - runs, runs)
    return tuple(np.repeat(np.array(x, dtype=np.int64), runs) + along for x in (from_a, from_b))


class Strings:
    """Byte strings by number; ``joined`` are those of many numbers, one after the other."""

    def __init__(self, strings: list[bytes]):
        self.size = np.array([len(x) for x in strings], dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(strings), dtype=np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        stop = np.cumsum(size)
        return self.flat[np.repeat(self.start[ids] - (stop - size), size) + np.arange(int(size.sum()))]


class Aligner:
    """Both tokenizers, and the alignment of texts by them."""

    def __init__(self, byte_level: bytes, pieces: bytes):
        self.a, self.b = ByteLevel(byte_level), Pieces(pieces)
        self.n_b = len(self.b.bytes)
        self.of_a, self.of_b = Strings(self.a.bytes), Strings(self.b.bytes)
        # What each token adds to a printed group list: inside its side of a group, and closing it.
        self.printed = Strings([f"{i}{c}".encode() for n, last in ((len(self.a.bytes), "|"), (self.n_b, ";")) for i in range(n) for c in "," + last])

    def texts(self, raw: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
        """(A ids, B ids, A ends, B ends, A tokens up to each group's end, B tokens likewise) of each text."""
        none = np.zeros(0, dtype=np.int64)
        texts = [x.decode() for x in raw]
        for x, ids_a, ids_b in zip(raw, self.a.encode([" " + t for t in texts]), self.b.encode(texts)):
            whole = np.frombuffer(b" " + x, dtype=np.uint8)
            ids_a, ids_b = np.array(ids_a, dtype=np.int64), np.array(ids_b, dtype=np.int64)
            if not x or not np.array_equal(self.of_a.joined(ids_a), whole) or not np.array_equal(self.of_b.joined(ids_b), whole):
                yield (none,) * 6
                continue
            ends_a, ends_b = np.cumsum(self.of_a.size[ids_a]), np.cumsum(self.of_b.size[ids_b])
            yield ids_a, ids_b, ends_a, ends_b, *align(ends_a.tolist(), ends_b.tolist())

    def group_list(self, ids_a: np.ndarray, ids_b: np.ndarray, up_a: np.ndarray, up_b: np.ndarray) -> bytes:
        """``a1,a2|b1;a3|b2,b3``: the ids of each group."""
        per_a, per_b = np.diff(up_a, prepend=0), np.diff(up_b, prepend=0)
        out = np.empty(len(ids_a) + len(ids_b), dtype=np.int64)
        last_a, last_b = np.zeros(len(ids_a), dtype=np.int64), np.zeros(len(ids_b), dtype=np.int64)
        last_a[up_a - 1] = 1
        last_b[up_b - 1] = 1
        out[np.arange(len(ids_a)) + np.repeat(up_b - per_b, per_a)] = 2 * ids_a + last_a
        out[np.arange(len(ids_b)) + np.repeat(up_a, per_b)] = 2 * (len(self.a.bytes) + ids_b) + last_b
        return self.printed.joined(out).tobytes()[:-1]

    def links(self, ids_a, ids_b, ends_a, ends_b, up_a, up_b) -> np.ndarray:
        """The pair (A id * number of B ids + B id) of every link."""
        per_a, per_b = np.diff(up_a, prepend=0), np.diff(up_b, prepend=0)
        plain = (per_a == 1) & (per_b == 1)
        one = ids_a[up_a[plain] - 1] * self.n_b + ids_b[up_b[plain] - 1]
        # In an irregular group each stretch between two ends of either side is one link.
        odd_a, odd_b = np.repeat(~plain, per_a), np.repeat(~plain, per_b)
        in_a, in_b = ends_a[odd_a], ends_b[odd_b]
        ends = np.union1d(in_a, in_b)
        rest = ids_a[odd_a][np.searchsorted(in_a, ends)] * self.n_b + ids_b[odd_b][np.searchsorted(in_b, ends)]
        return np.concatenate((one, rest))


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers, byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(x.astype("<i4")).view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(x).to_bytes(8, "little") + (pa.compress(planes, codec="zstd", asbytes=True) if len(x) else b"")


def _unpacked(x: bytes) -> np.ndarray:
    n = int.from_bytes(x[:8], "little")
    planes = pa.decompress(x[8:], 4 * n, codec="zstd", asbytes=True) if n else b""
    return np.frombuffer(planes, dtype=np.uint8).reshape(4, n).T.copy().view("<i4").ravel().astype(np.int64)


def _files(docs: DataFrame, byte_level: str, pieces: str):
    """Both tokenizer files, sent to the tasks: a few megabytes."""
    with open(byte_level, "rb") as a, open(pieces, "rb") as b:
        return docs.sparkSession.sparkContext.broadcast((a.read(), b.read()))


def aligned(docs: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """``doc_id`` with ``a_ids``, ``b_ids``, and ``a_upto``, ``b_upto``: the tokens of A and B up to each group's end."""
    files = _files(docs, byte_level, pieces)
    schema = T.StructType([docs.schema["doc_id"]] + [
        T.StructField(c, T.ArrayType(T.LongType())) for c in ("a_ids", "b_ids", "a_upto", "b_upto")])

    def run(batches):
        own = Aligner(*files.value)
        for batch in batches:
            for ids, raw in chunks(batch, "doc_id"):
                found = [(x[0], x[1], x[4], x[5]) for x in own.texts(raw)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, type=batch.schema.field("doc_id").type)]
                    + [pa.array([f[k].tolist() for f in found], type=pa.list_(pa.int64())) for k in range(4)],
                    names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


BLOCK_COLUMNS = ["n_a", "n_b", "n_groups", "n_links"]


def _blocks(docs: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """A row per block of texts: the measures of its documents, its distinct pairs with their counts, and which
    of them each document holds how often (packed)."""
    files = _files(docs, byte_level, pieces)
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("doc_id", T.ArrayType(docs.schema["doc_id"].dataType)),
        *[T.StructField(c, longs) for c in BLOCK_COLUMNS], T.StructField("groups_sha256", T.ArrayType(T.StringType())),
        T.StructField("pairs", longs), T.StructField("counts", longs),
        T.StructField("held", longs), T.StructField("which", T.BinaryType()), T.StructField("times", T.BinaryType())])

    def run(batches):
        own = Aligner(*files.value)
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for ids, raw in chunks(batch, "doc_id", size=BLOCK_BYTES):
                measures, digests, links = [], [], []
                for k, (ids_a, ids_b, ends_a, ends_b, up_a, up_b) in enumerate(own.texts(raw)):
                    found = own.links(ids_a, ids_b, ends_a, ends_b, up_a, up_b)
                    links.append(found | (k << PAIR_BITS))
                    measures.append((len(ids_a), len(ids_b), len(up_a), len(found)))
                    text = own.group_list(ids_a, ids_b, up_a, up_b)
                    digests.append(hashlib.sha256(text).hexdigest() if text else "")
                entry, times = np.unique(np.concatenate(links), return_counts=True)
                pairs, which = np.unique(entry & ((1 << PAIR_BITS) - 1), return_inverse=True)
                counts = np.bincount(which, weights=times, minlength=len(pairs)).astype(np.int64)
                held = np.searchsorted(entry >> PAIR_BITS, np.arange(len(ids) + 1))
                schema_id = batch.schema.field("doc_id").type
                columns = [pa.array([block]), pa.array([ids], type=pa.list_(schema_id))]
                columns += [pa.array([list(c)], type=pa.list_(pa.int64())) for c in zip(*measures)]
                columns += [pa.array([digests], type=pa.list_(pa.string()))]
                columns += [pa.array([c], type=pa.list_(pa.int64())) for c in (pairs, counts, held)]
                columns += [pa.array([_packed(np.diff(which, prepend=0))]), pa.array([_packed(times)])]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
                block += 1

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def link_statistics(docs: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """Per document: tokens, groups, links, the links that are best for their B id, and the summed counts of all links.

    The count of a pair of ids is the number of links of the whole corpus that hold it.
    """
    blocks = cut_lineage(_blocks(docs, byte_level, pieces))
    with open(pieces, "rb") as f:
        n_b = len(Pieces(f.read()).bytes)
    each = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "counts")).alias("pos", "x")).select(
        "block", "pos", F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n"))
    total = cut_lineage(each.groupBy("pair").agg(F.sum("n").alias("count")))
    b_id = (F.col("pair") % n_b).alias("b_id")
    highest = total.groupBy(b_id).agg(F.max("count").alias("highest"))  # a row per id of B at most
    rated = total.withColumn("b_id", b_id).join(F.broadcast(highest), "b_id").select(
        "pair", "count", (F.col("count") == F.col("highest")).alias("best"))
    back = each.select("block", "pos", "pair").join(rated, "pair").groupBy("block").agg(
        F.collect_list(F.struct("pos", "count", "best")).alias("x")).select(
        "block", F.col("x.pos").alias("pos"), F.col("x.count").alias("count"), F.col("x.best").alias("best"))
    long = T.LongType()
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *[
        T.StructField(c, long) for c in (*BLOCK_COLUMNS, "n_best", "count_sum")], T.StructField("groups_sha256", T.StringType())])

    def run(batches):
        for batch in batches:
            for k in range(len(batch)):
                row = batch.slice(k, 1)
                flat = {c: row[c][0] for c in row.schema.names}
                values = lambda c: np.asarray(flat[c].values, dtype=np.int64) if flat[c].is_valid else np.zeros(0, dtype=np.int64)
                pos = values("pos")
                count, best = np.zeros((2, len(pos)), dtype=np.int64)
                count[pos] = values("count")
                best[pos] = values("best")
                held = values("held")
                which, times = np.cumsum(_unpacked(flat["which"].as_py())), _unpacked(flat["times"].as_py())
                upto = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[held])
                columns = [flat["doc_id"].values, *[flat[c].values for c in BLOCK_COLUMNS]]
                columns += [pa.array(upto(best[which] * times)), pa.array(upto(count[which] * times)), flat["groups_sha256"].values]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    fields = ["doc_id", *BLOCK_COLUMNS, "groups_sha256", "held", "which", "times"]
    return blocks.select("block", *fields).join(back, "block", "left").select(*fields, "pos", "count", "best").mapInArrow(run, schema)
