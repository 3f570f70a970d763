"""Encoding with a SentencePiece merge model under seeded merge-dropout, and decoding.

A text gets one space in front, spaces become U+2581, and is cut before every
run of spaces; merges never cross such a cut. In each part the agenda of
adjacent pairs is worked off by score, leftmost first among equals, and every
candidate merge is skipped when the keyed hash of (seed, text, position of the
part in it, part, place) falls below ``dropout``: on its own in each occurrence
of a word. Nothing depends on partitions or order. The agendas of all parts of
a block are worked off side by side: in each round every part takes its best
allowed pair. Without dropout equal parts of a block share one agenda.

Characters without a piece, and U+2581 itself, become byte pieces, so decoding
gives back every text exactly. With ``dropout = 0`` the pieces are those of the
model's own encoder, where that leaves the text as it is before encoding.

Defined results: a null text has null pieces and decodes to null; the empty text
has no pieces; equal texts get equal pieces; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from marquee.llm.words import BASE, INVERSE, mix, powers

SPACE_MARK = 0x2581
DROPOUT = 0.1
SEED = 17
BLOCK_CHARS = 1 << 15  # what a block works on stays in a core's cache
UNKNOWN = -1
SLOT = (1 << 32) - 1  # the lower half of an agenda's entry


class Model:
    """Pieces, scores and merges of a merge model; read from its bytes, trained elsewhere."""

    def __init__(self, proto: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        size = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(size)]
        plain = {p: i for i, p in enumerate(pieces) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
        self.size = size
        self.score = np.array([sp.get_score(i) for i in range(size)])
        self.rank = np.argsort(np.argsort(-self.score, kind="stable"), kind="stable")  # 0 is merged first
        self.turn = np.append(self.rank, size) << 32  # of UNKNOWN, the last one: never
        self.of_char = np.full(0x110000, UNKNOWN, dtype=np.int64)
        for p, i in plain.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        self.of_byte = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=np.int64)
        merges = {}
        for p, i in plain.items():
            for k in range(1, len(p)):
                left, right = plain.get(p[:k]), plain.get(p[k:])
                if left is not None and right is not None:
                    merges[left * size + right] = i
        self._index(np.array(list(merges), dtype=np.int64), np.array(list(merges.values()), dtype=np.int64))
        raw = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace(chr(SPACE_MARK), " ").encode() if p in plain else b""
               for i, p in enumerate(pieces)]
        self.raw = np.frombuffer(b"".join(raw), dtype=np.uint8)
        self.raw_size = np.array([len(r) for r in raw], dtype=np.int64)
        self.raw_start = np.cumsum(self.raw_size) - self.raw_size

    def _index(self, key: np.ndarray, piece: np.ndarray) -> None:
        """A hash table of the merges with open addressing, an eighth full at most."""
        bits = max(4, (8 * len(key)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.pair, self.merged = np.full(1 << bits, UNKNOWN, dtype=np.int64), np.full(1 << bits, UNKNOWN, dtype=np.int64)
        slot = self._slot(key)
        while len(key):
            free = np.flatnonzero(self.pair[slot] == UNKNOWN)
            taken, of = np.unique(slot[free], return_index=True)
            self.pair[taken], self.merged[taken] = key[free[of]], piece[free[of]]
            rest = self.pair[slot] != key
            key, piece, slot = key[rest], piece[rest], (slot[rest] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(BASE) >> self.shift).astype(np.int64)

    def merge(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece each pair merges into, or UNKNOWN."""
        key = left * self.size + right
        key[(left < 0) | (right < 0)] = -2  # in no slot
        slot = self._slot(key)
        found = self.pair[slot]
        out = np.where(found == key, self.merged[slot], UNKNOWN)
        open_ = np.flatnonzero((found != key) & (found != UNKNOWN))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            found = self.pair[slot[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.merged[slot[open_[hit]]]
            open_ = open_[~hit & (found != UNKNOWN)]
        return out


def agendas(model: Model, chars: np.ndarray, length: np.ndarray, key: np.ndarray, dropout: float):
    """Pieces of many parts (``chars`` one after another): (symbols, count of each part); UNKNOWN stays for characters without a piece.

    Symbols stay in the slot of their first character and know their neighbours'
    slots, so a round moves nothing: it takes the least entry of every part, made
    of the rank and the slot of the pair's left symbol, and weighs two pairs anew.
    """
    limit = np.uint64(min(int(dropout * 2.0 ** 64), 2 ** 64 - 1))
    n = len(chars)
    part = np.repeat(np.arange(len(length)), length)
    size = length[length > 0]
    ends = np.cumsum(size)
    first = ends - size
    # The last slot stands for the missing neighbour at both ends of every part; it merges with nothing.
    symbol = np.append(model.of_char[chars], UNKNOWN)
    right, left = np.arange(1, n + 2), np.arange(-1, n)
    right[ends - 1] = left[first] = right[n] = n
    place = (np.arange(n) - np.repeat(first, size)).astype(np.uint64)
    as_left = np.append(key[part] + place * np.uint64(BASE), np.uint64(0))
    as_right = np.append(place * np.uint64(BASE >> 7 | 1), np.uint64(0))
    piece, entry = np.empty(n + 1, dtype=np.int64), np.empty(n + 1, dtype=np.int64)
    none = np.int64(model.size) << 32

    def weigh(i: np.ndarray, j: np.ndarray) -> None:
        """The piece and the entry of the pairs in the slots ``i`` and ``j``."""
        found = model.merge(symbol[i], symbol[j])
        if dropout > 0:
            good = np.flatnonzero(found >= 0)
            of = found[good]
            h = mix(as_left[i[good]] + as_right[j[good]] + of.astype(np.uint64) * np.uint64(INVERSE))
            found[good[h < limit]] = UNKNOWN
        piece[i] = found
        entry[i] = model.turn[found] | i

    weigh(np.arange(n), right[:n])
    slot, out, kept = np.arange(n), symbol[:n].copy(), np.ones(n, dtype=bool)
    while len(first):
        best = np.minimum.reduceat(entry[:-1], first)
        live = best < none
        if 2 * np.count_nonzero(live) <= len(live):  # parts that are done leave, half of them at a time
            stay = np.repeat(live, size)
            out[slot[~stay]] = symbol[:-1][~stay]
            moved = np.append(np.cumsum(stay) - 1, np.count_nonzero(stay))
            stay = np.append(stay, True)
            left, right = moved[left[stay]], moved[right[stay]]
            symbol, as_left, as_right, piece = symbol[stay], as_left[stay], as_right[stay], piece[stay]
            slot, entry = slot[stay[:-1]], entry[stay] & ~SLOT | np.arange(len(symbol))
            size, best = size[live], best[live]
            first = np.cumsum(size) - size
            hit = moved[best & SLOT]
        else:
            hit = best[live] & SLOT
        gone, before = right[hit], left[hit]
        after = right[gone]
        symbol[hit] = piece[hit]
        kept[slot[gone]] = False
        entry[gone] = none
        right[hit], left[after] = after, hit
        weigh(np.concatenate((hit, before)), np.concatenate((after, hit)))
    return out[kept], np.bincount(part[kept], minlength=len(length))


def _within(sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def encode_block(model: Model, texts: list[str], dropout: float = DROPOUT, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(ids, count of each text)."""
    chars = np.frombuffer("".join(" " + t if t else "" for t in texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    size = np.array([len(t) + 1 if t else 0 for t in texts], dtype=np.int64)
    if not len(chars):
        return np.zeros(0, dtype=np.int64), size
    text = np.repeat(np.arange(len(texts)), size)
    space = chars == 0x20
    mark = chars == SPACE_MARK
    begin = np.ones(len(chars), dtype=bool)
    begin[1:] = (space[1:] & ~space[:-1]) | (text[1:] != text[:-1])
    start = np.flatnonzero(begin)
    length = np.diff(np.append(start, len(chars)))
    # A hash for each part and each text from running sums, as for words.
    value = np.cumsum(np.concatenate((np.zeros(1, np.uint64), mix(chars.astype(np.uint64) + np.uint64(3)) * powers(BASE, len(chars)))))
    down = powers(INVERSE, len(chars) + 1)
    part_hash = mix((value[start + length] - value[start]) * down[start])
    ends = np.cumsum(size)
    first = np.minimum(ends - size, len(chars))
    text_hash = mix((value[ends] - value[first]) * down[first])
    owner = text[start]
    nth = _within(np.bincount(owner, minlength=len(texts)))
    if dropout > 0:
        text_key = mix(text_hash + np.uint64(seed * BASE % (1 << 64)))
        key = mix(part_hash + mix(text_key[owner] + nth.astype(np.uint64) * np.uint64(BASE)))
        at = inverse = np.arange(len(start))
    else:
        key, at, inverse = np.unique(part_hash, return_index=True, return_inverse=True)
    u_length = length[at]
    source = np.repeat(start[at], u_length) + _within(u_length)
    symbols = np.where(space, SPACE_MARK, np.where(mark, 0x10FFFF, chars))  # U+2581 itself has no piece
    symbol, count = agendas(model, symbols[source], u_length, key, dropout)
    # Characters without a piece in byte pieces: which character it was follows from the pieces before it.
    if (symbol == UNKNOWN).any():
        symbol, count = _with_bytes(model, symbol, count, chars[source], symbols[source], u_length)
    begin_of = np.cumsum(count) - count
    many = count[inverse]
    ids = symbol[np.repeat(begin_of[inverse], many) + _within(many)]
    return ids, np.bincount(owner, weights=many, minlength=len(texts)).astype(np.int64)


def _with_bytes(model, symbol, count, chars, symbols, length):
    """Replace every UNKNOWN by the byte pieces of its character."""
    lost = chars[model.of_char[symbols] == UNKNOWN]  # in the order of the UNKNOWN symbols
    raw = [chr(c).encode("utf-8", "surrogatepass") for c in lost.tolist()]
    times = np.ones(len(symbol), dtype=np.int64)
    where = np.flatnonzero(symbol == UNKNOWN)
    times[where] = [len(r) for r in raw]
    out = np.repeat(symbol, times)
    out[np.repeat(symbol == UNKNOWN, times)] = model.of_byte[np.frombuffer(b"".join(raw), dtype=np.uint8)]
    part = np.repeat(np.arange(len(count)), count)
    return out, np.bincount(part, weights=times, minlength=len(count)).astype(np.int64)


def decode_block(model: Model, ids: np.ndarray, count: np.ndarray) -> list[bytes]:
    """The texts (UTF-8) of many lists of ids, without the space put in front."""
    size = model.raw_size[ids]
    raw = model.raw[np.repeat(model.raw_start[ids], size) + _within(size)].tobytes()
    ends = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(count)))]
    return [raw[a + 1: b] if b > a else b"" for a, b in zip(ends.tolist(), ends[1:].tolist())]


_models: dict[int, Model] = {}


def _model(proto: bytes) -> Model:
    key = hash(proto)
    if key not in _models:
        _models[key] = Model(proto)
    return _models[key]


def _parts(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch in which the sizes of ``column`` (characters or pieces) sum up to ``most``, or one row."""
    from pyarrow import compute as pc

    sizes = (pc.binary_length if pa.types.is_string(batch[column].type) else pc.list_value_length)(batch[column])
    ends = np.cumsum(sizes.fill_null(0).to_numpy().astype(np.int64))
    at = 0
    while at < len(batch):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def encoded(docs: DataFrame, model_path: str, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """All columns of ``docs`` and ``pieces`` (array<int>); a column of that name is replaced."""
    with open(model_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # the model file, on the driver only

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared.value)
        for batch in batches:
            for part in _parts(batch, "text", BLOCK_CHARS):
                texts = part["text"].to_pylist()
                ids, count = encode_block(model, [t or "" for t in texts], dropout, seed)
                ends = pa.array(np.concatenate(([0], np.cumsum(count))), pa.int32())
                lists = pa.ListArray.from_arrays(ends, pa.array(ids, pa.int32()), mask=pa.array([t is None for t in texts], pa.bool_()))
                yield part.append_column("pieces", lists)

    rest = docs.drop("pieces")
    return rest.mapInArrow(run, T.StructType([*rest.schema.fields, T.StructField("pieces", T.ArrayType(T.IntegerType()))]))


def decoded(rows: DataFrame, model_path: str) -> DataFrame:
    """All columns of ``rows`` and ``decoded``, the text of ``pieces``."""
    with open(model_path, "rb") as f:
        shared = rows.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared.value)
        for batch in batches:
            for part in _parts(batch, "pieces", BLOCK_CHARS):
                lists = part["pieces"]
                count = lists.value_lengths().fill_null(0).to_numpy().astype(np.int64)
                texts = decode_block(model, lists.flatten().to_numpy().astype(np.int64), count)
                yield part.append_column("decoded", pa.array(
                    [None if null else t.decode("utf-8") for t, null in zip(texts, lists.is_null().to_pylist())], pa.string()))

    rest = rows.drop("decoded")
    return rest.mapInArrow(run, T.StructType([*rest.schema.fields, T.StructField("decoded", T.StringType())]))
