"""Fingerprints, shards, archives, benchmark search, pieces and chat windows."""

import hashlib
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marquee.llm import chat, decontaminate, fingerprints, pieces, sharding, warc
from marquee.llm.chat_queries import SQL, chat_formatting
from marquee.llm.fingerprint_queries import fingerprints as fingerprint_query
from marquee.session import cut_lineage

SF = "/root/testdata/sf0.001"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


# --- fingerprints


def test_edited_texts(spark):
    rows = {r["doc_id"]: r for r in fingerprint_query(spark, SF).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    order = sorted(texts, reverse=True)
    for i, nxt in zip(order, order[1:] + order[:1]):
        t, n = texts[i], len(texts[i])
        edited = t[: n - n // 3] + texts[nxt][: n // 3]
        r = rows[i]
        assert (r["n_chars"], r["edited_sha256"]) == (n, hashlib.sha256(edited.encode()).hexdigest())
        like = lambda a, b: 1 - bin(int(a, 16) ^ int(b, 16)).count("1") / 64
        assert r["near_edited"] == like(r["fingerprint"], r["edited_fingerprint"])
        assert r["near_next"] == like(r["fingerprint"], rows[nxt]["fingerprint"])
    assert np.mean([r["near_edited"] for r in rows.values()]) > np.mean([r["near_next"] for r in rows.values()]) + 0.15


def test_votes_equal_plain_votes(spark):
    texts = ["a bb ccc bb", "One  two\tthree", "longer-than-twelve-letters again", "", "x", "é 日本 x x"]
    hashes = {w: r[0] & (1 << 64) - 1 for w in {w for t in texts for w in t.split()}
              for r in spark.sql("SELECT xxhash64(:w)", args={"w": w}).collect()}
    got = fingerprints.votes(spark.createDataFrame(list(enumerate(texts)), "k int, text string"), ["k"], F.col("text"))
    for r in got.collect():
        weights = [(hashes[w], min(len(w), 12)) for w in texts[r["k"]].split()]
        want = sum(1 << b for b in range(64) if 2 * sum(w for h, w in weights if h >> b & 1) > sum(w for _, w in weights))
        assert r["fingerprint"] & (1 << 64) - 1 == want


@pytest.mark.parametrize("radius", [3, 8, 9])
def test_block_tables_find_all_within_the_radius(spark, radius):
    rng = random.Random(radius)
    base = [rng.getrandbits(64) for _ in range(40)]
    near = {b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(0, radius + 4))) for b in base for _ in range(12)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    prints = spark.createDataFrame([(signed(x),) for x in near | set(base)], "fingerprint long")
    queries = spark.createDataFrame([(signed(x),) for x in base], "query long")
    got = [tuple(r) for r in fingerprints.near(prints, queries, radius).collect()]
    want = {(signed(a), signed(b), bin(a ^ b).count("1")) for a in near | set(base) for b in base if bin(a ^ b).count("1") <= radius}
    assert len(got) == len(want) and set(got) == want


def test_edited_copies_of_query_documents_are_found(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(rng.randrange(2, 9)))
    shingles = lambda w: {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
    rows, like = [], {}
    for q in range(100, 1100, 100):
        base = [word() for _ in range(200)]
        rows.append((q, " ".join(base)))
        for k in range(1, 13):
            w = list(base)
            for _ in range(1 + k % 6):
                w[rng.randrange(200)] = word()
            both = len(shingles(base) & shingles(w))
            like[q + k] = both / (2 * 196 - both)
            rows.append((q + k, " ".join(w)))
    found = fingerprints.with_near_queries(fingerprints.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")))
    nearest = {r["doc_id"]: r["nearest_query"] for r in found.collect() if r["near_queries"]}
    copies = [i for i, j in like.items() if 0.75 <= j <= 0.97]
    assert len(copies) > 80 and min(like[i] for i in copies) < 0.8
    assert np.mean([nearest.get(i) == i // 100 * 100 for i in copies]) > 0.97
    assert all(i // 100 == q // 100 for i, q in nearest.items())


def test_fingerprints_of_odd_rows(odd_docs, no_docs):
    rows = fingerprints.edited_fingerprints(odd_docs).collect()
    by_id = {r["doc_id"]: r for r in rows}
    assert len(rows) == 11  # the repeated row once
    assert by_id[1]["print"] == by_id[2]["print"] == by_id[None]["print"]
    assert by_id[3]["print"] == by_id[4]["print"] == by_id[5]["print"] == 0
    assert fingerprints.edited_fingerprints(no_docs).count() == 0


# --- shards


def test_shards(spark, small_docs, odd_docs, no_docs):
    for docs, shards in ((small_docs, 8), (odd_docs, 40)):
        got = sharding.assign(docs, shards).collect()
        assert len(got) == docs.count()
        by = {}
        for r in got:
            by.setdefault(r["shard"], []).append(r)
        for rows in by.values():
            assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
        total, most = sum(r["size"] for r in got), max(r["size"] for r in got)
        assert all(abs(sum(r["size"] for r in rows) - total / shards) <= most + total / shards / 32 for rows in by.values())
    assert sharding.assign(no_docs).count() == 0


def test_hot_text_is_spread(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same text").otherwise(F.concat(F.lit("text "), "id")).alias("text"))
    got = sharding.assign(docs, 10).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    sizes = [r["b"] for r in got]
    assert len(sizes) == 10 and max(sizes) < 1.05 * min(sizes)


# --- archives


def test_archives_round_trip(spark, tmp_path):
    rows = [(5, "http://a/", "same"), (3, "http://b/", "same"), (9, None, None), (8, "u", ""), (7, "x y", "é\r\n\r\nWARC/1.1\r\n"), (7, "x y", "twice"),
            (None, "n", "same"), (10, "big", "z" * 3_000_000)]
    pages = spark.createDataFrame([(*r, 0, "p") for r in rows], "page_id long, url string, html string, sha int, payload string").repartition(3)
    records = warc.deduplicated(pages, "page_id", "url", "html")
    archives = cut_lineage(warc.write_archives(records, str(tmp_path)))
    entries = cut_lineage(warc.normalise(archives))
    got = {(r["page_id"], r["payload_digest"]): r for r in warc.read_records(entries).collect()}
    for i, _, html in rows:
        raw = (html or "").encode()
        r = got[i, warc.sha1_base32(raw)]
        assert r["payload_bytes"] == len(raw)
        if r["record_type"] == "response":
            assert bytes(r["payload"]) == raw
    assert got[5, warc.sha1_base32(b"same")]["refers_to"] == 3 and got[9, warc.sha1_base32(b"")]["refers_to"] == 8
    assert got[3, warc.sha1_base32(b"same")]["record_type"] == "response"
    index = warc.index_entries(entries).collect()
    assert len(index) == len(rows) and all(r["length"] > 0 for r in index)
    assert warc.write_archives(records.limit(0), str(tmp_path)).count() == 0


# --- benchmark


def distance(p, c):
    prev = [0] * (len(c) + 1)
    for i, x in enumerate(p, 1):
        cur = [i]
        for j, y in enumerate(c, 1):
            cur.append(min(prev[j - 1] + (x != y), prev[j] + 1, cur[-1] + 1))
        prev = cur
    return min(prev)


def test_benchmark_equals_alignment_of_all_pairs(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randrange(2, 7)))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([30, 25, 20, 1, 8])] + [(5, None), (6, "  ")]
    docs = []
    for i in range(40):
        p = list(items[i % 3][1])
        for _ in range(rng.randrange(0, 16)):
            at = rng.randrange(len(p))
            p[at: at + rng.randrange(2)] = rng.choice("abcde ")
        docs.append((i, " ".join(word() for _ in range(20)) + " " + "".join(p).upper() + "\n" + " ".join(word() for _ in range(20))))
    docs += [(100, None), (101, ""), (102, items[3][1]), (102, items[3][1]), (None, items[4][1])]
    got = decontaminate.contaminated(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = {}
    for d, t in docs:
        for i, x in items:
            p, c = decontaminate.fold(x), decontaminate.fold(t)
            if not p or not c:
                continue
            k = int(len(p) * decontaminate.RATE)
            if len(p) - decontaminate.Q + 1 < k * decontaminate.Q + 1:
                k = 0
            e = distance(p, c)
            if e <= k:
                want[d, i] = e
    assert {(r["doc_id"], r["item_id"]): r["distance"] for r in got.collect()} == want
    kept = decontaminate.clean(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {r["doc_id"] for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_benchmark_in_a_very_long_text(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PIECE", 1000)
    item = "a benchmark passage that is long enough to be found with edits in it"
    docs = [(i, "filler words " * (70 + i) + item.replace("found", "fond") + " more filler" * 200) for i in range(12)]
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted(r["doc_id"] for r in got.collect()) == list(range(12))


# --- pieces


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.5, 1.0])
def test_pieces_decode_to_the_text(dropout):
    model = pieces.Model(open(MODEL, "rb").read())
    texts = ["", "a", "  x ", "▁▁a▁ b", "\n\t", "日本語 🙂 é", "\x00", "word " * 200, "internationalization " * 3]
    ids, count = pieces.encode_block(model, texts, dropout)
    assert [t.decode() for t in pieces.decode_block(model, ids, count)] == texts


def test_pieces_without_dropout_are_the_models_own(small_docs):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    model = pieces.Model(open(MODEL, "rb").read())
    texts = [r["text"] for r in small_docs.collect()]
    ids, count = pieces.encode_block(model, texts, 0.0)
    ends = np.cumsum(count)
    assert [ids[e - c: e].tolist() for e, c in zip(ends, count)] == own.encode(texts)


def test_merges_follow_the_agenda():
    """Against a plain agenda over one part at a time, with the same keyed hash."""
    model = pieces.Model(open(MODEL, "rb").read())
    parts = ["▁therefore", "▁aaaaaaaa", "▁internationalization", "▁x"]
    chars = np.array([ord(c) for p in parts for c in p])
    length, key = np.array([len(p) for p in parts]), np.arange(4, dtype=np.uint64) + np.uint64(5)
    symbol, count = pieces.agendas(model, chars, length, key, 0.3)
    at = 0
    for p, k, c in zip(parts, key, count):
        nodes = [[i, int(model.of_char[ord(x)])] for i, x in enumerate(p)]
        while True:
            best = None
            for i in range(len(nodes) - 1):
                piece = int(model.merge(np.array([nodes[i][1]]), np.array([nodes[i + 1][1]]))[0])
                if piece < 0:
                    continue
                m = 2 ** 64
                h = (int(k) + nodes[i][0] * pieces.BASE + nodes[i + 1][0] * (pieces.BASE >> 7 | 1) + piece * pieces.INVERSE) % m
                if int(pieces.mix(np.array([h], dtype=np.uint64))[0]) < int(0.3 * 2.0 ** 64):
                    continue
                if best is None or (model.rank[piece], i) < best[:2]:
                    best = (model.rank[piece], i, piece)
            if best is None:
                break
            nodes[best[1]][1] = best[2]
            del nodes[best[1] + 1]
        assert symbol[at: at + c].tolist() == [n[1] for n in nodes]
        at += c


def test_a_round_moves_no_symbols():
    """A merge in a long part costs about the same as one in a short part."""
    model = pieces.Model(open(MODEL, "rb").read())

    def seconds(n):
        word = "".join(np.random.default_rng(1).choice(list("etaoinshrdlu"), n))
        start = time.process_time()
        pieces.encode_block(model, [word])
        return time.process_time() - start

    seconds(100)
    assert seconds(40_000) < 18 * min(seconds(5_000) for _ in range(3))


def test_dropout_is_drawn_for_each_occurrence():
    model = pieces.Model(open(MODEL, "rb").read())
    texts = [f"t{k}" + " internationalization the" * 40 for k in range(100)]
    ids, count = pieces.encode_block(model, texts)
    words, at = {"internationalization": [], "the": []}, 0
    for t, c in zip(texts, count):
        text, word = "", []
        for i in ids[at: at + c].tolist():
            piece = bytes(model.raw[model.raw_start[i]: model.raw_start[i] + model.raw_size[i]]).decode()
            if piece.startswith(" ") and word:
                words.get("".join(x for _, x in word).strip(), []).append(tuple(i for i, _ in word))
                word = []
            word.append((i, piece))
            text += piece
        assert text == " " + t
        at += c
    ways = {w: Counter(x) for w, x in words.items()}
    assert len(ways["internationalization"]) > 100
    of = pieces.agendas(model, np.array([0x2581, *map(ord, "the")] * 4000), np.full(4000, 4), pieces.mix(np.arange(4000, dtype=np.uint64)), pieces.DROPOUT)
    whole = np.mean(of[1] == 1)  # of as many independent keys
    got = ways["the"].most_common(1)[0][1] / sum(ways["the"].values())
    assert 0.5 < got < 0.95 and abs(got - whole) < 0.03
    # Occurrences of one text differ as well, and equal texts do not.
    assert np.array_equal(*np.split(pieces.encode_block(model, texts[:1] * 2)[0], 2))


def test_pieces_of_odd_rows(odd_docs, no_docs):
    got = pieces.decoded(pieces.encoded(odd_docs, MODEL), MODEL).collect()
    assert len(got) == 12 and all(r["decoded"] == r["text"] for r in got)
    assert [r["pieces"] for r in got if r["text"] is None] == [None]
    assert pieces.encoded(no_docs, MODEL).count() == 0


# --- chat


def test_chat_equals_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    want = {r[0]: r[1:] for r in con.sql(SQL).fetchall()}
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat_formatting(spark, SF).collect()}
    assert got == want


def test_chat_windows_of_odd_rows(spark):
    turns = [(1, 0, "system", "be kind")] + [(1, k, ("assistant", "user")[k % 2], f"turn {k} " + "x" * 60) for k in range(1, 40)]
    turns += [(2, 0, None, None), (2, 1, "assistant", None), (None, 0, "user", r"\</s>[INST]<\/s>[TEXT]"), (None, 0, "user", r"\</s>[INST]<\/s>[TEXT]")]
    turns += [(3, 0, "user", "y" * 50_000), (3, 1, "assistant", "z" * 50_000), (4, 5, "system", "only")]
    rows = spark.createDataFrame([(*t, "win", 1) for t in turns], "conv_id long, turn long, role string, text string, formatted string, loss int")
    windows = chat.format_windows(rows, budget=200, history=2).cache()
    mine = windows.filter("conv_id = 1").orderBy("win").collect()
    assert len(mine) > 3 and all(r["tokens"] <= 200 for r in mine)
    assert all(r["formatted"].startswith("<s>[TURN]system[TEXT]be kind") and r["repeated"] <= 3 for r in mine)
    back = {r["conv_id"]: r for r in chat.read_back(windows).collect()}
    for c in (1, 2, 3, 4, None):
        own = sorted([(t, r or "", x or "") for i, t, r, x in turns if i == c])
        assert [(t["role"], t["text"]) for t in back[c]["turns"]] == [x[1:] for x in own]
        assert back[c]["loss_text"] == "".join(x for _, r, x in own if r == "assistant")
    assert chat.format_windows(rows.limit(0)).count() == 0
