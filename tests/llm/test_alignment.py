"""Alignment of two tokenizers against a plain version."""

import hashlib
import json
import random
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

from marquee.llm import alignment
from marquee.llm.alignment_queries import BYTE_LEVEL, PIECES, token_alignment

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plain():
    """text -> ((A id, its bytes), ...), ((B id, its bytes), ...)"""
    a = Tokenizer.from_file(BYTE_LEVEL)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    letters = alignment.byte_letters()
    names = {i: bytes(letters[c] for c in p) for p, i in json.load(open(BYTE_LEVEL))["model"]["vocab"].items()}

    def piece(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    return lambda t: ([(i, names[i]) for i in a.encode(" " + t, add_special_tokens=False).ids], [(i, piece(i)) for i in b.encode(t)])


def spans(tokens):
    out, at = [], 0
    for i, x in tokens:
        out.append((i, at, at + len(x)))
        at += len(x)
    return out


def brute(rows, plain):
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, digest) of each row."""
    docs, count = [], Counter()
    for i, t in rows:
        a, b = plain(t) if t else ([], [])
        whole = (" " + (t or "")).encode()
        if not t or b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            a, b = [], []
        a, b = spans(a), spans(b)
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups = [(",".join(str(i) for i, _, e in a if lo < e <= hi), ",".join(str(i) for i, _, e in b if lo < e <= hi))
                  for lo, hi in zip([0, *cuts], cuts)]
        links, j = [], 0
        for x, s, e in a:
            while j < len(b) and b[j][2] <= s:
                j += 1
            k = j
            while k < len(b) and b[k][1] < e:
                links.append((x, b[k][0]))
                k += 1
        count.update(links)
        text = ";".join(f"{p}|{q}" for p, q in groups)
        docs.append((i, len(a), len(b), len(groups), links, hashlib.sha256(text.encode()).hexdigest() if text else ""))
    highest = {}
    for (_, b), n in count.items():
        highest[b] = max(n, highest.get(b, 0))
    return sorted(((i, p, q, g, len(links), sum(count[x] == highest[x[1]] for x in links), sum(count[x] for x in links), d)
                   for i, p, q, g, links, d in docs), key=str)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", range(20))
def test_runs_are_skipped_to_the_same_groups(seed):
    rng = random.Random(seed)
    end = rng.randrange(1, 400)
    a, b = (sorted({rng.randrange(1, end + 1) for _ in range(rng.choice((1, 5, 50, 900)))} | {end}) for _ in range(2))
    both = sorted(set(a) & set(b))
    groups = lambda x, y: tuple(u.tolist() for u in alignment.align(x, y))
    assert groups(a, b) == ([a.index(e) + 1 for e in both], [b.index(e) + 1 for e in both])
    assert groups(a, a) == (list(range(1, len(a) + 1)),) * 2
    assert groups([], []) == ([], [])
    with pytest.raises(ValueError):
        alignment.align(a, [*b, end + 1])


def test_statistics_equal_plain_ones(spark, small_docs, plain):
    some = small_docs.filter("n_chars < 3000")
    got = rows_of(alignment.link_statistics(some, BYTE_LEVEL, PIECES))
    assert got == brute([(r["doc_id"], r["text"]) for r in some.collect()], plain)


def test_blocks_do_not_change_the_result(spark, small_docs, monkeypatch):
    whole = rows_of(token_alignment(spark, SF))
    assert len(whole) == small_docs.count()
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 5000)
    assert rows_of(alignment.link_statistics(small_docs.repartition(7), BYTE_LEVEL, PIECES)) == whole


def test_odd_rows(spark, odd_docs, no_docs, plain):
    odd = odd_docs.filter("doc_id is null or doc_id <> 9").union(spark.createDataFrame(
        [(20, "<|endoftext|> </s>[INST] <s>", None, 0, "", 0.0), (21, "tab\there\r\n  two", None, 0, "", 0.0), (22, "▁marks ▁ inside", None, 0, "", 0.0)],
        odd_docs.schema))
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = rows_of(alignment.link_statistics(odd, BYTE_LEVEL, PIECES))
    assert got == brute(rows, plain)
    by_id = {r[0]: r for r in got}
    assert by_id[3][1:] == by_id[4][1:] == by_id[22][1:] == (0,) * 6 + ("",) and by_id[20][1] > 0
    assert alignment.link_statistics(no_docs, BYTE_LEVEL, PIECES).count() == 0
    long = alignment.link_statistics(odd_docs.filter("doc_id = 9"), BYTE_LEVEL, PIECES).first()
    assert long["n_links"] == long["n_a"] + long["n_b"] - long["n_groups"] > 30_000


def test_groups_of_each_document(spark, small_docs, plain):
    for r in alignment.aligned(small_docs.limit(20), BYTE_LEVEL, PIECES).collect():
        if r["a_ids"]:
            assert r["a_upto"][-1] == len(r["a_ids"]) and r["b_upto"][-1] == len(r["b_ids"])
            assert r["a_upto"] == sorted(set(r["a_upto"])) and r["b_upto"] == sorted(set(r["b_upto"]))
