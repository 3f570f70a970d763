"""Ranked search against a plain version."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from marquee.llm import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    counted = [(i, Counter(plain_terms(t))) for i, t in docs]
    n_docs, n_terms = sum(1 for _, c in counted if c), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, Counter()).update(plain_terms(t))
    out = []
    for item, q in wanted.items():
        scored = []
        for i, c in counted:
            m = 25 + (75 * sum(c.values()) * n_docs) // n_terms if n_terms else 0
            s = sum(x * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                    for t, x in q.items() if t in c)
            if s > 0:
                scored.append((-s, i is None, i))
        scored.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(scored[:k])]
    return sorted(out, key=str)


def rows_of(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, df.collect()), key=str)


def made(seed, docs, words, longest):
    rng = random.Random(seed)
    word = lambda: f"w{min(rng.randrange(words), rng.randrange(words))}"
    text = lambda: " ".join(rng.choice((str.upper, str))(word()) for _ in range(rng.randrange(longest)))
    return [(i, text()) for i in rng.sample(range(10 * docs), docs)]


@pytest.mark.parametrize("tiles", [(1 << 18, 1 << 13, 256, 1024, 2048), (60, 20, 3, 7, 5)])
def test_equals_plain_version(spark, monkeypatch, tiles):
    for name, value in zip(("BLOCK_TERMS", "TILE_TERMS", "TILE_ITEMS", "TILE_DOCS", "PANEL"), tiles):
        monkeypatch.setattr(ranked, name, value)
    docs = made(1, 150, 60, 40)
    docs += [(i + 5000, t) for i, t in docs[:40]] + [(6000 + i, "same words here w1") for i in range(60)]  # ties
    items = made(2, 12, 60, 30) + [(1000, "same here"), (1001, None), (1002, "nowhere"), (1003, "w1 " * 500)]
    docs_df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = rows_of(ranked.search(docs_df, spark.createDataFrame(items, "item_id long, text string"), k=10))
    assert got == brute(docs, items, 10)


def test_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame(
        [(1, "fox word É ok", "x"), (1, "two", "x"), (None, "one", "x"), (2, None, "x"), (3, "", "x")], "item_id long, text string, doc_id string")
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert rows_of(ranked.search(odd_docs, items)) == brute(rows, [(r["item_id"], r["text"]) for r in items.collect()], 10)
    assert ranked.search(no_docs, items).count() == 0 and ranked.search(odd_docs, items.limit(0)).count() == 0
    blank = spark.createDataFrame([(1, " .,"), (2, None)], "doc_id long, text string")
    assert ranked.search(blank, items).count() == 0


def test_large_weights_are_exact():
    weights = [{0: (1 << 41) + 7, 1: 3, 5: (1 << 20) - 1}, {1: 1 << 25}]
    tile = ranked.Tile(weights)
    term, impact = np.array([0, 1, 5, 1]), np.array([999_999, 999_998, 12_345, 1])
    got = tile.scores(np.array([0, 0, 0, 1]), term, impact, 2)
    want = [[sum(w.get(t, 0) * x for t, x in d) for d in ([(0, 999_999), (1, 999_998), (5, 12_345)], [(1, 1)])] for w in weights]
    assert got.tolist() == want
