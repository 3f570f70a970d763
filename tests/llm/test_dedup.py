"""Jaccard join and substring removal against brute force."""

import random

import numpy as np
import pytest
from brute import brute_cut, brute_groups

from marquee.llm import jaccard, substring
from marquee.llm.fm_index import FMIndex, interval_minima
from marquee.llm.substring_queries import substring_dedup


def near_group(n=60, size=60, seed=5):
    """Copies of one text with a few words changed each, among unrelated texts that share a passage."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base, passage = [word() for _ in range(size)], " ".join(word() for _ in range(20))
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(size)] = word()
        rows.append((i, " ".join(w)))
    rows += [(n + i, passage + " " + " ".join(word() for _ in range(rng.randrange(1, 40)))) for i in range(n)]
    return rows


def test_groups_of_near_copies(spark):
    rows = near_group()
    got = jaccard.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_groups(rows)


def test_groups_of_odd_rows(odd_docs, no_docs):
    got = sorted(map(tuple, jaccard.groups(odd_docs).collect()), key=str)
    by_id = {r[0]: r[1:] for r in got}
    assert len(got) == odd_docs.count()
    assert by_id[1] == by_id[2] == by_id[None] == by_id[10] == (14, 1)
    assert by_id[3] == (0, 3) and by_id[4] == (0, 4) and by_id[5] == (0, 5)
    assert by_id[6] == by_id[7] == (1, 6)
    assert by_id[9] == (1, 9)
    assert jaccard.groups(no_docs).count() == 0


def test_cut_equals_brute_force_on_odd_rows(spark, odd_docs, no_docs, tmp_path):
    for name, df in (("odd", odd_docs), ("none", no_docs)):
        df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = sorted(map(tuple, substring_dedup(spark, f"{tmp_path}/{name}").collect()), key=str)
        assert got == brute_cut([(r["doc_id"], r["text"]) for r in df.collect()])


def test_cut_equals_brute_force_with_hot_passages(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(substring, "HOT_SHARE", 1e-9)  # every anchor of 64 documents and more is hot
    rows = near_group(150)
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, substring_dedup(spark, str(tmp_path)).collect()), key=str)
    assert got == brute_cut(rows)


@pytest.mark.parametrize("seed", range(5))
def test_fm_index(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(13, 50, size=rng.integers(1, 25))
    codes = rng.integers(0, rng.integers(1, 5), size=lengths.sum())
    index = FMIndex(codes, lengths, 13)
    begins = np.concatenate([s + np.arange(n - 12) for s, n in zip(index.starts, lengths)])
    low, high = index.search(begins, 13)
    patterns = [tuple(index.text[b:b + 13]) for b in begins]
    assert all(h - lo == patterns.count(p) for lo, h, p in zip(low, high, patterns))
    values = rng.integers(0, 99, len(index.text))
    assert list(interval_minima(values, low, high)) == [values[a:b].min() for a, b in zip(low, high)]
