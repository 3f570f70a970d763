"""The stateful stream against plain grouping."""

import hashlib

import pytest
from pyspark.sql import functions as F

from marquee.llm import streamed_dedup

LOWER = str.maketrans(streamed_dedup.UPPER, streamed_dedup.LOWER)
COLUMNS = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def brute(rows):
    """doc ids are unique among kept rows, or repeated rows of which one stays."""
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(LOWER), []).append(i)
    out = []
    for t, ids in groups.items():
        keep = max(ids, key=lambda i: -1 if i is None else i)
        stay = True
        for i in sorted(ids, key=str):
            kept = i == keep and stay
            stay = stay and not kept
            out.append((i, keep, len(ids), kept, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


ROWS = [(k, f"Text number {k % 37}" if k % 3 else "THE same É") for k in range(200)] + [(900, None), (901, ""), (902, " "), (7, "Text number 7")]


@pytest.mark.parametrize("digest", [streamed_dedup.sha256, lambda t: F.substring(F.sha2(t, 256), 1, 1)], ids=["sha256", "colliding"])
def test_equal_texts(spark, tmp_path, digest):
    spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents")
    assert found(streamed_dedup.deduplicated(spark, f"{tmp_path}/documents", digest=digest)) == brute(ROWS)


def test_state_goes_on_from_its_checkpoint(spark, tmp_path):
    path, checkpoint = f"{tmp_path}/documents", f"{tmp_path}/state"
    seen = []
    for part in (ROWS[:80], ROWS[80:81], ROWS[81:]):
        spark.createDataFrame(part, "doc_id long, text string").coalesce(1).write.mode("append").parquet(path)
        seen += part
        assert found(streamed_dedup.deduplicated(spark, path, checkpoint)) == brute(seen)
    held = streamed_dedup.state(spark, checkpoint)
    assert held.agg(F.sum("n")).first()[0] == len(ROWS)
    assert held.count() == len({(t or "").translate(LOWER) for _, t in ROWS})


def test_odd_rows(spark, odd_docs, no_docs, tmp_path):
    clash = odd_docs.withColumn("_metadata", F.lit("own")).withColumn("digest", F.lit(1)).withColumn("locator", F.lit(2))
    for name, df in (("odd", clash), ("none", no_docs)):
        df.write.parquet(f"{tmp_path}/{name}")
        rows = [(r["doc_id"], r["text"]) for r in df.collect()]
        assert found(streamed_dedup.deduplicated(spark, f"{tmp_path}/{name}")) == brute(rows)
