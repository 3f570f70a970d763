"""Each stage of the pipeline on its own input."""

from brute import brute_cut, brute_groups, words_of

import corpus_pipeline
from marquee.llm import decontaminate
from marquee.session import cut_lineage

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(cut_lineage(stage(spark, seen[-1], SF)))
    assert all(df.columns == docs.columns for df in seen[:-1])
    text = [{r["doc_id"]: r["text"] for r in df.collect()} for df in seen[:-1]]
    assert text[1].items() <= text[0].items() and len(text[1]) > 100
    groups = brute_groups(list(text[1].items()))
    assert text[2] == {i: t for i, t in text[1].items() if groups[i][1] == i}
    cut = {r[0]: r for r in brute_cut(list(text[2].items()))}
    for i, t in text[2].items():
        if cut[i][2] == 0:
            assert text[3][i] == t
        else:
            assert len(words_of(text[3][i])) == cut[i][1] - cut[i][2]
    items = [decontaminate.fold(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert text[4] == {i: t for i, t in text[3].items() if not any(x in decontaminate.fold(t) for x in items)}
    assert {r["doc_id"] for r in seen[5].collect()} == set(text[4])


def test_odd_rows_pass_every_stage(spark, odd_docs):
    from pyspark.sql import functions as F

    docs = odd_docs.select("doc_id", "text", F.lit("en").alias("lang"), "source", F.length("text").cast("long").alias("n_chars"), "shard")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() <= 12, name
        assert stage(spark, docs.limit(0), SF).count() == 0, name
