"""Quality and toxicity: held-out accuracy, odd rows, missing labels."""

from pyspark.sql import functions as F

from marquee.llm import quality, toxicity
from marquee.llm.quality_queries import quality_scores
from marquee.llm.toxicity_queries import toxicity_scores

DIR = "/root/testdata/sf0.01"


def accuracy(spark, found, label):
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    held = found.filter("held_out").join(labels, "doc_id").select((F.col("predicted") == F.col(label)).cast("int").alias("ok"))
    return held.agg(F.avg("ok")).first()[0]


def test_quality_on_held_out_rows(spark):
    found = quality_scores(spark, DIR).cache()
    assert found.count() == 1000 and found.filter("score between 0 and 1").count() == 1000
    assert accuracy(spark, found, "quality") > 0.9


def test_toxicity_on_held_out_rows(spark):
    found = toxicity_scores(spark, DIR).cache()
    assert found.count() == 1000 and found.filter("score between 0 and 1").count() == 1000
    assert accuracy(spark, found, "toxic") > 0.85


def test_odd_rows_keep_their_columns_and_get_scores(spark, odd_docs, no_docs):
    labels = spark.createDataFrame(
        [(1, 1, 0), (6, 0, 1), (7, None, None), (None, 1, 1), (1, 0, 0)], "doc_id long, quality int, toxic int")
    for scored, column in ((quality.scored, "quality_score"), (toxicity.scored, "toxicity_score")):
        got = scored(odd_docs, labels)
        assert got.columns == [*odd_docs.columns, column]
        rows = got.collect()
        assert len(rows) == 12 and all(0 <= r[column] <= 1 for r in rows)
        assert len({r[column] for r in rows if r["doc_id"] in (1, 2)}) == 1
        assert scored(no_docs, labels).count() == 0
        assert scored(odd_docs, labels.limit(0)).count() == 12
