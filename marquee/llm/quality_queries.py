"""Query for the quality scores."""

from pyspark.sql import functions as F

from marquee.llm import quality
from marquee.llm.registry import query, table


@query("op5_quality")
def quality_scores(spark, sf_dir):
    """A calibrated quality score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = quality.scored(docs, table(spark, sf_dir, "labels"))
    return found.select(
        "doc_id", quality.held_out(F.col("doc_id"), 5, 0).alias("held_out"), F.col("quality_score").alias("score"),
        (F.col("quality_score") >= quality.THRESHOLD).cast("int").alias("predicted"))
