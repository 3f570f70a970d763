"""Query for the toxicity scores."""

from pyspark.sql import functions as F

from marquee.llm import toxicity
from marquee.llm.quality import held_out
from marquee.llm.registry import query, table


@query("op6_toxicity")
def toxicity_scores(spark, sf_dir):
    """A toxicity score of every document from weakly supervised labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity.scored(docs, table(spark, sf_dir, "labels"))
    return found.select(
        "doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), F.col("toxicity_score").alias("score"),
        (F.col("toxicity_score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))
