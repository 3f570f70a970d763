"""Query for the shards."""

from pyspark.sql import functions as F

from marquee.llm.registry import query, table
from marquee.llm.sharding import assign


@query("op4_sharding")
def sharding(spark, sf_dir):
    """All documents in 40 shards of near equal bytes."""
    placed = assign(table(spark, sf_dir, "documents"), shards=40)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
