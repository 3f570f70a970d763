"""Query for the fingerprints."""

from pyspark.sql import functions as F

from marquee.llm.fingerprints import as_hex, edited_fingerprints, with_near_queries
from marquee.llm.registry import query, table


@query("op1_fingerprints")
def fingerprints(spark, sf_dir):
    """Fingerprints of all documents and their edited texts, with the near query documents."""
    found = with_near_queries(edited_fingerprints(table(spark, sf_dir, "documents")))
    return found.select(
        "doc_id", "n_chars", "edited_sha256", as_hex(F.col("print")).alias("fingerprint"),
        as_hex(F.col("edited_print")).alias("edited_fingerprint"), "near_edited", "near_next",
        "near_queries", "nearest_query")
