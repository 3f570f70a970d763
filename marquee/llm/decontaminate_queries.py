"""Query for the benchmark passages."""

from marquee.llm import decontaminate
from marquee.llm.registry import query, table


@query("op9_decontamination")
def decontamination(spark, sf_dir):
    """Every document that holds a benchmark item with at most a tenth of it edited, with the item and the distance."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))
