"""Query for exact duplicates."""

from marquee.llm import streamed_dedup
from marquee.llm.registry import query

SQL = f"""WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{streamed_dedup.UPPER}', '{streamed_dedup.LOWER}') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)"""


@query("op11_exact_dedup", SQL)
def exact_dedup(spark, sf_dir):
    """Every document with the document that stays in its place."""
    return streamed_dedup.deduplicated(spark, f"{sf_dir}/documents.parquet")
