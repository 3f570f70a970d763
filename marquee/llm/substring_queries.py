"""Query for the removal of repeated passages."""

from pyspark.sql import functions as F

from marquee.llm import substring
from marquee.llm.fingerprints import words
from marquee.llm.registry import query, table
from marquee.llm.sql import words_sql

SQL = f"""WITH w AS (SELECT doc_id, {words_sql("coalesce(text, '')")} AS ws FROM documents),
win AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS p FROM w),
grams AS (SELECT doc_id, p, array_to_string(ws[p:p + 12], ' ') AS g FROM win),
firsts AS (SELECT g, min(doc_id) AS first_id FROM grams GROUP BY g),
hit AS (SELECT doc_id, p FROM grams JOIN firsts USING (g) WHERE first_id < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS i FROM hit),
each AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
kept AS (SELECT doc_id, string_agg(ws[i], ' ' ORDER BY i) AS kept FROM each ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
lost AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id)"""


@query("op7_substring_dedup", SQL)
def substring_dedup(spark, sf_dir):
    """What stays of every document when windows of 13 words that an earlier one has are removed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = substring.repeats(docs)
    split = words(F.coalesce("text", F.lit("")))
    whole = docs.select(
        "doc_id", substring.row_key().alias("row"), F.size(split).cast("long").alias("n_words"),
        F.sha2(F.array_join(split, " "), 256).alias("whole_sha256"))
    return whole.join(cut, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce(F.sha2("kept", 256), "whole_sha256").alias("kept_sha256"))
