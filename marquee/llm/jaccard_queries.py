"""Query for the Jaccard join."""

from marquee.llm import jaccard
from marquee.llm.registry import query, table
from marquee.llm.sql import words_sql

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = f"""WITH RECURSIVE w AS (SELECT doc_id, {words_sql(LOWERED)} AS ws FROM documents),
grams AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[p:p + 4], ' ') END AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS p FROM w WHERE len(ws) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
both_in AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM grams a JOIN grams b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM both_in JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
reach(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.doc_id WHERE r.root < l.b)
SELECT doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(root) AS component_id FROM reach LEFT JOIN sizes USING (doc_id) GROUP BY doc_id"""


@query("op3_ngram_jaccard", SQL)
def ngram_jaccard(spark, sf_dir):
    """The group of every document under links of 5-word shingle sets with a score of 0.75 or more."""
    return jaccard.groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
