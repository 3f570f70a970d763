"""Query for the archives."""

from marquee.llm import warc
from marquee.llm.registry import query, table
from marquee.session import cut_lineage

SQL = """WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
firsts AS (SELECT h, min(page_id) AS first_id FROM p GROUP BY h)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((CAST('0x' || substr(h, CAST(5 * j // 4 + 1 AS INTEGER), 2) AS INTEGER) >> (3 - CAST(5 * j % 4 AS INTEGER))) & 31) + 1 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to, url
FROM p JOIN firsts USING (h)"""


@query("op2_warc", SQL)
def archived_pages(spark, sf_dir):
    """All pages written to archives, normalised, and read back through the index."""
    records = warc.deduplicated(table(spark, sf_dir, "pages"), "page_id", "url", "html")
    folder = warc.archive_folder(spark)
    archives = cut_lineage(warc.write_archives(records, folder))
    # One archive per task: each is a single stream, which only one task can inflate.
    entries = cut_lineage(warc.normalise(archives.repartition(max(1, archives.count()))))
    found = warc.read_records(entries.repartition(max(1, entries.count())))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
