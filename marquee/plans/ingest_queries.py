"""Queries over upserts, lifecycle, editorial work, logs and validation."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import functions as F

from marquee.functions import hashes, text
from marquee.functions.clock import is_fresh
from marquee.operators import (
    editorial as E, lifecycle as Z, listing as L, logs, resolve as R, upsert as U, validate as V,
)
from marquee.plans import extract_queries
from marquee.plans.listing_queries import ELECTION
from marquee.plans.registry import query
from marquee.plans.views import NOW, NOW_SQL
from marquee.session import shared_folder
from marquee.sources import classify, structured
from marquee.streaming import ingest

KEYS = ["source_id", "source_event_id"]
GATE = (datetime(1995, 1, 1, tzinfo=timezone.utc), datetime(1998, 6, 20, tzinfo=timezone.utc))
GATE_SQL = "start_at <= TIMESTAMP '1998-06-20 00:00:00' AND coalesce(end_at, start_at) >= TIMESTAMP '1995-01-01 00:00:00'"


def plan(t):
    return U.plan_upsert(t.listings(), t.incoming(), KEYS, NOW, U.window_gate(*GATE), identity=("id", "canonical_id"))


_PLAN = f"""o AS (SELECT i.*, l.id AS old_id, l.content_hash AS old_hash, {GATE_SQL.replace('start_at', 'i.start_at').replace('end_at', 'i.end_at')} AS inside
  FROM v_incoming i LEFT JOIN v_listings l USING (source_id, source_event_id)),
plan AS (SELECT *, CASE WHEN old_hash = content_hash THEN 'hash_match' WHEN NOT inside THEN 'out_of_window' END AS reason,
  CASE WHEN old_hash = content_hash OR NOT inside THEN 'skipped' WHEN old_id IS NULL THEN 'inserted' ELSE 'updated' END AS outcome FROM o)"""


@query("upsert_outcomes", f"WITH {_PLAN} SELECT source_id, source_event_id, outcome, reason FROM plan")
def upsert_outcomes(t):
    return plan(t).filter("outcome is not null").select(*KEYS, "outcome", "reason")


_RESULT = f"""WITH {_PLAN}
SELECT l.id, l.source_event_id, coalesce(CASE WHEN outcome = 'updated' THEN p.title END, l.title) AS title,
  coalesce(CASE WHEN outcome = 'updated' THEN p.start_at END, l.start_at) AS start_at,
  CASE WHEN outcome = 'updated' OR reason = 'hash_match' THEN {NOW_SQL} ELSE l.last_seen_at END AS last_seen_at
FROM v_listings l LEFT JOIN plan p USING (source_id, source_event_id)
UNION ALL SELECT id, source_event_id, title, start_at, {NOW_SQL} FROM plan WHERE outcome = 'inserted'"""


@query("upsert_result", _RESULT)
def upsert_result(t):
    return U.applied(plan(t)).select("id", "source_event_id", "title", "start_at", "last_seen_at")


@query("stream_equals_batch", _RESULT)
def stream_equals_batch(t):
    """The same batch in three micro-batches over a table split by month."""
    root = f"{shared_folder(t.spark)}/marquee-stream-{uuid.uuid4().hex}"
    stored, batch = t.listings(), t.incoming().withColumn("arrival", F.col("id"))
    ingest.start_table(stored, f"{root}/table", pattern="yyyy-MM")
    batch.withColumn("third", F.col("id") % 3).write.partitionBy("third").parquet(f"{root}/in")
    files = len(t.spark.read.schema(batch.schema).parquet(f"{root}/in").inputFiles())
    stream = ingest.file_stream(t.spark, f"{root}/in", batch.schema, files_per_trigger=-(-files // 3))
    ingest.start_upserts(
        stream, f"{root}/table", f"{root}/checkpoint", stored.schema, KEYS, "arrival", lambda: NOW, ("id", "canonical_id"),
        U.window_gate(*GATE), pattern="yyyy-MM").awaitTermination()
    return ingest.read_table(t.spark, f"{root}/table", stored.schema).select("id", "source_event_id", "title", "start_at", "last_seen_at")


@query("upsert_duplicate_keys", f"""WITH {_PLAN}
SELECT l.id, coalesce(CASE WHEN outcome = 'updated' THEN 'later ' || p.title END, l.title) AS title
FROM v_listings l LEFT JOIN plan p USING (source_id, source_event_id)
UNION ALL SELECT id, 'later ' || title FROM plan WHERE outcome = 'inserted'""")
def upsert_duplicate_keys(t):
    one = t.incoming().withColumn("came", F.lit(1))
    two = one.withColumns({"title": F.concat(F.lit("later "), "title"), "came": F.lit(2)})
    rows = U.plan_upsert(t.listings(), two.unionByName(one), KEYS, NOW, U.window_gate(*GATE),
                         identity=("id", "canonical_id"), arrival="came")
    return U.applied(rows).select("id", "title")


@query("upsert_run_stats", f"""WITH {_PLAN} SELECT source_id, count(*) AS seen, count(*) FILTER (WHERE outcome = 'inserted') AS inserted,
  count(*) FILTER (WHERE outcome = 'updated') AS updated, count(*) FILTER (WHERE outcome = 'skipped') AS skipped FROM plan GROUP BY ROLLUP (source_id)""")
def upsert_run_stats(t):
    return U.run_stats(plan(t))


@query("run_stats_structured", f"""WITH {_PLAN}, hit AS (SELECT source_id, count(*) AS n FROM v_listings WHERE id % 4 <> 3 AND id % 7 <> 5 GROUP BY ROLLUP (source_id)),
st AS (SELECT source_id, count(*) AS seen, count(*) FILTER (WHERE outcome = 'updated') AS updated FROM plan GROUP BY ROLLUP (source_id))
SELECT st.source_id, seen, updated, coalesce(n, 0) AS structured_hits FROM st LEFT JOIN hit ON hit.source_id IS NOT DISTINCT FROM st.source_id""")
def run_stats_structured(t):
    """Run counters with the items whose page gave a structured event."""
    pages = extract_queries.jsonld_pages(t)
    found = structured.structured_or_text(
        pages, extract_queries.jsonld(t), pages.select("id", F.lit("").alias("reduced")), ["id"])
    paths = found.join(t.listings("id", "source_id"), "id")
    return U.run_stats(plan(t), paths=paths).select("source_id", "seen", "updated", "structured_hits")


@query("source_status", f"""WITH {_PLAN}, r AS (SELECT source_id, bool_or(source_id % 7 = 3) AS failed FROM plan GROUP BY source_id)
SELECT source_id, CASE WHEN failed IS NOT NULL THEN {NOW_SQL} END AS last_run_at, CASE WHEN failed THEN 'error: HTTP 503' WHEN NOT failed THEN 'ok' END AS last_status,
  CASE WHEN failed THEN 'HTTP 503' END AS last_error FROM v_sources LEFT JOIN r USING (source_id)""")
def source_status(t):
    errors = t.sources().filter("source_id % 7 = 3").select("source_id", F.lit("HTTP 503").alias("error"))
    runs = U.run_log(plan(t), NOW, NOW, errors)
    return U.source_status(t.sources(), runs).select("source_id", "last_run_at", "last_status", "last_error")


@query("run_log_rows", f"""WITH {_PLAN}, e AS (SELECT source_id, 'HTTP 503' AS error FROM v_sources WHERE source_id % 7 = 3)
SELECT source_id, count(*) AS seen, error, CASE WHEN error IS NULL THEN 'ok' ELSE 'error: ' || error END AS status
FROM plan LEFT JOIN e USING (source_id) GROUP BY source_id, error""")
def run_log_rows(t):
    errors = t.sources().filter("source_id % 7 = 3").select("source_id", F.lit("HTTP 503").alias("error"))
    return U.run_log(plan(t), NOW, NOW, errors).select("source_id", "seen", "error", "status")


@query("batch_last_per_key", "SELECT l_orderkey AS k, l_suppkey AS s, max(l_partkey) AS p FROM lineitem GROUP BY ALL")
def batch_last_per_key(t):
    rows = t.raw("lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p"))
    return U.last_per_key(rows, ["k", "s"], "p")


@query("first_sixty_per_source", "SELECT source_id, id, row_number() OVER (PARTITION BY source_id ORDER BY id) AS pos FROM v_listings QUALIFY pos <= 60")
def first_sixty_per_source(t):
    return U.first_per_source(t.listings("source_id", "id"), limit=60).select("source_id", "id", "pos")


@query("listing_pages_first_per_url", """WITH p AS (SELECT image_url AS url, id % 3 AS page, id AS pos FROM v_listings WHERE image_url LIKE 'http%'
  UNION ALL SELECT image_url, 3, id FROM v_listings WHERE image_url LIKE 'http%' AND id % 2 = 0)
SELECT url, page, pos FROM p QUALIFY row_number() OVER (PARTITION BY url ORDER BY page, pos) = 1""")
def listing_pages_first_per_url(t):
    rows = t.listings("id", "image_url").filter("image_url like 'http%'")
    pages = rows.select(F.col("image_url").alias("url"), (F.col("id") % 3).alias("page"), F.col("id").alias("pos")).unionByName(
        rows.filter("id % 2 = 0").select(F.col("image_url").alias("url"), F.lit(3).cast("bigint").alias("page"), F.col("id").alias("pos")))
    first = F.min(F.struct("page", "pos"))
    return pages.groupBy("url").agg(first.alias("f")).select("url", "f.page", "f.pos")


@query("source_upsert", """SELECT coalesce(s.source_slug, a.slug) AS source_slug, coalesce(source_id, CAST('0x' || substr(md5(a.slug), 1, 15) AS BIGINT)) AS source_id,
  coalesce(a.label, s.source_label) AS source_label, CASE WHEN a.slug IS NOT NULL THEN 'https://x.example.com' END AS base_url, coalesce(enabled, true) AS enabled
FROM v_sources s FULL JOIN (SELECT 'src_' || (s_suppkey * 2) AS slug, 'New ' || s_name AS label FROM supplier) a ON a.slug = s.source_slug""")
def source_upsert(t):
    adapters = t.raw("supplier").select(
        F.concat(F.lit("src_"), F.col("s_suppkey") * 2).alias("source_slug"),
        F.concat(F.lit("New "), "s_name").alias("source_label"), F.lit("https://x.example.com").alias("base_url"))
    stored = t.sources().withColumn("base_url", F.lit(None).cast("string"))
    return U.upsert_sources(stored, adapters).select("source_slug", "source_id", "source_label", "base_url", "enabled")


@query("place_upsert", f"""WITH b AS (SELECT id, name, id % 3 AS m FROM v_places WHERE id % 4 <> 0),
p AS (SELECT *, id + 1 AS h FROM v_places)
SELECT slug, p.name || CASE WHEN m IN (1, 2) THEN ' v2' ELSE '' END AS name, CASE WHEN m IS NULL THEN NULL WHEN m = 0 THEN 'skipped' ELSE 'updated' END AS outcome
FROM p LEFT JOIN b USING (id)""")
def place_upsert(t):
    digest = hashes.place_hash(F.col("name"), F.col("city"), F.col("address"), F.col("web_rating"), F.col("web_review_count"))
    stored = t.places().withColumn("source_id", F.lit(1)).withColumn("content_hash", digest)
    renamed = F.when(F.col("id") % 3 != 0, F.concat("name", F.lit(" v2"))).otherwise(F.col("name"))
    # Phone changes are outside the hash: those rows stay as they are.
    batch = (t.places().filter("id % 4 <> 0").withColumn("source_id", F.lit(1)).withColumn("name", renamed)
             .withColumn("phone_number", F.lit("x")).withColumn("content_hash", digest))
    return U.plan_upsert(stored, batch, ["source_id", "slug"], NOW).select("slug", "name", "outcome")


@query("touched_source", f"SELECT id, CASE WHEN source_id = 3 THEN {NOW_SQL} ELSE last_seen_at END AS last_seen_at FROM v_listings")
def touched_source(t):
    return U.touch(t.listings("id", "source_id", "last_seen_at"), 3, NOW).select("id", "last_seen_at")


# --- lifecycle -------------------------------------------------------------

_GONE = f"gone AS (SELECT id FROM v_listings WHERE coalesce(end_at, start_at) < {NOW_SQL} - INTERVAL 14 DAY)"


def _clean(t):
    events = t.listings("id", "canonical_id", "start_at", "end_at")
    before = {"events": events, "metrics": t.metrics(), "groups": t.canonicals().select("canonical_id")}
    return before, Z.clean_expired(*before.values(), NOW)


@query("expired_events", f"WITH {_GONE} SELECT id FROM gone")
def expired_events(t):
    return t.listings("id", "start_at", "end_at").filter(Z.expired(NOW)).select("id")


@query("expiry_kept_metrics", f"WITH {_GONE} SELECT metric_id, action FROM v_metrics WHERE event_id NOT IN (SELECT id FROM gone)")
def expiry_kept_metrics(t):
    return _clean(t)[1]["metrics"].select("metric_id", "action")


@query("expiry_kept_groups", f"""WITH {_GONE} SELECT canonical_id FROM v_canonical c WHERE NOT EXISTS (SELECT 1 FROM gone)
OR EXISTS (SELECT 1 FROM v_listings l WHERE l.canonical_id = c.canonical_id AND l.id NOT IN (SELECT id FROM gone))""")
def expiry_kept_groups(t):
    return _clean(t)[1]["groups"]


@query("expiry_deleted_counts", f"""WITH {_GONE} SELECT 'events' AS "table", count(*) AS deleted FROM gone
UNION ALL SELECT 'metrics', count(*) FROM v_metrics WHERE event_id IN (SELECT id FROM gone)
UNION ALL SELECT 'groups', (SELECT count(*) FROM v_canonical) - count(DISTINCT canonical_id) FROM v_listings WHERE id NOT IN (SELECT id FROM gone)""")
def expiry_deleted_counts(t):
    return Z.deleted_counts(*_clean(t))


@query("stale_place_cleanup", f"""SELECT p.id, (SELECT count(*) FROM v_metrics m WHERE m.event_id = p.id) AS metrics FROM v_places p WHERE last_seen_at >= {NOW_SQL} - INTERVAL 90 DAY""")
def stale_place_cleanup(t):
    metrics = t.metrics().withColumn("place_id", F.col("event_id"))
    left = Z.clean_stale_places(t.places(), metrics, NOW)
    counts = left["metrics"].groupBy(F.col("place_id").alias("id")).agg(F.count("*").alias("metrics"))
    return left["places"].select("id").join(counts, "id", "left").na.fill(0, ["metrics"])


@query("reference_set_null", """SELECT id, CASE WHEN canonical_id % 5 = 0 THEN NULL ELSE canonical_id END AS canonical_id FROM v_listings""")
def reference_set_null(t):
    gone = t.canonicals().filter("canonical_id % 5 = 0").select("canonical_id")
    return Z.set_null(t.listings("id", "canonical_id"), gone, "canonical_id")


@query("source_delete_cascade", "WITH n AS (SELECT count(*) AS n FROM supplier) SELECT o_orderkey AS id, o_orderkey % n AS source_id FROM orders, n WHERE o_orderkey % n <> 4")
def source_delete_cascade(t):
    return Z.delete_source(4, t.sources(), {"events": t.listings("id", "source_id")})["events"].select("id", "source_id")


# --- editorial -------------------------------------------------------------


def members(t):
    rows = t.listings("id", "source_id", "canonical_id", "title", "description", "categories", "start_at", "image_url", "venue_name", "city")
    return rows.filter("canonical_id is not null").join(t.sources().filter("enabled"), "source_id")


def primaries(t):
    rows = members(t)
    ids = R.elect_primary(rows).select(F.col("primary_id").alias("id"))
    return rows.join(ids, "id").select("canonical_id", "title", "description", "categories", "venue_name", "city", "start_at")


_MEM = f"""mem AS (SELECT * FROM v_listings JOIN v_sources USING (source_id) WHERE enabled AND canonical_id IS NOT NULL),
prim AS (SELECT * FROM mem QUALIFY row_number() OVER (PARTITION BY canonical_id ORDER BY {ELECTION}) = 1),
t1 AS (SELECT canonical_id, title AS v, min((start_at, id)) AS o FROM mem GROUP BY ALL),
t2 AS (SELECT *, row_number() OVER (PARTITION BY canonical_id ORDER BY o, v) AS n FROM t1 QUALIFY n <= 8),
d1 AS (SELECT canonical_id, description AS v, min((start_at, id)) AS o FROM mem WHERE length(description) >= 20 GROUP BY ALL),
d2 AS (SELECT *, row_number() OVER (PARTITION BY canonical_id ORDER BY o, v) AS n FROM d1 QUALIFY n <= 8),
h0 AS (SELECT canonical_id, start_at, id, unnest(categories) AS v, generate_subscripts(categories, 1) AS p FROM mem),
h1 AS (SELECT canonical_id, v, min((start_at, id, p)) AS o FROM h0 GROUP BY canonical_id, v),
h2 AS (SELECT *, row_number() OVER (PARTITION BY canonical_id ORDER BY o, v) AS n FROM h1 QUALIFY n <= 8)"""


@query("editorial_inputs", f"""WITH {_MEM}
SELECT canonical_id, (SELECT string_agg(v, '|' ORDER BY n) FROM t2 WHERE t2.canonical_id = m.canonical_id) AS titles,
  coalesce((SELECT string_agg(v, '|' ORDER BY n) FROM d2 WHERE d2.canonical_id = m.canonical_id), '') AS descriptions,
  (SELECT string_agg(v, '|' ORDER BY n) FROM h2 WHERE h2.canonical_id = m.canonical_id) AS hints,
  string_agg(DISTINCT source_slug, '|' ORDER BY source_slug) AS slugs FROM mem m GROUP BY canonical_id""")
def editorial_inputs(t):
    return E.editorial_inputs(members(t)).select(
        "canonical_id", *[F.array_join(c, "|").alias(c) for c in ("titles", "descriptions", "hints")],
        F.array_join("source_slugs", "|").alias("slugs"))


@query("curation_requests", f"""WITH {_MEM}
SELECT p.canonical_id, 'Canonical ID: ' || p.canonical_id || chr(10) || 'Source slugs: ' || (SELECT string_agg(DISTINCT source_slug, ', ' ORDER BY source_slug) FROM mem m WHERE m.canonical_id = p.canonical_id)
 || chr(10) || 'Venue: ' || venue_name || chr(10) || 'City: ' || city || chr(10) || 'Start (ISO): ' || strftime(start_at, '%Y-%m-%dT%H:%M:%S.%gZ') || chr(10)
 || 'Category hints: ' || (SELECT string_agg(v, ', ' ORDER BY n) FROM h2 WHERE h2.canonical_id = p.canonical_id) || chr(10) || chr(10) || 'Title variants:' || chr(10)
 || (SELECT string_agg(n || '. ' || v, chr(10) ORDER BY n) FROM t2 WHERE t2.canonical_id = p.canonical_id) || chr(10) || chr(10) || 'Source descriptions:' || chr(10)
 || coalesce((SELECT string_agg(n || '. ' || v, chr(10) ORDER BY n) FROM d2 WHERE d2.canonical_id = p.canonical_id), '1. (No description text provided by upstream sources.)') AS request
FROM prim p""")
def curation_requests(t):
    return E.curation_request(E.editorial_inputs(members(t)).drop("venue_name"), primaries(t))


def _curated(t):
    key = F.col("canonical_id")
    return t.canonicals().filter("canonical_id % 3 <> 1").select(
        "canonical_id", F.concat(F.lit("Curated "), key).alias("deduped_title"),
        F.when(key % 9 == 0, F.repeat(F.lit("long "), 40)).otherwise(F.concat(F.lit("Summary "), key)).alias("summary"),
        F.array(F.lit("lively"), F.lit("lively")).alias("vibes"), F.lit("kids").alias("audience"), F.lit("indoor").alias("indoor_outdoor"),
        F.array(F.lit("Movies"), F.lit("R&B")).alias("tags"), F.lit("why").alias("why_its_cool"), F.lit(0.75).alias("editorial_score"))


_FALL = "array_to_string(CASE WHEN true THEN [x] END, '')"


@query("editorial_refresh", f"""WITH {_MEM}
SELECT p.canonical_id, p.canonical_id % 4 <> 2 AS refreshed,
  CASE WHEN p.canonical_id % 4 = 2 THEN NULL WHEN p.canonical_id % 3 <> 1 AND p.canonical_id % 9 <> 0 THEN 'Curated ' || p.canonical_id ELSE title END AS deduped_title,
  CASE WHEN p.canonical_id % 4 = 2 THEN NULL WHEN p.canonical_id % 3 <> 1 AND p.canonical_id % 9 <> 0 THEN 'Summary ' || p.canonical_id ELSE coalesce(description, title) END AS summary,
  CASE WHEN p.canonical_id % 4 = 2 THEN NULL WHEN p.canonical_id % 3 <> 1 AND p.canonical_id % 9 <> 0 THEN 'film|music' END AS curated_tags,
  CASE WHEN p.canonical_id % 4 = 2 THEN NULL WHEN p.canonical_id % 3 <> 1 AND p.canonical_id % 9 <> 0 THEN 0.75 ELSE 0.5 END AS editorial_score FROM prim p""")
def editorial_refresh(t):
    inputs = E.editorial_inputs(members(t))
    stored = inputs.filter("canonical_id % 4 = 2").select("canonical_id", "editorial_hash").unionByName(
        t.canonicals().filter("canonical_id % 4 <> 2").select("canonical_id", F.lit("old").alias("editorial_hash")))
    out = E.refresh_groups(stored, inputs, primaries(t), _curated(t), NOW)
    return out.select(
        "canonical_id", "refreshed", "deduped_title", "summary",
        F.when(F.col("editorial_score") == 0.75, F.array_join("tags", "|")).alias("curated_tags"), "editorial_score")


@query("editorial_hash_changes", """WITH a AS (SELECT canonical_id, count(*) AS n, bool_or(id % 97 = 0) AS touched FROM v_listings JOIN v_sources USING (source_id) WHERE enabled AND canonical_id IS NOT NULL GROUP BY 1)
SELECT canonical_id, touched AS changed FROM a""")
def editorial_hash_changes(t):
    rows = members(t)
    before = E.row_set_hash("canonical_id", rows, "source_slug", "title", "description")
    moved = rows.withColumn("title", F.when(F.col("id") % 97 == 0, F.concat("title", F.lit("!"))).otherwise(F.col("title")))
    after = E.row_set_hash("canonical_id", moved.orderBy(F.desc("id")), "source_slug", "title", "description")
    return before.withColumnRenamed("editorial_hash", "old").join(after, "canonical_id").select(
        "canonical_id", (F.col("old") != F.col("editorial_hash")).alias("changed"))


@query("curations_valid", "SELECT canonical_id FROM v_canonical WHERE canonical_id % 3 <> 1 AND canonical_id % 9 <> 0")
def curations_valid(t):
    return _curated(t).filter(E.valid_curation()).select("canonical_id")


@query("place_requests", """SELECT id, array_to_string(list_filter(['Place: ' || name, 'Category: ' || category, 'City: ' || city, CASE WHEN address <> '' THEN 'Address: ' || address END,
 CASE WHEN description <> '' THEN 'Description: ' || description END, 'Web Rating: ' || web_rating || '/5', 'Review Count: ' || web_review_count], lambda x: x IS NOT NULL), chr(10) || chr(10)) AS request FROM v_places""")
def place_requests(t):
    return t.places().select("id", E.place_request().alias("request"))


_CHANGED = "(id % 97 = 0 OR id % 89 = 0 OR id % 101 = 0)"


@query("editorial_hash_incremental", f"""WITH m AS (SELECT id, canonical_id FROM v_listings JOIN v_sources USING (source_id) WHERE enabled AND canonical_id IS NOT NULL),
after AS (SELECT id, CASE WHEN id % 89 = 0 THEN canonical_id + 1 ELSE canonical_id END AS canonical_id FROM m WHERE id % 101 <> 0),
touched AS (SELECT canonical_id FROM m WHERE {_CHANGED} UNION SELECT canonical_id FROM after WHERE {_CHANGED})
SELECT canonical_id, canonical_id IN (SELECT canonical_id FROM touched) AS touched, true AS as_in_full FROM after GROUP BY canonical_id""")
def editorial_hash_incremental(t):
    """Stored lanes brought up to date by changed, moved and deleted members, next to the hash of all members."""
    rows = members(t)
    changed = rows.filter(_CHANGED)
    title = F.when(F.col("id") % 97 == 0, F.concat("title", F.lit("!"))).otherwise(F.col("title"))
    group = F.when(F.col("id") % 89 == 0, F.col("canonical_id") + 1).otherwise(F.col("canonical_id"))
    later = lambda df: df.filter("id % 101 <> 0").withColumns({"title": title, "canonical_id": group})
    fresh = E.lanes_after(E.group_lanes(rows), changed, later(changed)).select("canonical_id", F.col("editorial_hash").alias("new"))
    old = E.editorial_inputs(rows).select("canonical_id", F.col("editorial_hash").alias("old"))
    full = E.editorial_inputs(later(rows)).select("canonical_id", "editorial_hash")
    joined = full.join(fresh, "canonical_id", "left").join(old, "canonical_id", "left")
    return joined.select(
        "canonical_id", F.col("new").isNotNull().alias("touched"), (F.coalesce("new", "old") == F.col("editorial_hash")).alias("as_in_full"))


@query("place_editorial_refresh", """WITH b AS (SELECT *, id % 5 <> 0 AS refreshed, id % 2 = 0 AS has FROM v_places)
SELECT id, refreshed, CASE WHEN NOT refreshed THEN summary WHEN has THEN 'C ' || id ELSE coalesce(description, name) END AS summary,
 round(CASE WHEN NOT refreshed THEN editorial_score ELSE CASE WHEN web_rating = 0 THEN (CASE WHEN has THEN 0.9 ELSE 0.5 END) * 0.85 ELSE
   least(1, (CASE WHEN has THEN 0.9 ELSE 0.5 END) * 0.5 + web_rating / 5 * 0.35 + CASE WHEN web_review_count = 0 THEN 0 ELSE least(1, log2(web_review_count + 1) / log2(200)) * 0.15 END) END END, 6) AS editorial_score FROM b""")
def place_editorial_refresh(t):
    places = t.places().withColumn("editorial_hash", F.when(F.col("id") % 5 == 0, E.place_editorial_hash()).otherwise("old"))
    curated = t.places().filter("id % 2 = 0").select(
        "id", F.concat(F.lit("C "), "id").alias("c_summary"), F.array(F.lit("brunch")).alias("c_vibes"),
        F.array(F.lit("x")).alias("c_tags"), F.lit("y").alias("c_why"), F.lit(0.9).alias("c_score"))
    return E.refresh_places(places, curated, NOW).select("id", "refreshed", "summary", F.round("editorial_score", 6).alias("editorial_score"))


@query("fresh_editorials", f"SELECT canonical_id, coalesce(editorial_updated_at >= {NOW_SQL} - INTERVAL 48 HOUR, false) AS fresh FROM v_canonical")
def fresh_editorials(t):
    return t.canonicals().select("canonical_id", is_fresh(F.col("editorial_updated_at"), F.lit(NOW)).alias("fresh"))


# --- logs ------------------------------------------------------------------

_VALID = "action IN ('view_event', 'open_ticket_link', 'add_to_plan', 'save_event')"


@query("metrics_accepted", f"SELECT metric_id, session_id, action FROM v_metrics WHERE {_VALID}")
def metrics_accepted(t):
    return logs.accepted_metrics(t.metrics()).select("metric_id", "session_id", "action")


@query("action_counts", f"SELECT action, CAST(CAST(created_at AS DATE) AS VARCHAR) AS day, count(*) AS n FROM v_metrics WHERE {_VALID} GROUP BY CUBE (action, CAST(CAST(created_at AS DATE) AS VARCHAR))")
def action_counts(t):
    return logs.action_counts(logs.accepted_metrics(t.metrics()))


@query("session_counts", f"SELECT session_id, CAST(CAST(created_at AS DATE) AS VARCHAR) AS day, count(*) AS n FROM v_metrics WHERE {_VALID} GROUP BY ALL")
def session_counts(t):
    return logs.session_counts(logs.accepted_metrics(t.metrics()))


@query("event_action_counts", f"SELECT event_id % 500 AS event_id, count(*) AS n, max(created_at) AS last_at FROM v_metrics WHERE {_VALID} GROUP BY 1")
def event_action_counts(t):
    return logs.event_counts(logs.accepted_metrics(t.metrics()).withColumn("event_id", F.col("event_id") % 500))


_COST = """costed AS (SELECT *, coalesce(prompt_tokens, 0) AS p, coalesce(completion_tokens, 0) AS c,
  CASE model WHEN 'gpt-4.1-mini' THEN (p * 0.40 + c * 1.60) / 1000000 WHEN 'gpt-4.1' THEN (p * 2.00 + c * 8.00) / 1000000
    WHEN 'gpt-4o' THEN (p * 2.50 + c * 10.00) / 1000000 ELSE 0 END AS cost FROM v_usage)"""


@query("usage_costs", f"WITH {_COST} SELECT usage_id, p + c AS total_tokens, round(cost, 9) AS estimated_cost_usd FROM costed")
def usage_costs(t):
    return logs.costed_usage(t.usage()).select("usage_id", "total_tokens", F.round("estimated_cost_usd", 9).alias("estimated_cost_usd"))


def _rollup_sql(by: str) -> str:
    day = "CAST(CAST(created_at AS DATE) AS VARCHAR)"
    return f"""WITH {_COST} SELECT {by}, {day} AS day, count(*) AS calls, sum(p + c)::BIGINT AS tokens, round(sum(cost), 9) AS cost, round(avg(latency_ms), 4) AS latency,
  round(avg(CASE WHEN success THEN 0.0 ELSE 1.0 END), 6) AS failure_rate FROM costed GROUP BY ROLLUP ({by}, {day})"""


def _rolled(t, by):
    return logs.usage_rollup(logs.costed_usage(t.usage()), by).select(
        by, "day", "calls", "tokens", F.round("cost", 9).alias("cost"), F.round("latency", 4).alias("latency"),
        F.round("failure_rate", 6).alias("failure_rate"))


@query("usage_by_feature_day", _rollup_sql("feature"))
def usage_by_feature_day(t):
    return _rolled(t, "feature")


@query("usage_by_model_day", _rollup_sql("model"))
def usage_by_model_day(t):
    return _rolled(t, "model")


@query("usage_by_run_day", _rollup_sql("run_id").replace("FROM costed", "FROM (SELECT *, usage_id % 40 AS run_id FROM costed)"))
def usage_by_run_day(t):
    runs = logs.costed_usage(t.usage()).withColumn("run_id", F.col("usage_id") % 40)
    return logs.usage_rollup(runs, "run_id").select(
        "run_id", "day", "calls", "tokens", F.round("cost", 9).alias("cost"), F.round("latency", 4).alias("latency"),
        F.round("failure_rate", 6).alias("failure_rate"))


# --- classifiers and validation ---------------------------------------------

_CH = "['incapsula', '_incapsula_resource', 'captcha-delivery\\.com', 'datadome', 'cf-browser-verification', 'cf_chl_opt', 'challenges\\.cloudflare\\.com', 'akamai.*bot.*manager', 'g-recaptcha', 'h-captcha']"
_BODY = """body AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN html WHEN 1 THEN html || '<div class="g-recaptcha">captcha g-recaptcha-response</div>'
  WHEN 2 THEN '<script src="//js.datadome.co/tags.js">' WHEN 3 THEN '<html>' || page_id || '</html>' WHEN 4 THEN '<iframe src=x>' || left(html, 100) ELSE html || 'js.datadome.co' END AS b FROM pages)"""


def _bodies(t):
    key, html = F.col("page_id") % 6, F.col("html")
    return t.spread("pages").select("page_id", (
        F.when(key == 0, html)
        .when(key == 1, F.concat(html, F.lit('<div class="g-recaptcha">captcha g-recaptcha-response</div>')))
        .when(key == 2, F.lit('<script src="//js.datadome.co/tags.js">'))
        .when(key == 3, F.concat(F.lit("<html>"), "page_id", F.lit("</html>")))
        .when(key == 4, F.concat(F.lit("<iframe src=x>"), F.substring(html, 1, 100)))
        .otherwise(F.concat(html, F.lit("js.datadome.co")))).alias("b"))


@query("page_kinds", f"""WITH {_BODY}, h AS (SELECT *, len(list_filter({_CH}, lambda p: regexp_matches(b, '(?i)' || p))) AS ch,
  len(list_filter(['g-recaptcha-response', 'h-captcha-response', 'captcha'], lambda p: regexp_matches(b, '(?i)' || p))) AS ca FROM body)
SELECT page_id, CASE WHEN length(b) < 500 AND regexp_matches(b, '(?i)<iframe') THEN 'waf_challenge' WHEN ca >= 2 THEN 'captcha' WHEN ch >= 1 THEN 'waf_challenge'
  WHEN length(b) < 300 AND length(trim(regexp_replace(b, '<[^>]+>', '', 'g'))) < 50 THEN 'block' ELSE 'real_content' END AS kind,
  regexp_matches(b, '(?i)captcha-delivery\\.com') OR (length(b) < 5000 AND regexp_matches(b, '(?i)datadome')) AS vendor, length(b) < 500 AS small FROM h""")
def page_kinds(t):
    b = F.col("b")
    return _bodies(t).select(
        "page_id", classify.page_kind(b).alias("kind"), classify.vendor_challenge(b).alias("vendor"),
        classify.suspiciously_small(b, F.lit("text/html; charset=utf-8")).alias("small"))


@query("binary_bodies", "SELECT page_id, page_id % 3 = 0 AS looks_binary FROM pages")
def binary_bodies(t):
    noise = F.repeat(F.lit("\u0001�"), 25)
    body = F.when(F.col("page_id") % 3 == 0, F.concat(noise, "html")).otherwise(F.col("html"))
    return t.spread("pages").select("page_id", classify.looks_binary(body).alias("looks_binary"))


@query("error_kinds", """SELECT event_id, CASE event_id % 3 WHEN 0 THEN (400 + event_id % 110) IN (401, 403, 408, 425, 429, 500, 502, 503, 504) WHEN 1 THEN true ELSE false END AS transient FROM events""")
def error_kinds(t):
    key = F.col("event_id")
    message = (F.when(key % 3 == 0, F.concat(F.lit("HTTP "), 400 + key % 110, F.lit(" for https://x")))
               .when(key % 3 == 1, F.when(key % 2 == 0, "read ECONNRESET").otherwise("TypeError: fetch failed"))
               .otherwise("unexpected token in JSON"))
    return t.raw("events").select("event_id", classify.is_transient(message).alias("transient"))


@query("validation_rejects", """SELECT id, CASE WHEN id % 11 = 0 THEN 'title' WHEN id % 13 = 0 THEN 'city' ELSE 'categories' END AS errors FROM v_listings WHERE id % 11 = 0 OR id % 13 = 0 OR id % 17 = 0""")
def validation_rejects(t):
    key = F.col("id")
    rows = t.listings("id", "title", "description", "start_at", "venue_name", "city", "price_min", "price_max", "categories").select(
        "id", F.when(key % 11 == 0, F.repeat("title", 60)).otherwise(F.col("title")).alias("title"), "description",
        F.col("start_at").cast("string").alias("start_local"), "venue_name", F.lit(None).cast("string").alias("address"),
        F.when((key % 13 == 0) & (key % 11 != 0), "atlantis").otherwise(F.col("city")).alias("city"), "price_min", "price_max",
        F.when((key % 17 == 0) & (key % 13 != 0) & (key % 11 != 0), F.array_repeat(F.lit("x"), 7)).otherwise(F.col("categories")).alias("categories"))
    return V.split_valid(rows, V.EVENT_RULES())[1].select("id", F.array_join("errors", ",").alias("errors"))


@query("place_rejects", """SELECT id, CASE WHEN id % 11 = 0 THEN 'name' WHEN id % 13 = 0 THEN 'category' WHEN id % 17 = 0 THEN 'phone_number' WHEN id % 19 = 0 THEN 'lat' ELSE 'web_rating' END AS errors
FROM v_places WHERE id % 11 = 0 OR id % 13 = 0 OR id % 17 = 0 OR id % 19 = 0 OR id % 23 = 0""")
def place_rejects(t):
    """Rows that break one rule of a place or of an enriched place."""
    key = F.col("id")
    steps = [(11, "name", F.lit("")), (13, "category", F.lit("casino")), (17, "phone_number", F.repeat(F.lit("5"), 31)), (19, "lat", F.lit(91.0)), (23, "web_rating", F.lit(5.5))]
    rows, free = t.places().withColumn("price_range", F.lit("$$")), F.lit(True)
    for n, c, bad in steps:
        rows = rows.withColumn(c, F.when((key % n == 0) & free, bad).otherwise(F.col(c)))
        free = free & (key % n != 0)
    seen = dict(V.PLACE_RULES() + V.ENRICHED_RULES())
    return V.split_valid(rows, list(seen.items()))[1].select("id", F.array_join("errors", ",").alias("errors"))


@query("text_cleanup", """SELECT page_id, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(html, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&'), '[\\x00-\\x1f\\x7f]', '', 'g'), '\\s+', ' ', 'g')) AS inline_text FROM pages""")
def text_cleanup(t):
    return t.spread("pages").select("page_id", text.clean_inline(F.col("html")).alias("inline_text"))


@query("html_plain_text", """WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '<\\s*br\\s*/?\\s*>', chr(10), 'gi'), '</\\s*(?:p|div|li|h[1-6]|blockquote|tr)\\s*>', chr(10) || chr(10), 'gi'), '</?[a-zA-Z][^>]*>', '', 'g') AS s FROM pages),
b AS (SELECT page_id, replace(replace(replace(replace(s, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&') AS s FROM a)
SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '[\\x00-\\x08\\x0b-\\x1f\\x7f]', '', 'g'), '[ \\t]+', ' ', 'g'), '[ \\t]*\\n[ \\t]*', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), chr(10) || ' ') AS plain FROM b""")
def html_plain_text(t):
    return t.spread("pages").select("page_id", text.html_to_text(F.col("html")).alias("plain"))


@query("summaries_truncated", """SELECT doc_id, CASE WHEN length(text) > 140 THEN left(text, 137) || '...' ELSE text END AS short, left(text, 120) AS cut FROM documents""")
def summaries_truncated(t):
    c = F.col("text")
    return t.raw("documents").select("doc_id", text.ellipsis(c, 140).alias("short"), F.substring(c, 1, 120).alias("cut"))


@query("city_hints", """SELECT c_custkey AS id, CASE c_custkey % 9 WHEN 0 THEN 'tampa' WHEN 1 THEN 'tampa' WHEN 2 THEN 'st_petersburg' WHEN 3 THEN 'clearwater' WHEN 4 THEN 'brandon' WHEN 5 THEN 'bradenton'
  WHEN 6 THEN 'safety_harbor' WHEN 7 THEN 'dunedin' ELSE 'other' END AS city FROM customer""")
def city_hints(t):
    key = F.col("c_custkey")
    samples = ["Downtown TAMPA", "Ybor City", "St Petersburg FL", "Clearwater Beach", "Valrico", "Anna Maria", "Safety  Harbor", "palm harbor", "Orlando"]
    place = F.element_at(F.array(*map(F.lit, samples)), (key % 9 + 1).cast("int"))
    return t.raw("customer").select(key.alias("id"), text.refine_city(F.lit("other"), F.concat(F.col("c_name"), F.lit(" "), place)).alias("city"))


@query("source_slug_order", "SELECT source_slug FROM v_sources WHERE enabled ORDER BY source_slug")
def source_slug_order(t):
    return t.sources().filter("enabled").select("source_slug").orderBy("source_slug")


@query("distinct_group_ids", "SELECT DISTINCT canonical_id FROM v_listings WHERE canonical_id IS NOT NULL")
def distinct_group_ids(t):
    return t.listings("canonical_id").filter("canonical_id is not null").distinct()
