"""Queries over listing reads."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from marquee.dims import TAG_ALIASES
from marquee.functions import clock, prices, tags, text
from marquee.operators import listing as L, resolve as R
from marquee.plans.registry import query
from marquee.plans.views import NOW, NOW_SQL, local_instant, ny
from marquee.session import cut_lineage

WEEK = clock.window_bounds("week", NOW)
YEAR = (datetime(1997, 1, 1, tzinfo=timezone.utc), datetime(1997, 12, 31, 23, 59, 59, tzinfo=timezone.utc))
WEEK_SQL = "start_at BETWEEN TIMESTAMP '1998-06-05 04:00:00' AND TIMESTAMP '1998-06-13 03:59:59.999'"
YEAR_SQL = "start_at BETWEEN TIMESTAMP '1997-01-01 00:00:00' AND TIMESTAMP '1997-12-31 23:59:59'"

FULL = ["id", "source_id", "canonical_id", *L.PAYLOAD]

# SQL: visible rows, their groups, and the ranked listing.


def vis(cond: str) -> str:
    return f"vis AS (SELECT * FROM v_listings JOIN v_sources USING (source_id) WHERE enabled AND {cond})"


ELECTION = "(image_url IS NULL OR trim(image_url) = ''), source_rank, start_at, id"


def effective(alias: str = "") -> str:
    return f"""CASE WHEN editorial_score IS NULL THEN -1.0 ELSE editorial_score
  - CASE WHEN editorial_updated_at IS NOT NULL AND editorial_updated_at >= {NOW_SQL} - INTERVAL 48 HOUR THEN CAST(0.0 AS DOUBLE) ELSE CAST(0.2 AS DOUBLE) END
  - CASE WHEN editorial_score <= 0.55 AND coalesce(why_its_cool, '') = '' THEN CAST(0.1 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END END"""


def listed(cond: str) -> str:
    return f"""{vis(cond)},
ranked AS (SELECT *, row_number() OVER (PARTITION BY canonical_id ORDER BY {ELECTION}) AS rn FROM vis WHERE canonical_id IS NOT NULL),
disp AS (SELECT * FROM ranked WHERE rn = 1),
agg AS (SELECT r.canonical_id, count(*) AS duplicate_count,
  coalesce(string_agg(DISTINCT r.source_slug, '|' ORDER BY r.source_slug) FILTER (WHERE r.rn > 1), '') AS also_on
  FROM ranked r GROUP BY r.canonical_id),
merged AS (
  SELECT d.canonical_id, d.start_at, d.id, coalesce(deduped_title, title) AS title, coalesce(summary, description) AS description,
    d.city, CASE WHEN len(tags) > 0 THEN tags ELSE categories END AS categories, image_url, venue_name, is_free, all_day, end_at,
    price_min, price_max, duplicate_count, also_on, editorial_score, editorial_updated_at, why_its_cool, vibes, audience, indoor_outdoor
  FROM disp d JOIN agg USING (canonical_id) JOIN v_canonical c USING (canonical_id)
  UNION ALL
  SELECT NULL, start_at, id, title, description, city, categories, image_url, venue_name, is_free, all_day, end_at,
    price_min, price_max, 1, '', NULL, NULL, NULL, [], NULL, NULL FROM vis WHERE canonical_id IS NULL),
scored AS (SELECT *, {effective()} AS rank_score FROM merged)"""


SHOWN = """id, canonical_id, title, description, city, array_to_string(categories, '|') AS categories, start_at,
  duplicate_count, also_on, round(rank_score, 6) AS rank_score, price_min, price_max, audience, indoor_outdoor"""


def shown(df):
    return df.select(
        "id", "canonical_id", "title", "description", "city", F.array_join("categories", "|").alias("categories"),
        "start_at", "duplicate_count", F.array_join("also_on", "|").alias("also_on"),
        F.round("rank_score", 6).alias("rank_score"), "price_min", "price_max", "audience", "indoor_outdoor")


def rows_in(t, bounds, **filters):
    return L.visible(t.listings(*FULL, "start_at", start=bounds), t.sources(), *bounds, **filters)


def whole(t):
    """Visible rows of every source over all time."""
    ever = (datetime(1900, 1, 1, tzinfo=timezone.utc), datetime(2100, 1, 1, tzinfo=timezone.utc))
    return L.visible(t.listings(*FULL, "start_at"), t.sources(), *ever)


@query("listing_week", f"WITH {listed(WEEK_SQL)} SELECT {SHOWN} FROM scored ORDER BY scored.rank_score DESC, start_at, id LIMIT 100")
def listing_week(t):
    return shown(L.top(L.listing(rows_in(t, WEEK), t.canonicals(), NOW)))


@query("listing_year_free_in_cities", f"""WITH {listed(YEAR_SQL + " AND city IN ('tampa', 'brandon') AND is_free")}
SELECT {SHOWN} FROM scored ORDER BY scored.rank_score DESC, start_at, id LIMIT 200""")
def listing_year_free_in_cities(t):
    rows = rows_in(t, YEAR, cities=["tampa", "brandon"], free_only=True)
    return shown(L.top(L.listing(rows, t.canonicals(), NOW), 200))


@query("listing_all_groups", f"WITH {listed('true')} SELECT {SHOWN} FROM scored")
def listing_all_groups(t):
    return shown(L.listing(whole(t), t.canonicals(), NOW))


@query("visible_events", f"WITH {vis(YEAR_SQL)} SELECT id, source_slug, city, start_at, price_min, price_max FROM vis")
def visible_events(t):
    return L.plain_price(rows_in(t, YEAR)).select("id", "source_slug", "city", "start_at", "price_min", "price_max")


@query("event_detail", """SELECT l.id, coalesce(deduped_title, title) AS title, coalesce(summary, description) AS description,
  array_to_string(CASE WHEN len(tags) > 0 THEN tags ELSE categories END, '|') AS categories, canonical_id, editorial_score, audience, indoor_outdoor
FROM v_listings l JOIN v_sources s USING (source_id) LEFT JOIN v_canonical c USING (canonical_id) WHERE enabled""")
def event_detail(t):
    rows = t.listings("id", "source_id", "canonical_id", "title", "description", "categories")
    return L.event_detail(rows, t.sources(), t.canonicals()).select(
        "id", "title", "description", F.array_join("categories", "|").alias("categories"), "canonical_id", "editorial_score", "audience", "indoor_outdoor")


@query("upcoming_by_ids", f"""SELECT l.id, start_at FROM v_listings l JOIN v_sources USING (source_id)
WHERE enabled AND start_at >= {NOW_SQL} AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = l.id AND l_quantity > 45) ORDER BY start_at""")
def upcoming_by_ids(t):
    ids = t.raw("lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("id"))
    return L.upcoming_by_ids(t.listings("id", "source_id", "start_at"), t.sources(), ids, NOW).select(
        "id", "start_at").orderBy("start_at")


_FACET = """votes AS (SELECT min(city) AS city FROM vis WHERE canonical_id IS NOT NULL GROUP BY canonical_id
  UNION ALL SELECT city FROM vis WHERE canonical_id IS NULL),
facet AS (SELECT city, count(*) AS n FROM votes GROUP BY city)"""


@query("city_facet_week", f"WITH {vis(WEEK_SQL)}, {_FACET} SELECT city, n FROM facet")
def city_facet_week(t):
    return L.city_facet(L.visible(
        t.listings("id", "source_id", "canonical_id", "city", "start_at", start=WEEK), t.sources(), *WEEK))


@query("city_facet_all_time", f"WITH {vis('is_free')}, {_FACET} SELECT city, n FROM facet")
def city_facet_all_time(t):
    rows = t.listings("source_id", "canonical_id", "city", "is_free").filter("is_free")
    return L.city_facet(rows.join(t.sources().filter("enabled").select("source_id"), "source_id"))


_KEYS = "(VALUES ('tampa','Tampa',0),('st_petersburg','St. Petersburg',1),('clearwater','Clearwater',2),('brandon','Brandon',3),('bradenton','Bradenton',4),('safety_harbor','Safety Harbor',5),('dunedin','Dunedin',6),('other','Other',7)) k(city, label, pos)"


@query("city_facet_filled", f"""WITH {vis("start_at BETWEEN TIMESTAMP '1998-06-05 16:00:00' AND TIMESTAMP '1998-06-06 03:59:59.999'")}, {_FACET}
SELECT k.city, label, pos, coalesce(n, 0) AS n, coalesce(n, 0) > 0 OR k.city = 'brandon' AS shown FROM {_KEYS} LEFT JOIN facet USING (city)""")
def city_facet_filled(t):
    tonight = clock.window_bounds("tonight", NOW)
    rows = L.visible(t.listings("source_id", "canonical_id", "city", "start_at", start=tonight), t.sources(), *tonight)
    return L.filled_facet(L.city_facet(rows), ["brandon"])


@query("city_facet_total", f"""WITH {vis('true')}, {_FACET} SELECT sum(n)::BIGINT AS total FROM facet""")
def city_facet_total(t):
    return L.facet_total(L.city_facet(whole(t)))


@query("ticket_labels", """SELECT id, CASE id % 5 WHEN 0 THEN 'RSVP' WHEN 1 THEN 'Get free tickets' WHEN 2 THEN 'Notify me' ELSE 'Buy tickets' END AS label FROM v_listings""")
def ticket_labels(t):
    status = F.element_at(F.array(*map(F.lit, ("rsvp", "free", "not_yet", "sold_out", "unknown"))), (F.col("id") % 5 + 1).cast("int"))
    return t.listings("id").select("id", text.ticket_call(status).alias("label"))


@query("city_counts_by_group", f"""WITH {vis(YEAR_SQL)}
SELECT canonical_id, city, count(*) AS n FROM vis WHERE canonical_id IS NOT NULL GROUP BY ALL""")
def city_counts_by_group(t):
    rows = L.visible(t.listings("source_id", "canonical_id", "city", "start_at", start=YEAR), t.sources(), *YEAR)
    return rows.filter("canonical_id is not null").groupBy("canonical_id", "city").agg(F.count("*").alias("n"))


@query("window_total", f"""WITH {vis(WEEK_SQL)}
SELECT (SELECT count(DISTINCT canonical_id) FROM vis) + (SELECT count(*) FROM vis WHERE canonical_id IS NULL) AS total""")
def window_total(t):
    return L.window_total(L.visible(
        t.listings("source_id", "canonical_id", "start_at", start=WEEK), t.sources(), *WEEK))


_COVER = f"""u AS (SELECT DISTINCT canonical_id FROM vis WHERE canonical_id IS NOT NULL),
c AS (SELECT v.* FROM v_canonical v JOIN u USING (canonical_id)),
n AS (SELECT (SELECT count(*) FROM c) + (SELECT count(*) FROM vis WHERE canonical_id IS NULL) AS visible_count,
  (SELECT count(*) FROM c WHERE editorial_score IS NOT NULL AND editorial_updated_at >= {NOW_SQL} - INTERVAL 48 HOUR) AS curated_count,
  (SELECT max(editorial_updated_at) FROM c) AS refreshed_at)"""


@query("curation_coverage_week", f"""WITH {vis(WEEK_SQL)}, {_COVER}
SELECT visible_count, curated_count, refreshed_at, CAST(CASE WHEN visible_count = 0 THEN 0 ELSE round(curated_count * 100.0 / visible_count) END AS BIGINT) AS coverage_pct,
  CASE WHEN date_diff('hour', refreshed_at, {NOW_SQL}) < 1 THEN 'just now' ELSE date_diff('hour', refreshed_at, {NOW_SQL}) || 'h ago' END AS refreshed FROM n""")
def curation_coverage_week(t):
    rows = L.visible(t.listings("source_id", "canonical_id", "start_at", start=WEEK), t.sources(), *WEEK)
    return L.trust_line(L.coverage(rows, t.canonicals(), NOW), NOW)


@query("curation_coverage_all_time", f"""WITH {vis('true')}, {_COVER}
SELECT visible_count, curated_count, refreshed_at, CAST(round(curated_count * 100.0 / visible_count) AS BIGINT) AS coverage_pct FROM n""")
def curation_coverage_all_time(t):
    rows = t.listings("source_id", "canonical_id").join(t.sources().filter("enabled").select("source_id"), "source_id")
    return L.coverage(rows, t.canonicals(), NOW)


def tag_sql(x: str) -> str:
    """SQL: canonical tags of one raw category, in order."""
    aliases = ", ".join(f"'{k}': '{v}'" for k, v in TAG_ALIASES.items())
    return (f"list_transform(list_filter(list_transform(regexp_split_to_array(trim(split_part(lower(regexp_replace(trim({x}), '\\s+', ' ', 'g')), '/', 1)), '\\s+&\\s+'), "
            f"lambda p: trim(p)), lambda p: p <> ''), lambda p: coalesce(MAP {{{aliases}}}[p], p))")


_TAGGED = f"tagged AS (SELECT DISTINCT id, {tag_sql('raw')}[1] AS tag FROM (SELECT id, unnest(categories) AS raw FROM vis) WHERE len({tag_sql('raw')}) > 0)"


@query("tag_facet", f"WITH {vis('true')}, {_TAGGED} SELECT tag, count(*) AS n FROM tagged GROUP BY tag")
def tag_facet(t):
    rows = t.listings("source_id", "categories").join(t.sources().filter("enabled").select("source_id"), "source_id")
    return L.tag_facet(rows)


@query("canonical_tags", f"""WITH r AS (SELECT id, unnest(categories) AS raw, generate_subscripts(categories, 1) AS pos FROM v_listings),
l AS (SELECT id, pos, {tag_sql('raw')} AS tl FROM r),
e AS (SELECT id, pos * 100 + generate_subscripts(tl, 1) AS pos, unnest(tl) AS tag FROM l)
SELECT id, string_agg(tag, '|' ORDER BY pos) AS tags FROM (SELECT id, tag, min(pos) AS pos FROM e GROUP BY id, tag) GROUP BY id""")
def canonical_tags(t):
    return t.listings("id", "categories").select(
        "id", F.array_join(tags.canonical_tags(F.col("categories")), "|").alias("tags"))


@query("tag_match", f"WITH {vis('true')}, {_TAGGED} SELECT DISTINCT id FROM tagged WHERE tag IN ('building', 'economy')")
def tag_match(t):
    rows = t.listings("id", "source_id", "categories").join(
        t.sources().filter("enabled").select("source_id"), "source_id")
    return rows.filter(tags.matches_tags(F.col("categories"), ["building", "economy"])).select("id")


@query("events_by_local_day", f"""WITH {vis(YEAR_SQL)}
SELECT strftime({ny('start_at')}, '%Y-%m-%d') AS day_key, min(strftime({ny('start_at')}, '%A, %b %-d')) AS day_label, count(*) AS n, min(start_at) AS first_start
FROM vis GROUP BY 1""")
def events_by_local_day(t):
    rows = L.visible(t.listings("id", "source_id", "start_at", start=YEAR), t.sources(), *YEAR)
    return L.by_local_day(rows).groupBy("day_key").agg(
        F.min("day_label").alias("day_label"), F.count("*").alias("n"), F.min("start_at").alias("first_start"))


@query("standout_events", f"""WITH {listed(YEAR_SQL)}
SELECT id, round(rank_score, 6) AS rank_score FROM scored WHERE editorial_score >= 0.7 AND editorial_updated_at >= {NOW_SQL} - INTERVAL 48 HOUR
ORDER BY scored.rank_score DESC, start_at, id LIMIT 3""")
def standout_events(t):
    ranked = L.listing(rows_in(t, YEAR), t.canonicals(), NOW, ["image_url", "title", "description", "categories"])
    return L.standouts(ranked, NOW).select("id", F.round("rank_score", 6).alias("rank_score"))


@query("feed_without_standouts", f"""WITH {listed(WEEK_SQL)},
st AS (SELECT id FROM scored WHERE editorial_score >= 0.7 AND editorial_updated_at >= {NOW_SQL} - INTERVAL 48 HOUR ORDER BY rank_score DESC, start_at, id LIMIT 3)
SELECT id, title FROM scored WHERE id NOT IN (SELECT id FROM st)""")
def feed_without_standouts(t):
    ranked = cut_lineage(L.listing(
        rows_in(t, WEEK), t.canonicals(), NOW, ["image_url", "title", "description", "categories"]))
    return L.remainder(ranked, L.standouts(ranked, NOW)).select("id", "title")


_SAVED = "saved AS (SELECT DISTINCT l_suppkey AS session_id, l_orderkey AS id FROM lineitem)"


def saved_rows(t):
    return t.raw("lineitem").select(F.col("l_suppkey").alias("session_id"), F.col("l_orderkey").alias("id")).distinct()


@query("saved_counts", f"""WITH {vis('true')}, {_TAGGED}, {_SAVED}, hit AS (SELECT DISTINCT id FROM tagged WHERE tag = 'building')
SELECT session_id, count(*) AS upcoming, count(*) FILTER (WHERE start_at < {NOW_SQL} + INTERVAL 24 HOUR) AS within_day
FROM saved JOIN vis USING (id) WHERE start_at >= {NOW_SQL} AND id IN (SELECT id FROM hit) GROUP BY session_id""")
def saved_counts(t):
    rows = t.listings("id", "source_id", "start_at", "categories").join(
        t.sources().filter("enabled").select("source_id"), "source_id")
    return L.saved_counts(saved_rows(t), rows, NOW, ["building"])


@query("saved_only_view", f"""WITH {vis(WEEK_SQL)}, {_SAVED}
SELECT id, city FROM vis WHERE id IN (SELECT id FROM saved) OR NOT EXISTS (SELECT 1 FROM vis v JOIN saved s ON s.id = v.id WHERE v.start_at >= {NOW_SQL})""")
def saved_only_view(t):
    rows = L.visible(t.listings("id", "source_id", "city", "start_at", "categories", start=WEEK), t.sources(), *WEEK)
    return L.saved_view(rows, saved_rows(t), NOW, [], True).select("id", "city")


@query("merge_later_wins", f"""SELECT id, title FROM v_listings WHERE id NOT IN (SELECT id FROM v_incoming) UNION ALL SELECT id, title FROM v_incoming""")
def merge_later_wins(t):
    return L.merge_later_wins(t.listings("id", "title"), t.incoming().select("id", "title"))


@query("primary_election", f"""SELECT canonical_id, id AS primary_id FROM v_listings JOIN v_sources USING (source_id)
WHERE enabled AND canonical_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY canonical_id ORDER BY {ELECTION}) = 1""")
def primary_election(t):
    rows = t.listings("id", "source_id", "canonical_id", "start_at", "image_url")
    members = rows.filter("canonical_id is not null").join(t.sources().filter("enabled"), "source_id")
    return R.elect_primary(members)


@query("primary_for_refresh", f"""SELECT canonical_id, l.id AS primary_id FROM v_listings l JOIN v_sources USING (source_id) JOIN v_canonical USING (canonical_id)
WHERE enabled QUALIFY row_number() OVER (PARTITION BY canonical_id ORDER BY (primary_event_id IS NULL OR l.id <> primary_event_id),
  (image_url IS NULL OR trim(image_url) = ''), start_at, source_slug, l.id) = 1""")
def primary_for_refresh(t):
    rows = t.listings("id", "source_id", "canonical_id", "start_at", "image_url")
    members = rows.join(t.sources().filter("enabled"), "source_id").join(
        t.canonicals().select("canonical_id", "primary_event_id"), "canonical_id")
    return R.elect_refresh_primary(members)


@query("group_sources", f"""WITH g AS (SELECT canonical_id, source_slug, id, row_number() OVER (PARTITION BY canonical_id ORDER BY {ELECTION}) AS rn
  FROM v_listings JOIN v_sources USING (source_id) WHERE enabled AND canonical_id IS NOT NULL)
SELECT canonical_id, max(id) FILTER (WHERE rn = 1) AS id, count(*) AS duplicate_count,
  coalesce(string_agg(DISTINCT source_slug, '|' ORDER BY source_slug) FILTER (WHERE rn > 1), '') AS also_on FROM g GROUP BY canonical_id""")
def group_sources(t):
    rows = t.listings("id", "source_id", "canonical_id", "start_at", "image_url")
    members = rows.filter("canonical_id is not null").join(t.sources().filter("enabled"), "source_id")
    return L.group_display(members, ["source_id"]).select(
        "canonical_id", "id", "duplicate_count", F.array_join("also_on", "|").alias("also_on"))


@query("groups_with_visible_events", f"""WITH {vis(WEEK_SQL)} SELECT canonical_id FROM v_canonical c WHERE EXISTS (SELECT 1 FROM vis WHERE vis.canonical_id = c.canonical_id)""")
def groups_with_visible_events(t):
    rows = L.visible(t.listings("source_id", "canonical_id", "start_at", start=WEEK), t.sources(), *WEEK)
    return t.canonicals().select("canonical_id").join(rows.select("canonical_id"), "canonical_id", "left_semi")


@query("groups_without_events", f"SELECT canonical_id FROM v_canonical c WHERE NOT EXISTS (SELECT 1 FROM v_listings l WHERE l.canonical_id = c.canonical_id)")
def groups_without_events(t):
    return t.canonicals().select("canonical_id").join(
        t.listings("canonical_id"), "canonical_id", "left_anti")


@query("groups_to_refresh", f"""SELECT canonical_id, editorial_updated_at FROM v_canonical
WHERE coalesce(summary, '') = '' OR editorial_score IS NULL OR editorial_updated_at IS NULL OR editorial_updated_at < {NOW_SQL} - INTERVAL 48 HOUR""")
def groups_to_refresh(t):
    return L.needs_refresh(t.canonicals(), NOW).select("canonical_id", "editorial_updated_at")


@query("refresh_page_after_cursor", """SELECT canonical_id FROM v_canonical c WHERE canonical_id > 70
  AND EXISTS (SELECT 1 FROM v_listings l JOIN v_sources USING (source_id) WHERE enabled AND l.canonical_id = c.canonical_id) ORDER BY canonical_id LIMIT 100""")
def refresh_page_after_cursor(t):
    live = t.listings("source_id", "canonical_id").join(t.sources().filter("enabled"), "source_id")
    groups = t.canonicals().select("canonical_id").join(live, "canonical_id", "left_semi")
    return L.page_after(groups, "canonical_id", 70)


@query("enabled_adapters", """SELECT 'src_' || n AS source_slug FROM (SELECT s_suppkey * 2 AS n FROM supplier) k
LEFT JOIN v_sources s ON s.source_slug = 'src_' || n WHERE coalesce(enabled, true) ORDER BY 1""")
def enabled_adapters(t):
    known = t.raw("supplier").select(F.concat(F.lit("src_"), F.col("s_suppkey") * 2).alias("source_slug"))
    return L.enabled_sources(known, t.sources()).orderBy("source_slug")


@query("price_labels", """SELECT id, CASE WHEN is_free THEN 'Free' WHEN price_min IS NULL THEN NULL
  WHEN price_min <> price_max THEN '$' || CAST(floor(CAST(price_min AS DECIMAL(12,2)) + 0.5) AS BIGINT) || ' – $' || CAST(floor(CAST(price_max AS DECIMAL(12,2)) + 0.5) AS BIGINT)
  WHEN price_min = 0 THEN 'Free' ELSE '$' || CAST(floor(price_min + 0.5) AS BIGINT) END AS price FROM v_listings""")
def price_labels(t):
    rows = L.plain_price(t.listings("id", "is_free", "price_min", "price_max"))
    return rows.select("id", prices.format_price(F.col("price_min"), F.col("price_max"), F.col("is_free")).alias("price"))


@query("time_labels", f"""SELECT id, strftime({ny('start_at')}, '%A, %b %-d') AS day,
  CASE WHEN all_day THEN 'All day' WHEN end_at IS NULL THEN strftime({ny('start_at')}, '%-I:%M %p')
    WHEN CAST({ny('start_at')} AS DATE) = CAST({ny('end_at')} AS DATE) THEN strftime({ny('start_at')}, '%-I:%M %p') || ' – ' || strftime({ny('end_at')}, '%-I:%M %p')
    ELSE strftime({ny('start_at')}, '%-I:%M %p') || ' → ' || strftime({ny('end_at')}, '%b %-d, %-I:%M %p') END AS hours FROM v_listings""")
def time_labels(t):
    s, e = F.col("start_at"), F.col("end_at")
    return t.listings("id", "start_at", "end_at", "all_day").select(
        "id", clock.format_day(s).alias("day"), clock.format_time_range(s, e, F.col("all_day")).alias("hours"))


@query("ingest_window_overlap", f"""SELECT id FROM v_listings WHERE start_at <= TIMESTAMP '1998-06-20 03:59:59.999'
  AND coalesce(end_at, start_at) >= TIMESTAMP '1998-06-05 04:00:00'""")
def ingest_window_overlap(t):
    low, high = clock.window_bounds("ingest", NOW)
    return t.listings("id", "start_at", "end_at").filter(
        clock.overlaps(F.col("start_at"), F.col("end_at"), F.lit(low), F.lit(high))).select("id")


def _bounds_sql(kind: str) -> str:
    d = f"CAST({ny('start_at')} AS DATE)"
    span = {"weekend": 2, "week": 7}[kind]
    first = d if kind == "week" else f"CASE WHEN dayofweek({d}) IN (0, 5, 6) THEN {d} ELSE CAST({d} + to_days(CAST(5 - dayofweek({d}) AS INTEGER)) AS DATE) END"
    utc = "((CAST({} AS TIMESTAMP){}) AT TIME ZONE 'America/New_York' AT TIME ZONE 'UTC')"
    return (utc.format(first, "") + f" AS {kind}_start, "
            + utc.format(f"({first} + to_days({span}))", " + INTERVAL 86399999 MILLISECOND") + f" AS {kind}_end")


@query("windows_per_row", f"SELECT id, {_bounds_sql('weekend')}, {_bounds_sql('week')} FROM v_listings")
def windows_per_row(t):
    now = F.col("start_at")
    a, b = clock.window_columns("weekend", now)
    c, d = clock.window_columns("week", now)
    return t.listings("id", "start_at").select(
        "id", a.alias("weekend_start"), b.alias("weekend_end"), c.alias("week_start"), d.alias("week_end"))


@query("end_of_local_week", f"""SELECT id, ((CAST(CAST({ny('start_at')} AS DATE) + to_days(CAST(6 - dayofweek(CAST({ny('start_at')} AS DATE)) AS INTEGER)) AS TIMESTAMP)
  + INTERVAL 86399999 MILLISECOND) AT TIME ZONE 'America/New_York' AT TIME ZONE 'UTC') AS week_end FROM v_listings""")
def end_of_local_week(t):
    return t.listings("id", "start_at").select("id", clock.end_of_week(F.col("start_at")).alias("week_end"))


@query("parse_local_times", f"""SELECT id, {local_instant('start_at')} AS from_minutes,
  (CAST(CAST(start_at AS DATE) AS TIMESTAMP) AT TIME ZONE 'America/New_York' AT TIME ZONE 'UTC') AS from_date,
  CAST(NULL AS TIMESTAMP) AS from_junk FROM v_listings""")
def parse_local_times(t):
    s = F.col("start_at")
    return t.listings("id", "start_at").select(
        "id", clock.parse_local(F.date_format(s, "yyyy-MM-dd'T'HH:mm")).alias("from_minutes"),
        clock.parse_local(F.date_format(s, "yyyy-MM-dd")).alias("from_date"),
        clock.parse_local(F.concat(F.lit("x"), F.col("id"))).alias("from_junk"))
