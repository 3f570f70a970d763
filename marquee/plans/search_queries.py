"""Queries over search and itineraries."""

from __future__ import annotations

from pyspark.sql import functions as F

from marquee.functions import scores, text
from marquee.functions.clock import effective_interval, local_day
from marquee.operators import itinerary as I, listing as L, places as P, plan_rows as PR, search as S
from marquee.plans.listing_queries import WEEK, WEEK_SQL, YEAR, YEAR_SQL, listed, rows_in, whole
from marquee.plans.registry import query
from marquee.plans.views import NOW, ny
from marquee.session import cut_lineage

QUERY = "small ring"


def _n(c: str) -> str:
    return f"trim(lower(regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g')))"


def score_sql(points: dict, q: str, columns: dict | None = None) -> str:
    columns = columns or {}
    tokens = [x for x in q.split(" ") if len(x) > 1]
    terms = []

    def hit(field, needle):
        c = columns.get(field, field)
        if field in scores.ARRAY_FIELDS:
            return f"len(list_filter({c}, lambda x: contains({_n('x')}, '{needle}'))) > 0"
        return f"contains({_n(c)}, '{needle}')"

    head = next(iter(points))
    terms.append(f"CASE WHEN starts_with({_n(columns.get(head, head))}, '{q}') THEN 100 ELSE 0 END")
    for field, (whole_, per) in points.items():
        terms.append(f"CASE WHEN {hit(field, q)} THEN {whole_} ELSE 0 END")
        if per:
            terms += [f"CASE WHEN {hit(field, x)} THEN {per} ELSE 0 END" for x in tokens]
    total = " + ".join(terms)
    return f"CASE WHEN ({total}) > 0 THEN ({total}) + coalesce(editorial_score, 0) * 10 ELSE 0 END"


_TKEY = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(title), '\b\d{4}\b', '', 'g'), 'tampa\s*bay', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"
_BETTER = "coalesce(editorial_score, -1) DESC, coalesce(image_url <> '', false) DESC, (canonical_id IS NULL), rank_score DESC, start_at, id"


def deduped(src: str) -> str:
    return f"""dd AS (SELECT * FROM (SELECT *, {_TKEY} AS tkey FROM {src}) QUALIFY row_number() OVER (PARTITION BY tkey ORDER BY {_BETTER}) = 1)"""


@query("search_dedupe", f"WITH {listed('true')}, {deduped('scored')} SELECT id, title FROM dd")
def search_dedupe(t):
    return S.dedupe_for_search(L.listing(whole(t), t.canonicals(), NOW)).select("id", "title")


@query("search_rank_events", f"""WITH e AS (SELECT l.*, c.editorial_score, c.why_its_cool, c.vibes FROM v_listings l LEFT JOIN v_canonical c USING (canonical_id)),
s AS (SELECT id, {score_sql(scores.EVENT_POINTS, QUERY)} AS score FROM e) SELECT id, round(score, 6) AS score FROM s WHERE score > 0""")
def search_rank_events(t):
    c = t.canonicals().select("canonical_id", "editorial_score", "why_its_cool", "vibes")
    rows = L.with_group(t.listings("id", "canonical_id", "title", "description", "venue_name", "city", "categories"), c)
    return S.score_events(rows, QUERY).select("id", F.round("score", 6).alias("score"))


@query("search_rank_places", f"""WITH s AS (SELECT id, {score_sql(scores.PLACE_POINTS, 'household spot')} AS score FROM v_places)
SELECT id, round(score, 6) AS score FROM s WHERE score > 0""")
def search_rank_places(t):
    return S.score_places(t.places(), "household spot").select("id", F.round("score", 6).alias("score"))


def _top_places(n: int) -> str:
    return f"pl AS (SELECT * FROM v_places ORDER BY editorial_score DESC NULLS LAST, name LIMIT {n})"


@query("search", f"""WITH {listed(YEAR_SQL)}, {deduped('scored')},
ev AS (SELECT *, {score_sql(scores.EVENT_POINTS, 'building art')} AS score FROM dd),
ps AS (SELECT *, {score_sql(scores.PLACE_POINTS, 'building art')} AS score FROM v_places)
SELECT * FROM (SELECT 'e' || id AS id, 'event' AS type, title, city, audience, round(score, 6) AS score FROM ev WHERE score > 0 ORDER BY ev.score DESC, ev.id LIMIT 40)
UNION ALL SELECT * FROM (SELECT 'p' || id, 'place', name, city, NULL, round(score, 6) FROM ps WHERE score > 0 ORDER BY ps.score DESC, ps.id LIMIT 15)""")
def search(t):
    pool = L.listing(rows_in(t, YEAR), t.canonicals(), NOW)
    return S.search(pool, t.places(), "building art").select("id", "type", "title", "city", "audience", F.round("score", 6).alias("score"))


_PICKS = """picks AS (SELECT l_suppkey AS query_id, l_linenumber * 1000000 + l_partkey AS pos, l_orderkey AS id, l_returnflag AS reason FROM lineitem),
known AS (SELECT id FROM v_listings WHERE is_free),
firsts AS (SELECT query_id, id, min(struct_pack(pos := pos, reason := reason)) AS f FROM picks WHERE id IN (SELECT id FROM known) GROUP BY ALL),
chosen AS (SELECT query_id, id, f.reason AS reason, row_number() OVER (PARTITION BY query_id ORDER BY f.pos, id) AS rank FROM firsts QUALIFY rank <= 5)"""


def _picks(t):
    return t.raw("lineitem").select(
        F.col("l_suppkey").alias("query_id"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("pos"),
        F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("reason"))


@query("curated_picks", f"WITH {_PICKS} SELECT query_id, id, reason, rank FROM chosen")
def curated_picks(t):
    return S.apply_picks(_picks(t), t.listings("id", "is_free").filter("is_free"), limit=5)


@query("results_without_picks", f"WITH {_PICKS} SELECT id FROM known WHERE id NOT IN (SELECT id FROM chosen)")
def results_without_picks(t):
    known = t.listings("id", "is_free").filter("is_free").select("id")
    return S.without_picks(known, S.apply_picks(_picks(t), known, limit=5))


@query("title_keys", f"""SELECT id, {_TKEY} AS dedupe_key,
  trim(regexp_replace(regexp_replace(replace(lower(title), '&', ' and '), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS match_key,
  regexp_replace(lower(title), '[^a-z0-9]', '', 'g') AS name_key, {_n('title')} AS search_key FROM v_listings""")
def title_keys(t):
    c = F.col("title")
    return t.listings("id", "title").select(
        "id", text.dedupe_title(c).alias("dedupe_key"), text.match_text(c).alias("match_key"),
        text.name_key(c).alias("name_key"), text.search_text(c).alias("search_key"))


# --- itineraries -----------------------------------------------------------

_ITEMS = """items AS (SELECT i.session_id, i.pos, i.item_id, CASE WHEN l.id IS NOT NULL THEN 'event' WHEN p.id IS NOT NULL THEN 'place' END AS kind,
  coalesce(l.title, p.name) AS title, l.start_at, l.end_at, l.all_day
  FROM v_plan_items i LEFT JOIN v_listings l ON i.item_id = 'e' || l.id LEFT JOIN v_places p ON i.item_id = 'p' || p.id
  WHERE l.id IS NOT NULL OR p.id IS NOT NULL)"""


def plan_events(t):
    return t.listings("id", "title", "start_at", "end_at", "all_day").withColumn("item_id", F.concat(F.lit("e"), "id"))


def resolved(t):
    places = t.places().select(F.concat(F.lit("p"), "id").alias("item_id"), "name")
    return I.resolve_items(t.plan_items(), plan_events(t), places)


@query("plan_items_resolved", f"WITH {_ITEMS} SELECT session_id, pos, item_id, kind, title, start_at FROM items")
def plan_items_resolved(t):
    return resolved(t).select("session_id", "pos", "item_id", "kind", "title", "start_at")


@query("plan_events_in_order", """SELECT session_id, pos, id, title FROM v_plan_items i JOIN v_listings l ON i.item_id = 'e' || l.id ORDER BY session_id, pos""")
def plan_events_in_order(t):
    return I.ordered_events(t.plan_items(), plan_events(t)).select("session_id", "pos", "id", "title").orderBy("session_id", "pos")


_CONFLICTS = f"""ev AS (SELECT session_id, item_id, start_at AS s, coalesce(end_at, start_at + INTERVAL 1 HOUR) AS e, strftime({ny('start_at')}, '%Y-%m-%d') AS day
  FROM items WHERE kind = 'event' AND NOT all_day),
pairs AS (SELECT x.session_id, x.day, x.item_id AS a, y.item_id AS b FROM ev x JOIN ev y USING (session_id, day)
  WHERE x.item_id < y.item_id AND x.s < y.e AND y.s < x.e)"""


@query("plan_conflicts", f"WITH {_ITEMS}, {_CONFLICTS} SELECT session_id, day, a, b FROM pairs")
def plan_conflicts(t):
    return I.conflicts(resolved(t).filter("kind = 'event'"))


@query("plan_conflict_days", f"""WITH {_ITEMS}, {_CONFLICTS}
SELECT session_id, day, count(DISTINCT i) AS events FROM (SELECT session_id, day, unnest([a, b]) AS i FROM pairs) GROUP BY ALL""")
def plan_conflict_days(t):
    return I.conflict_days(I.conflicts(resolved(t).filter("kind = 'event'")))


@query("plan_swap_options", f"""WITH {_ITEMS}, w AS (SELECT *, CASE WHEN kind = 'event' AND NOT all_day THEN start_at END AS t FROM items),
n AS (SELECT *, lag(t) OVER s AS up, lead(t) OVER s AS down, lag(item_id) OVER s IS NOT NULL AS hu, lead(item_id) OVER s IS NOT NULL AS hd
  FROM w WINDOW s AS (PARTITION BY session_id ORDER BY pos))
SELECT session_id, pos, item_id, hu AND coalesce(t <= up, true) AS can_up, hd AND coalesce(t >= down, true) AS can_down FROM n""")
def plan_swap_options(t):
    return PR.swap_options(resolved(t))


@query("plan_day_headers", f"""WITH {_ITEMS}, e AS (SELECT session_id, pos, item_id, strftime({ny('start_at')}, '%Y-%m-%d') AS day FROM items WHERE kind = 'event')
SELECT * FROM e QUALIFY lag(day) OVER (PARTITION BY session_id ORDER BY pos) IS DISTINCT FROM day""")
def plan_day_headers(t):
    return PR.day_headers(resolved(t))


_NEW = """nw AS (SELECT session_id, 'e' || l.id AS nid, l.start_at AS ns, l.all_day AS nad FROM (SELECT DISTINCT session_id FROM items)
  JOIN v_listings l ON l.id = (session_id * 977) % (SELECT count(*) FROM v_listings))"""


def _rows(t):
    return cut_lineage(PR.keyed(resolved(t)))


def _new_items(t, rows):
    """One event for each plan, which some plans hold already."""
    events = t.listings("id", "start_at", "all_day").withColumn("item_id", F.concat(F.lit("e"), "id"))
    wanted = rows.select("session_id").distinct().withColumn("id", (F.col("session_id") * 977) % t.count("orders"))
    return wanted.join(events, "id").select("session_id", "item_id", "start_at", "all_day")


def _listed(rows, name):
    """The plans as text, for a report."""
    items = F.transform(F.array_sort(F.collect_list(F.struct("at", "item_id"))), lambda x: x["item_id"])
    return rows.groupBy("session_id").agg(F.array_join(items, ",").alias(name))


@query("plan_insert_by_time", f"""WITH {_ITEMS}, {_NEW},
rest AS (SELECT i.*, nid, ns, nad, row_number() OVER (PARTITION BY session_id ORDER BY pos) - 1 AS k FROM items i JOIN nw USING (session_id) WHERE item_id <> nid),
pt AS (SELECT session_id, nid, coalesce(CASE WHEN NOT any_value(nad) THEN min(k) FILTER (WHERE NOT all_day AND start_at > ns) END, count(*)) AS ix FROM rest GROUP BY ALL)
SELECT session_id, string_agg(id, ',' ORDER BY o) AS plan FROM (
  SELECT session_id, item_id AS id, k * 2 + 1 AS o FROM rest UNION ALL SELECT session_id, nid, ix * 2 FROM pt) GROUP BY session_id""")
def plan_insert_by_time(t):
    rows = _rows(t)
    return _listed(PR.insert_by_time(rows, _new_items(t, rows)), "plan")


@query("plan_toggle_event", f"""WITH {_ITEMS}, {_NEW},
rest AS (SELECT i.*, nid, ns, nad, row_number() OVER (PARTITION BY session_id ORDER BY pos) - 1 AS k FROM items i JOIN nw USING (session_id) WHERE item_id <> nid),
pt AS (SELECT session_id, nid, coalesce(CASE WHEN NOT any_value(nad) THEN min(k) FILTER (WHERE NOT all_day AND start_at > ns) END, count(*)) AS ix FROM rest GROUP BY ALL)
SELECT session_id, string_agg(id, ',' ORDER BY o) AS plan FROM (
  SELECT session_id, item_id AS id, k * 2 + 1 AS o FROM rest
  UNION ALL SELECT session_id, nid, ix * 2 FROM pt WHERE NOT EXISTS (SELECT 1 FROM items i WHERE i.session_id = pt.session_id AND i.item_id = nid)) GROUP BY session_id""")
def plan_toggle_event(t):
    rows = _rows(t)
    return _listed(PR.toggle_event(rows, _new_items(t, rows)), "plan")


@query("plan_list_edits", f"""WITH {_ITEMS}, l AS (SELECT session_id, list(item_id ORDER BY pos) AS p FROM items GROUP BY session_id)
SELECT session_id, array_to_string(list_concat(list_filter(p, lambda x: x <> p[1]), [p[1]]), ',') AS moved,
  array_to_string(list_filter(p, lambda x: x <> p[3]), ',') AS removed,
  array_to_string(list_concat(list_concat([p[2]], [p[1]]), p[3:]), ',') AS swapped,
  array_to_string(list_concat(p, ['p-new']), ',') AS place_added,
  array_to_string(list_filter(p, lambda x: starts_with(x, 'p')), ',') AS known_places FROM l""")
def plan_list_edits(t):
    rows = _rows(t)
    item = F.struct("item_id", "start_at", "all_day")
    numbered = PR.ranked(rows).filter("n < 3")
    heads = cut_lineage(numbered.groupBy("session_id").agg(*[
        F.max(F.when(F.col("n") == k, item)).alias(f"i{k}") for k in range(3)]))
    first, third = (heads.select("session_id", f"i{k}.*") for k in (0, 2))
    pairs = heads.select("session_id", F.col("i0.item_id").alias("a"), F.col("i1.item_id").alias("b"))
    place = heads.select("session_id", F.lit("p-new").alias("item_id"), F.lit(None).cast("timestamp").alias("start_at"), F.lit(None).cast("boolean").alias("all_day"))
    out = _listed(PR.append_or_move(rows, first), "moved")
    for name, edited in (("removed", PR.remove(rows, third)), ("swapped", PR.swap(rows, pairs)), ("place_added", PR.toggle_place(rows, place)),
                         ("known_places", rows.filter(F.startswith("item_id", F.lit("p"))))):
        out = out.join(_listed(edited, name), "session_id", "left")
    return out.fillna("", ["known_places"])


@query("effective_intervals", f"""SELECT id, strftime({ny('start_at')}, '%Y-%m-%d') AS day,
  CASE WHEN all_day THEN (CAST(CAST({ny('start_at')} AS DATE) AS TIMESTAMP) AT TIME ZONE 'America/New_York' AT TIME ZONE 'UTC') ELSE start_at END AS low,
  CASE WHEN all_day THEN (CAST(CAST({ny('start_at')} AS DATE) + INTERVAL 1 DAY AS TIMESTAMP) AT TIME ZONE 'America/New_York' AT TIME ZONE 'UTC')
    ELSE coalesce(end_at, start_at + INTERVAL 1 HOUR) END AS high FROM v_listings""")
def effective_intervals(t):
    low, high = effective_interval(F.col("start_at"), F.col("end_at"), F.col("all_day"))
    return t.listings("id", "start_at", "end_at", "all_day").select(
        "id", local_day(F.col("start_at")).alias("day"), low.alias("low"), high.alias("high"))


@query("parsed_tag_lists", """SELECT id, CASE WHEN id % 3 = 0 THEN '' ELSE array_to_string(categories, '|') END AS tags FROM v_listings""")
def parsed_tag_lists(t):
    """Tags kept as JSON text back to lists; in every third row a number among them makes the list void."""
    whole = F.to_json("categories")
    stored = F.when(F.col("id") % 3 == 0, F.replace(whole, F.lit("]"), F.lit(", 7]"))).otherwise(whole)
    return t.listings("id", "categories").select("id", F.array_join(I.parse_tag_list(stored), "|").alias("tags"))


@query("parsed_id_lists", """WITH j AS (SELECT session_id, '["' || string_agg(DISTINCT session_id, '","') || '"]' AS s FROM v_metrics GROUP BY session_id)
SELECT session_id, session_id AS ids, 0 AS bad FROM j""")
def parsed_id_lists(t):
    text_list = F.concat(F.lit('["'), F.col("session_id"), F.lit('"]'))
    bad = F.concat(F.lit('["'), F.col("session_id"), F.lit('", 1]'))
    return t.metrics().select("session_id").distinct().select(
        "session_id", F.array_join(I.parse_id_list(text_list), ",").alias("ids"),
        F.size(I.parse_id_list(bad)).alias("bad"))
