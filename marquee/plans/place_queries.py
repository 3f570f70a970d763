"""Queries over places."""

from __future__ import annotations

from pyspark.sql import functions as F

from marquee.dims import CATEGORY_LABELS, CITIES, PLACE_CATEGORIES, VIBE_LABELS, lookup, source_rank
from marquee.functions import geo, places as FP, scores, text, urls
from marquee.operators import itinerary as I, places as P, upsert
from marquee.plans.registry import query
from marquee.plans.views import NOW, city_of, _CITY_SQL

ORDER = "editorial_score DESC NULLS LAST, name"


@query("places_ranked", f"SELECT id, name, city, category, round(editorial_score, 6) AS editorial_score FROM v_places ORDER BY v_places.{ORDER} LIMIT 100")
def places_ranked(t):
    return P.ranked_places(t.places()).select("id", "name", "city", "category", F.round("editorial_score", 6).alias("editorial_score"))


@query("places_filtered", """SELECT id, slug FROM v_places WHERE city IN ('tampa', 'dunedin') AND category IN ('venue', 'cafe')
AND list_has_any(vibes, ['brunch', 'waterfront'])""")
def places_filtered(t):
    return P.filtered_places(t.places(), ["tampa", "dunedin"], ["venue", "cafe"], ["brunch", "waterfront"]).select("id", "slug")


@query("places_by_ids", "SELECT id, name FROM v_places WHERE id IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def places_by_ids(t):
    ids = t.raw("orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("id"))
    return t.places().select("id", "name").join(ids, "id", "left_semi")


@query("place_by_slug", "SELECT id, name, category, verified FROM (SELECT *, false AS verified FROM v_places) WHERE slug = 'place-42'")
def place_by_slug(t):
    return t.places().filter("slug = 'place-42'").select("id", "name", "category", F.lit(False).alias("verified"))


@query("standout_places", f"SELECT id FROM v_places WHERE editorial_score >= 0.6 ORDER BY {ORDER} LIMIT 3")
def standout_places(t):
    return P.standout_places(t.places()).select("id")


@query("places_without_standouts", f"SELECT id FROM v_places WHERE id NOT IN (SELECT id FROM v_places WHERE editorial_score >= 0.6 ORDER BY {ORDER} LIMIT 3)")
def places_without_standouts(t):
    return t.places().select("id").join(P.standout_places(t.places()).select("id"), "id", "left_anti")


_ORDER_VALUES = ", ".join(f"({i}, '{c}')" for i, c in enumerate(PLACE_CATEGORIES))


@query("place_category_groups", f"""SELECT pos, v.category, CASE v.category WHEN 'venue' THEN 'Venues' WHEN 'shop' THEN 'Shops' WHEN 'attraction' THEN 'Attractions'
  WHEN 'cafe' THEN 'Cafés' WHEN 'gallery' THEN 'Galleries' ELSE 'Other' END AS label, count(*) AS n
FROM v_places v JOIN (VALUES {_ORDER_VALUES}) o(pos, category) USING (category) GROUP BY ALL""")
def place_category_groups(t):
    return P.category_groups(t.places())


@query("places_per_city", "SELECT city, count(*) AS n, count(DISTINCT regexp_replace(lower(name), '[^a-z0-9]', '', 'g')) AS names FROM v_places GROUP BY city")
def places_per_city(t):
    # Names per city are kept as distinct keys; one list per city would not be bounded.
    p = t.places().select("city", text.name_key(F.col("name")).alias("k"))
    return p.groupBy("city", "k").agg(F.count("*").alias("c")).groupBy("city").agg(
        F.sum("c").alias("n"), F.count("*").alias("names"))


# --- discovery -------------------------------------------------------------

FOUND = f"""found AS (SELECT o_orderkey AS pos, CASE o_orderkey % 3 WHEN 0 THEN c_name WHEN 1 THEN lower(c_name) ELSE replace(c_name, '#', ' # ') END AS name,
  {_CITY_SQL.format('c_nationkey')} AS city,
  CASE o_orderkey % 4 WHEN 0 THEN 'Barbershop' WHEN 1 THEN 'Craft Brewery' WHEN 2 THEN 'unknown' ELSE 'Art Museum' END AS category,
  ['beaches', 'bars', 'restaurants', 'breweries', 'hidden_gems', 'live_music'][CAST(o_orderkey % 6 AS INTEGER) + 1] AS search_type
  FROM orders JOIN customer ON c_custkey = o_custkey),
firsts AS (SELECT *, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS k FROM found
  QUALIFY row_number() OVER (PARTITION BY regexp_replace(lower(name), '[^a-z0-9]', '', 'g'), city ORDER BY pos) = 1)"""


def found(t):
    key = F.col("o_orderkey")
    rows = t.raw("orders").join(t.raw("customer").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (key % n + 1).cast("int"))
    return rows.select(
        key.alias("pos"),
        F.when(key % 3 == 0, F.col("c_name")).when(key % 3 == 1, F.lower("c_name"))
        .otherwise(F.replace("c_name", F.lit("#"), F.lit(" # "))).alias("name"),
        city_of(F.col("c_nationkey")).alias("city"),
        pick(["Barbershop", "Craft Brewery", "unknown", "Art Museum"], 4).alias("category"),
        pick(["beaches", "bars", "restaurants", "breweries", "hidden_gems", "live_music"], 6).alias("search_type"))


@query("discovered_first_per_name", f"WITH {FOUND} SELECT pos, name, city FROM firsts")
def discovered_first_per_name(t):
    return P.first_per_name(found(t)).select("pos", "name", "city")


@query("discovered_new_only", f"""WITH {FOUND} SELECT pos, name, city FROM firsts WHERE NOT EXISTS (SELECT 1 FROM v_places p
  WHERE p.id % 2 = 0 AND p.city = firsts.city AND regexp_replace(lower(p.name), '[^a-z0-9]', '', 'g') = firsts.k)""")
def discovered_new_only(t):
    known = t.places().filter("id % 2 = 0").select("name", "city")
    return P.new_candidates(P.first_per_name(found(t)).drop("name_key"), known).select("pos", "name", "city")


@query("discovered_categories", f"""WITH {FOUND} SELECT pos, CASE WHEN category = 'Barbershop' THEN 'bar' WHEN category = 'Craft Brewery' THEN 'brewery'
  WHEN category = 'Art Museum' THEN 'museum' ELSE CASE search_type WHEN 'beaches' THEN 'beach' WHEN 'bars' THEN 'bar' WHEN 'restaurants' THEN 'restaurant'
  WHEN 'breweries' THEN 'brewery' WHEN 'hidden_gems' THEN 'attraction' ELSE 'venue' END END AS category,
  regexp_replace(regexp_replace(lower(name || '-' || city), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM found""")
def discovered_categories(t):
    return found(t).select(
        "pos", text.place_category(F.col("category"), F.col("search_type")).alias("category"),
        text.place_slug(F.col("name"), F.col("city")).alias("slug"))


_REG = f"""reg AS (SELECT c_custkey AS map_id, {_CITY_SQL.format('c_nationkey')} AS city,
  CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN c_name || ' Tampa' WHEN 2 THEN substr(c_name, 9) ELSE 'Elsewhere ' || c_custkey END AS name,
  27.0 + (c_custkey % 100) / 100 AS lat, -82.0 - (c_custkey % 100) / 100 AS lng, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey || ' Map Ave' END AS street,
  'Tampa' AS locality, CASE WHEN c_custkey % 2 = 0 THEN 'FL' ELSE ' ' END AS region, '33602' AS postcode, '8135550100' AS phone, 'https://map.example.com/' || c_custkey AS website FROM customer),
rk AS (SELECT *, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS k FROM reg),
pk AS (SELECT *, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS k FROM v_places),
m AS (SELECT p.id, r.*, row_number() OVER (PARTITION BY p.id ORDER BY (p.k <> r.k), abs(length(p.k) - length(r.k)), r.map_id) AS rn
  FROM pk p JOIN rk r ON p.city = r.city AND (p.k = r.k OR (length(p.k) >= 4 AND length(r.k) >= 4 AND (contains(p.k, r.k) OR contains(r.k, p.k)))))"""


def registry(t):
    key = F.col("c_custkey")
    name = (F.when(key % 4 == 0, F.col("c_name")).when(key % 4 == 1, F.concat("c_name", F.lit(" Tampa")))
            .when(key % 4 == 2, F.substr("c_name", F.lit(9))).otherwise(F.concat(F.lit("Elsewhere "), key)))
    return t.raw("customer").select(
        key.alias("map_id"), city_of(F.col("c_nationkey")).alias("city"), name.alias("name"),
        (F.lit(27.0) + (key % 100) / 100).alias("lat"), (F.lit(-82.0) - (key % 100) / 100).alias("lng"),
        F.when(key % 5 != 0, F.concat(key.cast("string"), F.lit(" Map Ave"))).alias("street"),
        F.lit("Tampa").alias("locality"), F.when(key % 2 == 0, "FL").otherwise(" ").alias("region"),
        F.lit("33602").alias("postcode"), F.lit("8135550100").alias("phone"),
        F.concat(F.lit("https://map.example.com/"), key).alias("website"))


@query("places_verified", f"""WITH {_REG} SELECT p.id, m.map_id, m.map_id IS NOT NULL AS verified,
  CASE WHEN m.map_id IS NOT NULL THEN array_to_string(list_filter([m.street, m.locality, trim(m.region), m.postcode], lambda x: x <> ''), ', ') END AS map_address,
  round(CASE WHEN m.map_id IS NOT NULL THEN m.lat ELSE p.lat END, 6) AS lat, coalesce(p.website_url, m.website) AS website_url
FROM pk p LEFT JOIN m ON m.id = p.id AND m.rn = 1""")
def places_verified(t):
    return P.verify(t.places(), registry(t)).select(
        "id", "map_id", "verified", "map_address", F.round("lat", 6).alias("lat"), "website_url")


def hav(a: str, b: str, c: str, d: str) -> str:
    h = f"(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))"
    return f"(12742 * atan2(sqrt({h}), sqrt(1 - {h})))"


_CENTRES = "cities AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{c[0]}', {c[2]}::DOUBLE, {c[3]}::DOUBLE)" for i, c in enumerate(CITIES)) + ") c(pos, centre, c_lat, c_lng))"


@query("places_in_radius", f"""WITH {_CENTRES}, d AS (SELECT id, centre, {hav('lat', 'lng', 'c_lat', 'c_lng')} AS km FROM v_places, cities)
SELECT id, centre, round(km, 6) AS km FROM d WHERE d.km <= 15""")
def places_in_radius(t):
    return P.within_radius(t.places()).select("id", "centre", F.round("km", 6).alias("km"))


@query("places_nearest_city", f"""WITH {_CENTRES}, d AS (SELECT id, pos, centre, lat, lng, {hav('lat', 'lng', 'c_lat', 'c_lng')} AS km FROM v_places, cities)
SELECT id, arg_min(centre, km) AS nearest, any_value(lat BETWEEN 26.5 AND 29.0 AND lng BETWEEN -83.5 AND -81.5) AS in_box FROM d GROUP BY id""")
def places_nearest_city(t):
    lat, lng = F.col("lat"), F.col("lng")
    return t.places().select("id", geo.nearest_city(lat, lng).alias("nearest"), geo.in_box(lat, lng).alias("in_box"))


@query("search_grid", f"""WITH {FOUND}, {_CENTRES}, types AS (SELECT unnest(['beaches', 'bars', 'restaurants', 'breweries', 'hidden_gems', 'live_music']) AS search_type)
SELECT centre AS city, t.search_type, count(f.pos) AS n FROM cities CROSS JOIN types t LEFT JOIN found f ON f.city = centre AND f.search_type = t.search_type GROUP BY ALL""")
def search_grid(t):
    return P.search_grid(found(t))


_BAD_IMAGE = "(regexp_matches(image_url, '(?i)\\.(svg|ico|gif)$'))"
PHONE = """CASE WHEN length(d) = 10 THEN '(' || substr(d, 1, 3) || ') ' || substr(d, 4, 3) || '-' || substr(d, 7)
  WHEN length(d) = 11 AND starts_with(d, '1') THEN '(' || substr(d, 2, 3) || ') ' || substr(d, 5, 3) || '-' || substr(d, 8)
  WHEN length(d) BETWEEN 7 AND 15 THEN trim(phone_number) END"""
_PASS = f"""near AS (SELECT id, arg_min(centre, {hav('lat', 'lng', 'c_lat', 'c_lng')}) AS new_city FROM v_places, cities GROUP BY id),
ps AS (SELECT p.*, {PHONE} AS new_phone, new_city, CASE WHEN id % 8 = 1 THEN 'Mon-Fri 11:00am-10:00pm' ELSE array_to_string(hours, '|') END AS new_hours,
  CASE WHEN {_BAD_IMAGE} THEN NULL ELSE image_url END AS new_image
  FROM (SELECT *, regexp_replace(phone_number, '[^0-9]', '', 'g') AS d FROM v_places) p JOIN near USING (id))"""


@query("place_normalization", f"WITH {_CENTRES}, {_PASS} SELECT id, new_phone AS phone_number, new_hours AS hours, new_image AS image_url, new_city AS city FROM ps")
def place_normalization(t):
    return P.normalization_pass(t.places()).select(
        "id", "phone_number", F.array_join("hours", "|").alias("hours"), "image_url", "city")


@query("place_normalization_counts", f"""WITH {_CENTRES}, {_PASS}
SELECT count(*) AS total, count(*) FILTER (WHERE new_phone IS DISTINCT FROM phone_number OR id % 8 = 1 OR new_image IS DISTINCT FROM image_url OR new_city <> city) AS updated,
  count(*) FILTER (WHERE new_phone IS DISTINCT FROM phone_number) AS phone_number, count(*) FILTER (WHERE id % 8 = 1) AS hours,
  count(*) FILTER (WHERE new_image IS DISTINCT FROM image_url) AS image_url, count(*) FILTER (WHERE new_city <> city) AS city,
  count(*) FILTER (WHERE NOT (lat BETWEEN 26.5 AND 29.0 AND lng BETWEEN -83.5 AND -81.5) OR new_image IS NULL OR address IS NULL) AS needs_enrich FROM ps""")
def place_normalization_counts(t):
    return P.normalization_counts(P.normalization_pass(t.places()))


@query("places_to_enrich", f"""SELECT id FROM v_places WHERE NOT (lat BETWEEN 26.5 AND 29.0 AND lng BETWEEN -83.5 AND -81.5)
OR image_url IS NULL OR {_BAD_IMAGE} OR address IS NULL""")
def places_to_enrich(t):
    return t.places().filter(P.needs_enrichment()).select("id")


@query("places_reconciled", f"""WITH f AS (SELECT id, 'https://new.example.com/' || id || '.png' AS fi, CASE WHEN id % 2 = 0 THEN id || ' New St' END AS fa, 4.5 AS fr FROM v_places WHERE id % 3 <> 0)
SELECT p.id, CASE WHEN (image_url IS NULL OR {_BAD_IMAGE}) AND fi IS NOT NULL THEN fi ELSE image_url END AS image_url, coalesce(address, fa) AS address,
  CASE WHEN web_rating = 0 AND fr IS NOT NULL THEN 4.5 ELSE web_rating END AS web_rating,
  ((image_url IS NULL OR {_BAD_IMAGE}) AND fi IS NOT NULL) OR (address IS NULL AND fa IS NOT NULL) OR (web_rating = 0 AND fr IS NOT NULL) AS updated
FROM v_places p LEFT JOIN f USING (id)""")
def places_reconciled(t):
    return _reconciled(t).select("id", "image_url", "address", "web_rating", "updated")


def _reconciled(t):
    none = F.lit(None)
    fresh = t.places().filter("id % 3 <> 0").select(
        "id", none.cast("double").alias("f_lat"), none.cast("double").alias("f_lng"),
        F.concat(F.lit("https://new.example.com/"), "id", F.lit(".png")).alias("f_image_url"),
        F.when(F.col("id") % 2 == 0, F.concat(F.col("id").cast("string"), F.lit(" New St"))).alias("f_address"),
        none.cast("string").alias("f_phone_number"), none.cast("array<string>").alias("f_hours"),
        F.lit(4.5).alias("f_web_rating"), none.cast("int").alias("f_web_review_count"))
    return P.reconcile(t.places(), fresh)


@query("reconcile_counts", f"""WITH f AS (SELECT id, id % 2 = 0 AS fa FROM v_places WHERE id % 3 <> 0)
SELECT count(*) AS total, count(*) FILTER (WHERE f.id IS NOT NULL AND (image_url IS NULL OR {_BAD_IMAGE} OR (address IS NULL AND fa) OR web_rating = 0)) AS enriched,
  0::BIGINT AS coords_fixed, count(*) FILTER (WHERE f.id IS NOT NULL AND (image_url IS NULL OR {_BAD_IMAGE})) AS image_resolved
FROM v_places p LEFT JOIN f USING (id)""")
def reconcile_counts(t):
    return P.reconcile_counts(_reconciled(t))


@query("places_image_filled", """SELECT id, CASE WHEN image_url IS NULL AND website_url IS NOT NULL AND id % 2 = 0 THEN 'https://og.example.com/' || id ELSE image_url END AS image_url FROM v_places""")
def places_image_filled(t):
    images = t.places().filter("website_url is not null and id % 2 = 0").select(
        "website_url", F.concat(F.lit("https://og.example.com/"), "id").alias("page_image"))
    return P.fill_images(t.places(), images).select("id", "image_url")


@query("place_scores", """SELECT id, round(CASE WHEN web_rating = 0 THEN 0.5 * 0.85 ELSE least(1, 0.5 * 0.5 + web_rating / 5 * 0.35
  + CASE WHEN web_review_count = 0 THEN 0 ELSE least(1, log2(web_review_count + 1) / log2(200)) * 0.15 END) END, 6) AS blended FROM v_places""")
def place_scores(t):
    return t.places().select(
        "id", F.round(scores.blend_score(F.lit(0.5), F.col("web_rating"), F.col("web_review_count")), 6).alias("blended"))


@query("place_field_checks", f"""SELECT id, {PHONE} AS phone_number, coalesce(NOT {_BAD_IMAGE}, false) AS image_ok,
  CASE WHEN id % 5 < 4 THEN repeat('$', CAST(id % 5 + 1 AS INTEGER)) END AS price_range
FROM (SELECT *, regexp_replace(phone_number, '[^0-9]', '', 'g') AS d FROM v_places)""")
def place_field_checks(t):
    price = F.repeat(F.lit("$"), (F.col("id") % 5 + 1).cast("int"))
    return t.places().select(
        "id", FP.phone(F.col("phone_number")).alias("phone_number"), urls.plausible_image(F.col("image_url")).alias("image_ok"),
        FP.price_range(F.concat(F.lit(" "), price)).alias("price_range"))


@query("place_labels", """SELECT p.id, CASE category WHEN 'venue' THEN 'Venue' WHEN 'shop' THEN 'Shop' WHEN 'attraction' THEN 'Attraction' WHEN 'cafe' THEN 'Café'
  WHEN 'gallery' THEN 'Gallery' ELSE 'Place' END AS category_label,
  array_to_string(list_transform(vibes, lambda v: CASE v WHEN 'waterfront' THEN 'Waterfront' WHEN 'brunch' THEN 'Brunch' ELSE 'Romantic' END), '|') AS vibe_labels,
  'https://www.google.com/maps/search/?api=1&query=' || replace(address, ' ', '%20') AS map_url FROM v_places p""")
def place_labels(t):
    return t.places().select(
        "id", lookup(CATEGORY_LABELS, F.col("category")).alias("category_label"),
        F.array_join(F.transform("vibes", lambda v: lookup(VIBE_LABELS, v, v)), "|").alias("vibe_labels"),
        text.map_search_url(F.col("address")).alias("map_url"))


@query("hours_lists", """SELECT id, CASE WHEN id % 3 = 0 OR hours IS NULL THEN '' ELSE array_to_string(hours, '|') END AS entries FROM v_places""")
def hours_lists(t):
    """Stored hours as JSON text, broken in every third row, back to their entries."""
    json = F.when(F.col("id") % 3 == 0, "{no json").otherwise(F.to_json("hours"))
    return t.places().select("id", F.array_join(I.hours_list(json), "|").alias("entries"))


_SLUG = "left(trim(regexp_replace(lower({0} || '-' || {1}), '[^a-z0-9]+', '-', 'g'), '-'), 80)"


def _incoming(found):
    """Discovered rows with the fields that later stages fill, empty."""
    none = lambda kind: F.lit(None).cast(kind)
    return P.incoming_places(found.withColumns({
        **{c: none("string") for c in ("address", "map_address", "phone_number", "image_url")}, **{c: none("double") for c in ("lat", "lng", "web_rating")},
        "web_review_count": none("int"), "hours": none("array<string>"), "source_id": F.lit(1)}))


def _stored_by_slug(t):
    """The stored places, every second one under the slug of its name."""
    slug = F.when(F.col("id") % 2 == 0, text.place_slug(F.col("name"), F.col("city"))).otherwise(F.col("slug"))
    return t.places().withColumns({"slug": slug, "source_id": F.lit(1), "content_hash": F.lit("old")})


@query("discovery_counts", f"""WITH {FOUND}, fresh AS (SELECT * FROM firsts WHERE NOT EXISTS (SELECT 1 FROM v_places p
  WHERE p.id % 4 = 0 AND p.city = firsts.city AND regexp_replace(lower(p.name), '[^a-z0-9]', '', 'g') = firsts.k))
SELECT 'existing_places' AS counter, count(*) AS n FROM v_places UNION ALL SELECT 'discovered', count(*) FROM found UNION ALL SELECT 'after_dedup', count(*) FROM firsts
UNION ALL SELECT 'new_candidates', count(*) FROM fresh UNION ALL SELECT 'upserted', count(*) FROM fresh UNION ALL SELECT 'skipped_unchanged', 0""")
def discovery_counts(t):
    rows, firsts = found(t), P.first_per_name(found(t)).drop("name_key")
    fresh = P.new_candidates(firsts, t.places().filter("id % 4 = 0").select("name", "city"))
    plan = upsert.plan_upsert(_stored_by_slug(t), _incoming(fresh), ["source_id", "slug"], NOW)
    return P.discovery_counts({"existing_places": t.places(), "discovered": rows, "after_dedup": firsts, "new_candidates": fresh}, plan)


@query("place_inserts", f"""WITH {FOUND}, old AS (SELECT {_SLUG.format('name', 'city')} AS slug FROM v_places WHERE id % 2 = 0)
SELECT {_SLUG.format('f.name', 'f.city')} AS slug, f.name, CASE WHEN old.slug IS NULL THEN 'inserted' ELSE 'updated' END AS outcome
FROM firsts f LEFT JOIN old ON old.slug = {_SLUG.format('f.name', 'f.city')}""")
def place_inserts(t):
    """Discovered places into the stored ones: every second is known under its slug."""
    plan = upsert.plan_upsert(_stored_by_slug(t), _incoming(P.first_per_name(found(t))), ["source_id", "slug"], NOW)
    return plan.filter("outcome is not null").select("slug", "name", "outcome")


@query("source_ranks", """SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 14 WHEN 2 THEN 3 ELSE 115 END AS rank FROM supplier""")
def source_ranks(t):
    slugs = F.array(*[F.lit(s) for s in ("eventbrite", "ticketmaster", "tampa_gov", "dunedin_gov")])
    key = F.col("s_suppkey")
    return t.raw("supplier").select(
        key.alias("id"), source_rank(F.element_at(slugs, (key % 4 + 1).cast("int"))).alias("rank"))
