"""Places: lists, discovery, verification, reconciliation, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from marquee.dims import (
    CATEGORY_LABELS_PLURAL, CITIES, PLACE_CATEGORIES, SEARCH_TYPES,
)
from marquee.functions.geo import haversine_km, in_box, nearest_city
from marquee.functions.hashes import place_hash
from marquee.functions.places import opening_hours, phone
from marquee.functions.text import join_parts, name_key, nonempty, place_category, place_slug
from marquee.functions.urls import plausible_image

MIN_NAME = 4


def filtered_places(places: DataFrame, cities=None, categories=None, vibes=None) -> DataFrame:
    keep = F.lit(True)
    if cities:
        keep = keep & F.col("city").isin(*cities)
    if categories:
        keep = keep & F.col("category").isin(*categories)
    if vibes:
        keep = keep & F.arrays_overlap("vibes", F.array(*[F.lit(v) for v in vibes]))
    return places.filter(keep)


def ranked_places(places: DataFrame, limit: int = 100) -> DataFrame:
    return places.orderBy(F.desc_nulls_last("editorial_score"), F.asc("name")).limit(limit)


def standout_places(places: DataFrame, min_score: float = 0.6, limit: int = 3) -> DataFrame:
    return ranked_places(places.filter(F.col("editorial_score") >= min_score), limit)


def category_groups(places: DataFrame) -> DataFrame:
    """Places per category in display order; empty categories drop."""
    order = places.sparkSession.createDataFrame(
        [(i, c, CATEGORY_LABELS_PLURAL[c]) for i, c in enumerate(PLACE_CATEGORIES)],
        "pos int, category string, label string")
    counts = places.groupBy(F.coalesce(nonempty(F.col("category")), F.lit("other")).alias("category")).agg(
        F.count("*").alias("n"))
    return counts.join(order, "category").select("pos", "category", "label", "n")


def first_per_name(found: DataFrame) -> DataFrame:
    """First candidate (by ``pos``) per normalized name and city."""
    row = F.struct(*found.columns)
    return (
        found.groupBy(name_key(F.col("name")).alias("name_key"), "city")
        .agg(F.min_by(row, "pos").alias("row")).select("row.*", "name_key")
    )


def new_candidates(found: DataFrame, known: DataFrame) -> DataFrame:
    """Candidates whose normalized name is not known in their city."""
    keys = known.select("city", name_key(F.col("name")).alias("name_key")).distinct()
    return found.withColumn("name_key", name_key(F.col("name"))).join(keys, ["city", "name_key"], "left_anti")


def _substrings(names: DataFrame, lengths: list[int]) -> DataFrame:
    """``names`` with ``part``: each distinct substring of ``name_key`` that is shorter and has one of these lengths."""
    name = F.col("name_key")

    def of_length(n: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(name) - n + 1), lambda i: F.substr(name, i, n))

    known = F.array(*[F.lit(n) for n in lengths]).cast("array<int>")
    fitting = F.filter(known, lambda n: n < F.length(name))
    return names.withColumn("part", F.explode(F.array_distinct(F.flatten(F.transform(fitting, of_length)))))


def _nearest_nested(names: DataFrame, registry: DataFrame) -> DataFrame:
    """(city, name_key, map_id): the registry name inside or around each name, closest in length, then smallest id.

    One side's names are a dictionary that is probed with the other side's
    substrings of the lengths present in it, both ways. Hits are folded to the
    best one of each name as they are found: no list of pairs is built, so a
    short name that lies in all others costs a row for each of them. Both sides
    grow with their tables and are merged, never broadcast.
    """

    def lengths(df: DataFrame) -> list[int]:
        return sorted(r[0] for r in df.select(F.length("name_key")).distinct().collect())  # of names: a few dozen

    apart = F.abs(F.length("reg_key") - F.length("name_key"))
    rank = F.struct(apart.alias("apart"), "map_id")
    inside = _substrings(registry, lengths(names)).select(
        "city", F.col("part").alias("name_key"), F.col("name_key").alias("reg_key"), "map_id").join(
        names.hint("merge"), ["city", "name_key"], "left_semi")
    around = _substrings(names, lengths(registry)).select("city", "name_key", F.col("part").alias("reg_key")).join(
        registry.withColumnRenamed("name_key", "reg_key").hint("merge"), ["city", "reg_key"])
    both = [hits.groupBy("city", "name_key").agg(F.min(rank).alias("best")) for hits in (inside, around)]
    return both[0].unionByName(both[1]).groupBy("city", "name_key").agg(F.min("best")["map_id"].alias("map_id"))


def verify(places: DataFrame, registry: DataFrame) -> DataFrame:
    """Match places with a map registry of their city by name.

    Exact normalized names first; else nested names of four or more characters,
    closest in length, then smallest id. Matched rows take the registry's
    coordinates and address and fill a missing phone or website; the others keep
    their own coordinates. ``registry`` has map_id, city, name, lat, lng, street,
    locality, region, postcode, phone, website.
    """
    reg = registry.withColumn("name_key", name_key(F.col("name"))).filter("name_key <> ''")
    fields = ["map_id", "lat", "lng", "street", "locality", "region", "postcode", "phone", "website"]
    entry = F.struct("map_id", *[F.col(f) for f in fields[1:]])
    # Well compressed names look small to the planner and are not so on the driver: all joins are merges.
    one = reg.groupBy("city", "name_key").agg(F.min_by(entry, "map_id").alias("entry"))
    keyed = places.withColumn("name_key", name_key(F.col("name")))
    names = keyed.select("city", "name_key").distinct()

    long_names = names.filter(F.length("name_key") >= MIN_NAME)
    long_reg = one.select("city", "name_key", F.col("entry.map_id").alias("map_id")).filter(F.length("name_key") >= MIN_NAME)
    left = long_names.join(long_reg.hint("merge"), ["city", "name_key"], "left_anti")
    best = _nearest_nested(left, long_reg)
    entries = one.select("city", F.col("entry").alias("near"), F.col("entry.map_id").alias("map_id"))
    near = best.join(entries.hint("merge"), ["city", "map_id"]).select("city", "name_key", "near")
    joined = keyed.join(one.hint("merge"), ["city", "name_key"], "left").join(near.hint("merge"), ["city", "name_key"], "left")
    hit = F.coalesce("entry", "near")
    address = F.when(hit.isNotNull(), nonempty(join_parts(
        [F.coalesce(hit[f], F.lit("")) for f in ("street", "locality", "region", "postcode")])))
    out = joined.withColumns({
        "map_id": hit["map_id"], "verified": hit.isNotNull(), "map_address": address,
        "lat": F.when(hit.isNotNull(), hit["lat"]).otherwise(F.col("lat")),
        "lng": F.when(hit.isNotNull(), hit["lng"]).otherwise(F.col("lng")),
        "phone_number": F.coalesce("phone_number", hit["phone"]),
        "website_url": F.coalesce("website_url", hit["website"])})
    return out.drop("entry", "near", "name_key")


def city_points(spark) -> DataFrame:
    return spark.createDataFrame([(c[0], c[2], c[3]) for c in CITIES], "city string, c_lat double, c_lng double")


def within_radius(places: DataFrame, km: float = 15.0, limit: int | None = None) -> DataFrame:
    """Places within ``km`` of each of the seven centroids, nearest first.

    Equi-join on grid cells at least ``km`` wide. The centroid side is constant
    (seven points, nine cells each).
    """
    step_lat, step_lng = km / 110.0, km / 85.0  # degrees never shorter than km at these latitudes
    cell_lat, cell_lng = F.floor(F.col("lat") / step_lat), F.floor(F.col("lng") / step_lng)
    offsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    centres = (
        city_points(places.sparkSession).withColumn("o", F.explode(offsets))
        .withColumn("gx", F.floor(F.col("c_lat") / step_lat) + F.col("o.i"))
        .withColumn("gy", F.floor(F.col("c_lng") / step_lng) + F.col("o.j"))
        .select(F.col("city").alias("centre"), "c_lat", "c_lng", "gx", "gy"))
    hits = (
        places.withColumn("gx", cell_lat).withColumn("gy", cell_lng)
        .join(F.broadcast(centres), ["gx", "gy"])
        .withColumn("km", haversine_km(F.col("lat"), F.col("lng"), F.col("c_lat"), F.col("c_lng")))
        .filter(F.col("km") <= km).drop("gx", "gy", "c_lat", "c_lng"))
    order = Window.partitionBy("centre").orderBy("km", "id")
    return hits if limit is None else hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def search_grid(known: DataFrame) -> DataFrame:
    """Known places per city and search type, zeros filled. Both axes are constant."""
    spark = known.sparkSession
    cells = spark.createDataFrame(
        [(c[0], s) for c in CITIES for s in SEARCH_TYPES], "city string, search_type string")
    counts = known.groupBy("city", "search_type").agg(F.count("*").alias("n"))
    return cells.join(counts, ["city", "search_type"], "left").na.fill(0, ["n"])


def fill_images(places: DataFrame, page_images: DataFrame) -> DataFrame:
    """Missing images from the place's web page; existing images stay."""
    pages = page_images.groupBy("website_url").agg(F.min("page_image").alias("page_image"))
    lacking = F.coalesce(F.col("image_url") == "", F.lit(True))
    return places.join(pages, "website_url", "left").withColumn(
        "image_url", F.when(lacking, F.coalesce("page_image", "image_url")).otherwise(F.col("image_url"))).drop("page_image")


def incoming_places(found: DataFrame) -> DataFrame:
    """Discovered rows in stored shape, with slug, category, city and content hash."""
    slug = place_slug(F.col("name"), F.col("city"))
    return found.withColumns({
        "source_place_id": slug, "slug": slug,
        "content_hash": place_hash(F.col("name"), F.col("city"), F.col("address"),
                                   F.col("web_rating"), F.col("web_review_count")),
        "category": place_category(F.col("category"), F.col("search_type")),
        "phone_number": phone(F.col("phone_number")),
        "hours": opening_hours(F.col("hours")),
        "image_url": F.when(plausible_image(F.col("image_url")), F.col("image_url")),
        "address": F.coalesce("map_address", "address"),
    }).withColumn("city", F.coalesce(nearest_city(F.col("lat"), F.col("lng")), F.col("city"))).drop("map_address")


def _changed(old: Column, new: Column) -> Column:
    return ~old.eqNullSafe(new)


def normalization_pass(places: DataFrame) -> DataFrame:
    """Normalized phone, hours, image and city next to flags of what changed."""
    bad_image = (F.coalesce("image_url", F.lit("")) != "") & ~plausible_image(F.col("image_url"))
    fresh = {
        "phone_number": phone(F.col("phone_number")),
        "hours": opening_hours(F.col("hours")),
        "image_url": F.when(bad_image, None).otherwise(F.col("image_url")),
        "city": F.coalesce(nearest_city(F.col("lat"), F.col("lng")), F.col("city")),
    }
    flags = {f"{c}_changed": _changed(F.col(c), new) for c, new in fresh.items()}
    return places.withColumns(flags).withColumns(fresh)


def normalization_counts(passed: DataFrame) -> DataFrame:
    """One row of counters; nothing is written by it (the dry run)."""
    names = ["phone_number", "hours", "image_url", "city"]
    touched = F.lit(False)
    for n in names:
        touched = touched | F.col(f"{n}_changed")
    return passed.agg(
        F.count("*").alias("total"), F.count_if(touched).alias("updated"),
        *[F.count_if(f"{n}_changed").alias(n) for n in names],
        F.count_if(needs_enrichment()).alias("needs_enrich"))


def needs_enrichment() -> Column:
    return (
        ~in_box(F.col("lat"), F.col("lng")) | ~plausible_image(F.col("image_url"))
        | (F.coalesce("address", F.lit("")) == "")
    )


def reconcile(places: DataFrame, fresh: DataFrame) -> DataFrame:
    """Fill only missing or invalid fields from a newer record of the same id.

    ``fresh`` has id and f_lat, f_lng, f_image_url, f_address, f_phone_number,
    f_hours, f_web_rating, f_web_review_count.
    """
    joined = places.join(fresh, "id", "left")
    move = ~in_box(F.col("lat"), F.col("lng")) & in_box(F.col("f_lat"), F.col("f_lng"))
    repaint = ~plausible_image(F.col("image_url")) & plausible_image(F.col("f_image_url"))

    def fill(name: str, new: Column, empty: Column) -> Column:
        return F.when(empty, F.coalesce(new, F.col(name))).otherwise(F.col(name))

    def blank(name: str) -> Column:
        return F.coalesce(F.col(name) == "", F.lit(True))

    def zero(name: str) -> Column:
        return F.coalesce(F.col(name) == 0, F.lit(True))

    out = joined.withColumns({
        "coords_fixed": move, "image_resolved": repaint,
        "_lat": F.when(move, F.col("f_lat")).otherwise(F.col("lat")),
        "_lng": F.when(move, F.col("f_lng")).otherwise(F.col("lng")),
        "_image_url": F.when(repaint, F.col("f_image_url")).otherwise(F.col("image_url")),
        "_address": fill("address", F.col("f_address"), blank("address")),
        "_phone_number": fill("phone_number", phone(F.col("f_phone_number")), blank("phone_number")),
        "_hours": fill("hours", opening_hours(F.col("f_hours")), F.col("hours").isNull()),
        "_web_rating": fill("web_rating", nonzero("f_web_rating"), zero("web_rating")),
        "_web_review_count": fill("web_review_count", nonzero("f_web_review_count"), zero("web_review_count")),
    })
    names = ["lat", "lng", "image_url", "address", "phone_number", "hours", "web_rating", "web_review_count"]
    changed = F.lit(False)
    for n in names:
        changed = changed | _changed(F.col(n), F.col(f"_{n}"))
    out = out.withColumn("updated", changed)
    return out.select(
        *[F.col(f"_{c}").alias(c) if c in names else F.col(c) for c in places.columns],
        "coords_fixed", "image_resolved", "updated")


def nonzero(name: str) -> Column:
    return F.nullif(F.col(name), F.lit(0))


def reconcile_counts(reconciled: DataFrame) -> DataFrame:
    """One row of counters of a reconciliation."""
    return reconciled.agg(
        F.count("*").alias("total"), F.count_if("updated").alias("enriched"),
        F.count_if(F.coalesce("coords_fixed", F.lit(False))).alias("coords_fixed"),
        F.count_if(F.coalesce("image_resolved", F.lit(False))).alias("image_resolved"))


def discovery_counts(stages: dict[str, DataFrame], plan: DataFrame) -> DataFrame:
    """(counter, n): rows out of each named stage of a discovery run, and what the upsert did with the last."""
    out = None
    for name, rows in stages.items():
        row = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("counter"), "n")
        out = row if out is None else out.unionByName(row)
    done = plan.agg(
        F.count_if(F.col("outcome").isin("inserted", "updated")).alias("upserted"),
        F.count_if(F.col("reason") == "hash_match").alias("skipped_unchanged"))
    return out.unionByName(done.unpivot([], ["upserted", "skipped_unchanged"], "counter", "n"))
