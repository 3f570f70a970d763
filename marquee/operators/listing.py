"""Listing reads: visible rows, overlay, ranking, facets, coverage, groups.

``listings`` carries ``source_id`` and ``canonical_id``; ``sources`` carries
``enabled``, ``source_slug`` and ``source_rank``. Sources are joined without a
hint: Spark broadcasts them while they are under its size threshold and
shuffles them when they are not.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from marquee.dims import CITY_KEYS, CITY_LABELS, lookup
from marquee.functions.clock import format_day, is_fresh, local_day
from marquee.functions.scores import effective_score
from marquee.functions.tags import matches_tags, tag_set
from marquee.operators.resolve import has_image


def visible(listings: DataFrame, sources: DataFrame, low: datetime, high: datetime,
            cities: list[str] | None = None, free_only: bool = False) -> DataFrame:
    """Rows of enabled sources starting in [low, high], both ends included."""
    keep = F.col("start_at").between(F.lit(low), F.lit(high))
    if cities:
        keep = keep & F.col("city").isin(*cities)
    if free_only:
        keep = keep & F.col("is_free")
    shown = sources.filter("enabled").select("source_id", "source_slug", "source_rank")
    return listings.filter(keep).join(shown, "source_id")


def plain_price(df: DataFrame) -> DataFrame:
    """Decimal prices as finite doubles."""
    for c in ("price_min", "price_max"):
        if c in df.columns:
            df = df.withColumn(c, F.col(c).cast("double"))
    return df


def group_display(rows: DataFrame, payload: list[str], keys: tuple[str, ...] = ("canonical_id",)) -> DataFrame:
    """Display row, duplicate count and other sources per canonical group.

    Two partial aggregations, by (group, source) and by group: no window and no
    list of members, so one group may hold any share of the rows.
    """
    best = F.min(F.struct(
        (~has_image(F.col("image_url"))).alias("bare"), "source_rank", "start_at", "id",
        F.struct(*payload).alias("row"), F.col("source_slug").alias("slug")))
    per_source = rows.groupBy(*keys, "source_slug").agg(best.alias("best"), F.count("*").alias("n"))
    grouped = per_source.groupBy(*keys).agg(
        F.min("best").alias("best"), F.sum("n").alias("duplicate_count"),
        F.collect_list(F.struct("source_slug", "n")).alias("slugs"))
    others = F.filter("slugs", lambda s: (s["source_slug"] != F.col("best.slug")) | (s["n"] > 1))
    return grouped.select(
        *keys, F.col("best.start_at").alias("start_at"), F.col("best.id").alias("id"),
        "best.row.*", "duplicate_count",
        F.array_sort(F.transform(others, lambda s: s["source_slug"])).alias("also_on"))


EDITORIAL = ["editorial_score", "editorial_updated_at", "why_its_cool", "vibes", "audience", "indoor_outdoor"]


def overlay(rows: DataFrame, canonicals: DataFrame, how: str = "inner") -> DataFrame:
    """Canonical title, summary and tags over those of the row, plus editorial fields."""
    c = canonicals.select("canonical_id", "deduped_title", "summary", "tags", *EDITORIAL)
    out = rows.join(c, "canonical_id", how)
    return (
        out.withColumn("title", F.coalesce("deduped_title", "title"))
        .withColumn("description", F.coalesce("summary", "description"))
        .withColumn("categories", F.when(F.size("tags") > 0, F.col("tags")).otherwise(F.col("categories")))
        .drop("deduped_title", "summary", "tags")
    )


def with_group(rows: DataFrame, canonicals: DataFrame) -> DataFrame:
    """Rows with the columns of their group; a row without one joins by its id, so such rows spread over all tasks."""
    group = F.concat(F.lit("g"), "canonical_id")
    return rows.withColumn("unit", F.coalesce(group, F.concat(F.lit("e"), "id"))).join(
        canonicals.withColumn("unit", group).drop("canonical_id"), "unit", "left").drop("unit")


PAYLOAD = ["title", "description", "city", "categories", "image_url", "venue_name",
           "is_free", "all_day", "end_at", "price_min", "price_max"]


def listing(rows: DataFrame, canonicals: DataFrame, now: datetime,
            payload: list[str] | None = None) -> DataFrame:
    """Visible rows, one per group plus the ungrouped ones, with their ``rank_score``.

    One pass: an ungrouped row is a group of its own, keyed by its id (``solo``).
    It joins by its id as well, so the null group ids spread over all tasks.
    """
    payload = payload or [c for c in PAYLOAD if c in rows.columns]
    solo = F.when(F.col("canonical_id").isNull(), F.col("id").cast("string")).otherwise("")
    units = group_display(rows.withColumn("solo", solo), payload, ("canonical_id", "solo"))
    groups = canonicals.select("canonical_id", "deduped_title", "summary", "tags", *EDITORIAL, F.lit(True).alias("known"))
    joined = with_group(units, groups).filter(F.col("canonical_id").isNull() | F.col("known"))
    out = joined.withColumns({
        "title": F.coalesce("deduped_title", "title"),
        "description": F.coalesce("summary", "description"),
        "categories": F.when(F.size("tags") > 0, F.col("tags")).otherwise(F.col("categories")),
        "vibes": F.coalesce("vibes", F.array().cast("array<string>")),
        "rank_score": effective_score(F.col("editorial_score"), F.col("editorial_updated_at"),
                                      F.col("why_its_cool"), F.lit(now)),
    })
    return plain_price(out.drop("deduped_title", "summary", "tags", "known", "solo"))


def ranking() -> list[Column]:
    return [F.desc("rank_score"), F.asc("start_at"), F.asc("id")]


def top(df: DataFrame, limit: int = 100) -> DataFrame:
    return df.orderBy(*ranking()).limit(limit)


def event_detail(rows: DataFrame, sources: DataFrame, canonicals: DataFrame) -> DataFrame:
    """Point reads by id: disabled sources hidden, canonical fields laid over."""
    shown = sources.filter("enabled").select("source_id")
    return overlay(rows.join(shown, "source_id", "left_semi"), canonicals, "left")


def upcoming_by_ids(rows: DataFrame, sources: DataFrame, ids: DataFrame, now: datetime) -> DataFrame:
    """Listed ids still to start, from enabled sources."""
    shown = sources.filter("enabled").select("source_id")
    return (
        rows.filter(F.col("start_at") >= F.lit(now))
        .join(ids.select("id"), "id", "left_semi").join(shown, "source_id", "left_semi")
    )


def city_facet(rows: DataFrame) -> DataFrame:
    """Events per city: one vote per group (its smallest city), one per legacy row."""
    legacy = F.col("canonical_id").isNull()
    units = rows.groupBy("canonical_id", F.when(legacy, F.col("city")).alias("own")).agg(
        F.min("city").alias("city"), F.count("*").alias("n"))
    votes = F.when(legacy, F.col("n")).otherwise(F.lit(1))
    return units.groupBy("city").agg(F.sum(votes).alias("n"))


def all_cities(spark) -> DataFrame:
    return spark.createDataFrame(
        [(k, CITY_LABELS[k], i) for i, k in enumerate(CITY_KEYS)], "city string, label string, pos int")


def facet_total(facet: DataFrame) -> DataFrame:
    """One row: the events of all known cities."""
    known = F.when(F.col("city").isin(CITY_KEYS), F.col("n"))
    return facet.agg(F.coalesce(F.sum(known), F.lit(0)).alias("total"))


def filled_facet(facet: DataFrame, selected: list[str] | None = None) -> DataFrame:
    """The facet over every city key, zeros filled; ``shown`` is non-zero or selected."""
    cities = all_cities(facet.sparkSession)
    n = F.coalesce("n", F.lit(0)).alias("n")
    chosen = F.col("city").isin(*selected) if selected else F.lit(False)
    return cities.join(facet, "city", "left").select(
        "city", "label", "pos", n, ((F.coalesce("n", F.lit(0)) > 0) | chosen).alias("shown"))


def window_total(rows: DataFrame) -> DataFrame:
    """Groups plus legacy rows, in one pass."""
    per_group = rows.groupBy("canonical_id").agg(F.count("*").alias("n"))
    units = F.when(F.col("canonical_id").isNull(), F.col("n")).otherwise(F.lit(1))
    return per_group.agg(F.coalesce(F.sum(units), F.lit(0)).alias("total"))


def coverage(rows: DataFrame, canonicals: DataFrame, now: datetime) -> DataFrame:
    """Visible and freshly curated counts, percentage, last refresh: one aggregate."""
    per_group = rows.groupBy("canonical_id").agg(F.count("*").alias("n"))
    joined = per_group.join(
        canonicals.select("canonical_id", "editorial_score", "editorial_updated_at",
                          F.lit(True).alias("known")), "canonical_id", "left")
    known = F.coalesce("known", F.lit(False))
    units = F.when(F.col("canonical_id").isNull(), F.col("n")).when(known, F.lit(1)).otherwise(F.lit(0))
    curated = known & F.col("editorial_score").isNotNull() & is_fresh(F.col("editorial_updated_at"), F.lit(now))
    counts = joined.agg(
        F.coalesce(F.sum(units), F.lit(0)).alias("visible_count"),
        F.count_if(curated).alias("curated_count"),
        F.max("editorial_updated_at").alias("refreshed_at"))
    pct = F.when(F.col("visible_count") == 0, 0).otherwise(
        F.floor(F.col("curated_count") * 100 / F.col("visible_count") + 0.5))
    return counts.withColumn("coverage_pct", pct.cast("bigint"))


def tag_facet(rows: DataFrame) -> DataFrame:
    """Listings per canonical tag, each listing counted once per tag."""
    return (
        rows.select(F.explode(tag_set(F.col("categories"))).alias("tag"))
        .groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag")
    )


def by_local_day(rows: DataFrame) -> DataFrame:
    """Rows with their local day key and label, ready to order by day."""
    return rows.withColumn("day_key", local_day(F.col("start_at"))).withColumn(
        "day_label", format_day(F.col("start_at")))


def standouts(ranked: DataFrame, now: datetime, min_score: float = 0.7, limit: int = 3) -> DataFrame:
    """The first few highly and recently scored rows in listing order."""
    strong = (F.col("editorial_score") >= min_score) & is_fresh(F.col("editorial_updated_at"), F.lit(now))
    return top(ranked.filter(strong), limit)


def remainder(ranked: DataFrame, taken: DataFrame, key: str = "id") -> DataFrame:
    return ranked.join(taken.select(key), key, "left_anti")


def saved_counts(saved: DataFrame, rows: DataFrame, now: datetime, tags: list[str]) -> DataFrame:
    """Per session: saved listings still to start and those within a day."""
    wanted = rows.filter((F.col("start_at") >= F.lit(now)) & matches_tags(F.col("categories"), tags))
    soon = F.unix_micros("start_at") < F.unix_micros(F.lit(now)) + 86_400_000_000
    return saved.join(wanted.select("id", "start_at"), "id").groupBy("session_id").agg(
        F.count("*").alias("upcoming"), F.count_if(soon).alias("within_day"))


def saved_view(rows: DataFrame, saved: DataFrame, now: datetime, tags: list[str], saved_only: bool) -> DataFrame:
    """Tag-matched rows; only saved ones when asked and any of those is upcoming."""
    base = rows.filter(matches_tags(F.col("categories"), tags))
    if not saved_only:
        return base
    upcoming = base.filter(F.col("start_at") >= F.lit(now)).join(saved.select("id"), "id", "left_semi")
    guard = upcoming.agg((F.count("*") > 0).alias("any")).scalar()
    marked = base.join(saved.select("id").distinct().withColumn("saved", F.lit(True)), "id", "left")
    return marked.filter(~guard | F.coalesce("saved", F.lit(False))).drop("saved")


def merge_later_wins(first: DataFrame, second: DataFrame, key: str = "id") -> DataFrame:
    """Union by key; a row of ``second`` replaces the one of ``first``."""
    return first.join(second.select(key), key, "left_anti").unionByName(second)


def needs_refresh(canonicals: DataFrame, now: datetime, hours: int = 48) -> DataFrame:
    """Canonical rows never curated, or curated too long ago."""
    bare = (F.coalesce("summary", F.lit("")) == "") | F.col("editorial_score").isNull()
    return canonicals.filter(bare | ~is_fresh(F.col("editorial_updated_at"), F.lit(now), hours))


def page_after(df: DataFrame, key: str, cursor, size: int = 100) -> DataFrame:
    """Keyset page: the next ``size`` rows after ``cursor``."""
    page = df if cursor is None else df.filter(F.col(key) > cursor)
    return page.orderBy(key).limit(size)


def enabled_sources(known: DataFrame, rows: DataFrame) -> DataFrame:
    """Adapters kept unless a stored row disables them."""
    state = rows.select("source_slug", "enabled")
    return known.join(state, "source_slug", "left").filter(F.coalesce("enabled", F.lit(True))).drop("enabled")


def trust_line(df: DataFrame, now: datetime) -> DataFrame:
    """Labels of a coverage row."""
    from marquee.functions.clock import relative_hours
    return df.withColumn("refreshed", relative_hours(F.col("refreshed_at"), F.lit(now)))


def city_label(c: Column) -> Column:
    return lookup(CITY_LABELS, c)
