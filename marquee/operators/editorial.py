"""Editorial inputs, refresh gate, fallback, and curated values from a table.

Curated text comes from a table produced elsewhere; nothing here calls a model.
Lists shown to a curator are the first eight distinct values, cut per group
before they are collected, so one group may hold any share of the rows.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from marquee.functions.hashes import stable_hash
from marquee.functions.scores import blend_score
from marquee.functions.tags import canonical_tags
from marquee.functions.text import clean_inline, ellipsis, html_to_text, nonempty, ordered_distinct

LIST_LIMIT = 8
MIN_DESCRIPTION = 20


LANES = [f"l{i}" for i in range(4)]


def row_set_lanes(group: str, rows: DataFrame, *fields: str, extra: tuple = ()) -> DataFrame:
    """(group, n, l0 to l3): number of rows, and sums of four lanes of each row's SHA-256.

    ``extra`` holds further aggregates to take in the same pass. The sums are
    partial aggregates, so no group is collected, and they can be taken back:
    a multiset of rows that loses and gains some needs only those.
    """
    digest = stable_hash(**{f: F.col(f) for f in fields})
    lanes = [F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)") for i in range(4)]
    return rows.groupBy(group).agg(F.count("*").alias("n"), *[F.sum(v).alias(c) for c, v in zip(LANES, lanes)], *extra)


def lanes_hash() -> Column:
    """The hash of a multiset of rows from its lanes: order-free."""
    return F.sha2(F.concat_ws("|", "n", *LANES), 256)


def row_set_hash(group: str, rows: DataFrame, *fields: str, extra: tuple = ()) -> DataFrame:
    """(group, editorial_hash): hash of the multiset of rows."""
    return row_set_lanes(group, rows, *fields, extra=extra).withColumn("editorial_hash", lanes_hash()).drop("n", *LANES)


def _input_rows(members: DataFrame) -> DataFrame:
    return members.withColumns({"title": clean_inline(F.col("title")), "description": html_to_text(F.col("description"))})


INPUT_FIELDS = ("source_slug", "title", "description")


def group_lanes(members: DataFrame, group: str = "canonical_id") -> DataFrame:
    """The lanes behind the hash of ``editorial_inputs``, to be stored with each group."""
    return row_set_lanes(group, _input_rows(members), *INPUT_FIELDS)


def lanes_after(stored: DataFrame, before: DataFrame, after: DataFrame, group: str = "canonical_id") -> DataFrame:
    """Lanes and ``editorial_hash`` of the groups that a batch touches; other groups are not read.

    ``stored`` has the lanes of all groups; ``before`` and ``after`` are the
    changed members as they were and as they are, under the group that each had
    then. A deleted member is only in ``before``, a new one only in ``after``, and
    one that changes groups stands under both. A group without members is left out.
    """
    gained, lost = group_lanes(after, group), group_lanes(before, group)
    minus = lost.select(group, *[(-F.col(c)).cast(lost.schema[c].dataType).alias(c) for c in ("n", *LANES)])
    delta = gained.unionByName(minus).groupBy(group).agg(*[F.sum(c).alias(f"d_{c}") for c in ("n", *LANES)])
    sums = [(F.coalesce(c, F.lit(0)) + F.col(f"d_{c}")).cast(stored.schema[c].dataType).alias(c) for c in ("n", *LANES)]
    return stored.join(delta, group, "right").select(group, *sums).filter("n > 0").withColumn("editorial_hash", lanes_hash())


def first_values(rows: DataFrame, group: str, limit: int | None = LIST_LIMIT) -> DataFrame:
    """(group, kind, values): first ``limit`` distinct non-empty values per kind, or all of them.

    ``rows`` has group, kind, v and o (their order).
    """
    firsts = rows.filter("v <> ''").groupBy(group, "kind", "v").agg(F.min("o").alias("o"))
    if limit is None:
        return firsts.withColumn("at", F.col("o"))
    at = F.row_number().over(Window.partitionBy(group, "kind").orderBy("o", "v"))
    return firsts.withColumn("at", at).filter(F.col("at") <= limit)


def editorial_inputs(members: DataFrame, group: str = "canonical_id", limit: int | None = LIST_LIMIT) -> DataFrame:
    """One row per group: hash, title and description variants, slugs, category hints.

    ``members`` are listings of enabled sources with source_slug. A list holds the
    first ``limit`` distinct values (all without one). Two passes: one aggregate,
    and one over all values of all kinds.
    """
    rows = _input_rows(members)
    slugs = F.array_sort(F.collect_set("source_slug")).alias("source_slugs")
    hashed = row_set_hash(group, rows, *INPUT_FIELDS, extra=(slugs,))

    def one(kind: str, value: Column, at: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), at.cast("int").alias("at"), value.alias("v"))

    long_text = F.when(F.length("description") >= MIN_DESCRIPTION, F.col("description"))
    values = F.concat(
        F.array(one("titles", F.col("title"), F.lit(0)), one("descriptions", long_text, F.lit(0))),
        F.transform("categories", lambda c, i: one("hints", F.trim(c), i)))
    flat = rows.select(group, "start_at", "id", F.inline(values)).select(
        group, "kind", "v", F.struct("start_at", "id", "at").alias("o"))
    kept = first_values(flat, group, limit)

    def listed(kind: str) -> Column:
        pair = F.when(F.col("kind") == kind, F.struct("at", "v"))
        return F.transform(F.array_sort(F.collect_list(pair)), lambda s: s["v"]).alias(kind)

    lists = kept.groupBy(group).agg(*[listed(k) for k in ("titles", "descriptions", "hints")])
    empty = F.array().cast("array<string>")
    return hashed.join(lists, group, "left").withColumns(
        {c: F.coalesce(c, empty) for c in ("titles", "descriptions", "hints")})


def fallback_editorial(title: Column, description: Column, hints: Column, categories: Column, tags: int | None = 4) -> Column:
    """What a group shows without curated values; ``tags`` is the number of tags kept."""
    source = F.coalesce(nonempty(html_to_text(description)), clean_inline(title))
    return F.struct(
        clean_inline(title).alias("deduped_title"),
        ellipsis(source, 140).alias("summary"),
        F.array(F.lit("cultural")).alias("vibes"),
        F.lit("all_ages").alias("audience"),
        F.lit("both").alias("indoor_outdoor"),
        canonical_tags(F.when(F.size(hints) > 0, hints).otherwise(categories), tags).alias("tags"),
        F.lit(None).cast("string").alias("why_its_cool"),
        F.lit(0.5).alias("editorial_score"))


CURATED = ["deduped_title", "summary", "vibes", "audience", "indoor_outdoor", "tags", "why_its_cool", "editorial_score"]


def valid_curation() -> Column:
    """Caps of a curated row: lengths, ranges and list sizes."""
    return (
        F.length("summary").between(1, 140) & F.length("deduped_title").between(1, 120)
        & F.size("vibes").between(1, 2) & F.size("tags").between(1, 4)
        & F.forall("tags", lambda t: F.length(t).between(1, 16))
        & F.col("audience").isin("all_ages", "kids", "21_plus", "adults")
        & F.col("indoor_outdoor").isin("indoor", "outdoor", "both")
        & F.coalesce(F.length("why_its_cool") <= 200, F.lit(True))
        & F.col("editorial_score").between(0, 1))


def refresh_groups(groups: DataFrame, inputs: DataFrame, primaries: DataFrame, curated: DataFrame, now: datetime) -> DataFrame:
    """Groups after a refresh; ``refreshed`` marks those whose hash changed.

    ``groups``: canonical_id, editorial_hash. ``primaries``: canonical_id, title,
    description, categories of the primary row. Curated values are taken when
    present and valid, else the fallback.
    """
    c = curated.filter(valid_curation()).select(
        "canonical_id", F.struct(
            "deduped_title", "summary", ordered_distinct(F.col("vibes"), 2).alias("vibes"), "audience",
            "indoor_outdoor", canonical_tags(F.col("tags"), 4).alias("tags"), "why_its_cool", "editorial_score").alias("made"))
    stored = groups.select("canonical_id", F.col("editorial_hash").alias("old_hash"))
    joined = (
        inputs.join(stored, "canonical_id", "left").join(primaries, "canonical_id").join(c, "canonical_id", "left"))
    changed = ~F.col("old_hash").eqNullSafe(F.col("editorial_hash"))
    made = F.coalesce("made", fallback_editorial(F.col("title"), F.col("description"), F.col("hints"), F.col("categories")))
    return joined.withColumn("made", made).select(
        "canonical_id", changed.alias("refreshed"), "editorial_hash",
        *[F.when(changed, F.col(f"made.{n}")).alias(n) for n in CURATED],
        F.when(changed, F.lit(now)).alias("editorial_updated_at"))


def _numbered(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def curation_request(inputs: DataFrame, primaries: DataFrame) -> DataFrame:
    """The text document a curator works from, one per group."""
    joined = inputs.join(primaries, "canonical_id")
    described = F.when(F.size("descriptions") > 0, F.col("descriptions")).otherwise(
        F.array(F.lit("(No description text provided by upstream sources.)")))

    def listed(c: str) -> Column:
        return F.when(F.size(c) > 0, F.array_join(c, ", ")).otherwise("(none)")

    text = F.concat_ws(
        "\n",
        F.concat(F.lit("Canonical ID: "), F.col("canonical_id").cast("string")),
        F.concat(F.lit("Source slugs: "), listed("source_slugs")),
        F.concat(F.lit("Venue: "), F.coalesce("venue_name", F.lit("(unknown)"))),
        F.concat(F.lit("City: "), F.col("city")),
        F.concat(F.lit("Start (ISO): "), F.date_format("start_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")),
        F.concat(F.lit("Category hints: "), listed("hints")),
        F.lit(""), F.lit("Title variants:"), _numbered(F.col("titles")),
        F.lit(""), F.lit("Source descriptions:"), _numbered(described))
    return joined.select("canonical_id", text.alias("request"))


def place_request() -> Column:
    """The text document for one place; unknown fields are left out."""
    def line(label: str, c: str, tail: str = "") -> Column:
        return F.concat(F.lit(f"{label}: "), F.col(c).cast("string"), F.lit(tail))

    return F.concat_ws(
        "\n\n", line("Place", "name"), line("Category", "category"), line("City", "city"),
        F.when(F.col("address") != "", line("Address", "address")),
        F.when(F.col("description") != "", line("Description", "description")),
        line("Web Rating", "web_rating", "/5"), line("Review Count", "web_review_count"))


def place_editorial_hash() -> Column:
    return stable_hash(name=F.col("name"), description=F.col("description"), rating=F.col("web_rating"),
                       reviews=F.col("web_review_count"))


def refresh_places(places: DataFrame, curated: DataFrame, now: datetime) -> DataFrame:
    """Places whose hash changed take curated values (score blended) or the fallback.

    ``places`` carries the stored editorial_hash; ``curated`` has id, c_summary,
    c_vibes, c_tags, c_why, c_score.
    """
    joined = places.join(curated, "id", "left").withColumn("new_hash", place_editorial_hash())
    changed = ~F.col("editorial_hash").eqNullSafe(F.col("new_hash"))
    has = F.col("c_summary").isNotNull()
    empty = F.array().cast("array<string>")
    base = F.when(has, F.col("c_score")).otherwise(0.5)
    values = {
        "summary": F.when(has, F.col("c_summary")).otherwise(ellipsis(F.coalesce("description", "name"), 200)),
        "vibes": F.when(has, F.col("c_vibes")).otherwise(empty),
        "tags": F.when(has, F.col("c_tags")).otherwise(F.array("category")),
        "why_its_cool": F.when(has, F.col("c_why")),
        "editorial_score": blend_score(base, F.col("web_rating"), F.col("web_review_count")),
        "editorial_hash": F.col("new_hash"),
        "editorial_updated_at": F.lit(now),
    }
    return joined.withColumn("refreshed", changed).select(
        "id", "refreshed", *[F.when(changed, v).otherwise(F.col(k) if k in places.columns else F.lit(None)).alias(k)
                             for k, v in values.items()])
