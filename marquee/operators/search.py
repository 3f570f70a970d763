"""Text search over listings and places, with curated picks from a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from marquee.functions.scores import (
    EVENT_POINTS, PLACE_POINTS, search_fields, text_score,
)
from marquee.functions.text import dedupe_title, search_tokens

MIN_QUERY = 2
EVENT_RESULTS, PLACE_RESULTS = 40, 15  # rows of a result page


def normalize_query(text: str) -> str:
    return " ".join(text.split()).lower()


def dedupe_for_search(listing: DataFrame) -> DataFrame:
    """Best row per group, then per normalized title.

    Better is a higher editorial score, then an image; ties keep the row that
    comes first in the listing (groups before ungrouped rows). Both steps are
    partially aggregated minimums.
    """
    pictured = F.coalesce(F.col("image_url") != "", F.lit(False))
    rank = F.struct(
        (-F.coalesce("editorial_score", F.lit(-1.0))).alias("s"), (~pictured).alias("i"),
        F.col("canonical_id").isNull().alias("g"), (-F.col("rank_score")).alias("r"), "start_at", "id")
    row = F.struct(*listing.columns)
    unit = F.coalesce(F.concat(F.lit("g"), "canonical_id"), F.concat(F.lit("e"), "id"))
    first = listing.groupBy(unit.alias("unit")).agg(F.min_by(row, rank).alias("row")).select("row.*")
    key = dedupe_title(F.col("title"))
    return first.groupBy(key.alias("title_key")).agg(F.min_by(row, rank).alias("row")).select("row.*")


def score_events(rows: DataFrame, query: str) -> DataFrame:
    """Rows with a positive ``score``; none for queries without usable tokens."""
    return _score(rows, EVENT_POINTS, query)


def score_places(rows: DataFrame, query: str) -> DataFrame:
    return _score(rows, PLACE_POINTS, query)


def _score(rows: DataFrame, points: dict, query: str) -> DataFrame:
    needle = normalize_query(query)
    tokens = search_tokens(needle)
    if len(needle) < MIN_QUERY or not tokens:
        return rows.withColumn("score", F.lit(0.0)).filter(F.lit(False))
    fields = search_fields(points)
    scored = rows.withColumns(fields).withColumn("score", text_score(points, needle, tokens))
    return scored.drop(*fields).filter(F.col("score") > 0)


def best(scored: DataFrame, limit: int) -> DataFrame:
    return scored.orderBy(F.desc("score"), F.asc("id")).limit(limit)


def event_candidates(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.concat(F.lit("e"), "id").alias("id"), F.lit("event").alias("type"), "title",
        F.coalesce("description", F.lit("")).alias("summary"), "categories", "city",
        F.coalesce("venue_name", F.lit("")).alias("venue_name"), "editorial_score", "vibes",
        "audience", "score")


def place_candidates(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.concat(F.lit("p"), "id").alias("id"), F.lit("place").alias("type"), F.col("name").alias("title"),
        F.coalesce("summary", "description", F.lit("")).alias("summary"), F.array("category").alias("categories"),
        "city", F.lit("").alias("venue_name"), "editorial_score", "vibes",
        F.lit(None).cast("string").alias("audience"), "score")


def search(listing: DataFrame, places: DataFrame, query: str) -> DataFrame:
    """One ranked page of events and places for ``query``; all rows are scored."""
    events = best(score_events(dedupe_for_search(listing), query), EVENT_RESULTS)
    spots = best(score_places(places, query), PLACE_RESULTS)
    return event_candidates(events).unionByName(place_candidates(spots))


def apply_picks(picks: DataFrame, known: DataFrame, limit: int) -> DataFrame:
    """Picks per query: known ids only, first mention counts, the first ``limit`` of them.

    ``picks`` has query_id, pos, id, reason. The limit on ``row_number`` is
    applied before the shuffle as well (a group limit).
    """
    firsts = (
        picks.join(known.select("id"), "id", "left_semi")
        .groupBy("query_id", "id").agg(F.min(F.struct("pos", "reason")).alias("first"))
        .select("query_id", "id", "first.pos", "first.reason")
    )
    order = Window.partitionBy("query_id").orderBy("pos", "id")
    return firsts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).drop("pos")


def without_picks(results: DataFrame, picks: DataFrame) -> DataFrame:
    return results.join(picks.select("id"), "id", "left_anti")
