"""Ranking scores: editorial confidence, place blend, text search."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from marquee.functions.clock import is_fresh
from marquee.functions.text import search_text


def effective_score(score: Column, updated: Column, why: Column, now: Column) -> Column:
    """Editorial score less penalties for age and for weak, unexplained scores."""
    stale = F.when(is_fresh(updated, now), 0.0).otherwise(0.2)
    weak = F.when((score <= 0.55) & (F.coalesce(why, F.lit("")) == ""), 0.1).otherwise(0.0)
    return F.when(score.isNull(), -1.0).otherwise(score - stale - weak)


def blend_score(score: Column, rating: Column, reviews: Column) -> Column:
    """Model score mixed with the web rating and the review volume."""
    volume = F.coalesce(F.least(F.lit(1.0), F.log2(reviews + 1) / F.log2(F.lit(200.0))), F.lit(0.0))
    blended = F.least(F.lit(1.0), score * 0.5 + rating / 5 * 0.35 + volume * 0.15)
    return F.when(F.coalesce(rating, F.lit(0)) == 0, score * 0.85).otherwise(blended)


# Points for the whole query and for each token, per field.
EVENT_POINTS = {
    "title": (70, 28), "venue_name": (40, 18), "city": (25, 0), "categories": (30, 14),
    "description": (20, 8), "why_its_cool": (15, 6), "vibes": (12, 5),
}
PLACE_POINTS = {
    "name": (70, 28), "category": (35, 16), "city": (25, 0), "summary": (25, 10),
    "description": (20, 8), "address": (15, 0), "why_its_cool": (15, 6), "vibes": (12, 5),
    "tags": (12, 5),
}
PREFIX_POINTS = 100
ARRAY_FIELDS = {"categories", "vibes", "tags"}


def text_score(points: dict, query: str, tokens: list[str]) -> Column:
    """Sum of field points; the editorial bonus counts only with a text hit.

    Each normalized field is a column of its own (see ``search_fields``), so a
    field is cleaned once and not once per token.
    """

    def hit(field: str, needle: str) -> Column:
        c = F.col(f"_{field}")
        if field in ARRAY_FIELDS:
            return F.exists(c, lambda x: F.contains(x, F.lit(needle)))
        return F.contains(c, F.lit(needle))

    head = next(iter(points))
    terms = [F.when(F.startswith(F.col(f"_{head}"), F.lit(query)), PREFIX_POINTS).otherwise(0)]
    for field, (whole, per_token) in points.items():
        terms.append(F.when(hit(field, query), whole).otherwise(0))
        if per_token:
            terms += [F.when(hit(field, t), per_token).otherwise(0) for t in tokens]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    bonus = F.coalesce(F.col("editorial_score"), F.lit(0.0)) * 10
    return F.when(total > 0, total + bonus).otherwise(F.lit(0.0))


def search_fields(points: dict) -> dict[str, Column]:
    return {
        f"_{field}": F.transform(F.coalesce(F.col(field), F.array().cast("array<string>")), search_text)
        if field in ARRAY_FIELDS else search_text(F.col(field))
        for field in points
    }
