"""Category tags: splitting, aliases, limits."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from marquee.dims import TAG_ALIASES, lookup
from marquee.functions.text import WS, strip

EMPTY = "array<string>"


def _pieces(raw: Column) -> Column:
    text = F.lower(strip(F.regexp_replace(raw, rf"{WS}+", " ")))
    head = strip(F.substring_index(text, "/", 1))
    return F.filter(F.transform(F.split(head, r"\s+&\s+"), strip), lambda p: p != "")


def _first(tags: Column, limit: int | None) -> Column:
    return tags if limit is None else F.slice(tags, 1, limit)


def canonical_tags(categories: Column, limit: int | None = None) -> Column:
    """Aliased tags, first occurrence first; all of them unless ``limit`` says otherwise."""
    pieces = F.flatten(F.transform(F.coalesce(categories, F.array().cast(EMPTY)), _pieces))
    aliased = F.transform(pieces, lambda p: lookup(TAG_ALIASES, p, p))
    return _first(F.array_distinct(aliased), limit)


def canonical_tag(raw: Column) -> Column:
    """The first canonical tag of one raw category; null when there is none."""
    return F.get(canonical_tags(F.array(raw), 1), F.lit(0))


def tag_set(categories: Column) -> Column:
    """Distinct canonical tags of a row, one per raw category."""
    tags = F.transform(F.coalesce(categories, F.array().cast(EMPTY)), canonical_tag)
    return F.array_distinct(F.filter(tags, lambda t: t.isNotNull()))


def matches_tags(categories: Column, wanted: list[str]) -> Column:
    """True when no tags are wanted or any canonical tag is among them."""
    if not wanted:
        return F.lit(True)
    return F.arrays_overlap(tag_set(categories), F.array(*[F.lit(w) for w in wanted]))


def plain_tags(raw: Column, limit: int | None = None, max_length: int | None = None) -> Column:
    """Lower-cased trimmed tags without aliases."""
    tags = F.transform(F.coalesce(raw, F.array().cast(EMPTY)), lambda t: F.lower(strip(t)))
    keep = F.filter(
        tags,
        lambda t: (t != "") & (F.length(t) <= max_length if max_length else F.lit(True)),
    )
    return _first(F.array_distinct(keep), limit)
