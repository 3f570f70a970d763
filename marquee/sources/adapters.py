"""Source registry: how stored raw records of a source become extracted events.

A new source is one entry: a link rule (``links.LINK_RULES``) when its pages are
crawled, and a function here when its records have a shape of their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from marquee.functions.prices import default_offer
from marquee.functions.urls import path_id
from marquee.sources import feeds, links, structured

Adapter = Callable[[DataFrame, list[str]], DataFrame]

# Sources whose pages get an offer pointing at the page when they state none.
WITH_DEFAULT_OFFER = [
    "eventbrite", "straz_center", "funny_bone_tampa", "side_splitters", "dont_tell_comedy", "tampa_theatre",
]


def page_events(pages: DataFrame, keys: list[str]) -> DataFrame:
    """First JSON-LD event of each page (columns html and url)."""
    found = structured.extracted_events(structured.jsonld_events(pages, keys), keys)
    return structured.first_structured(found, keys)


def offered_page_events(pages: DataFrame, keys: list[str]) -> DataFrame:
    """As ``page_events``, with an offer on every event."""
    events = page_events(pages, keys).join(pages.select(*keys, F.col("url").alias("page_url")), keys)
    offer = default_offer(F.col("offer"), F.col("page_url"), F.col("is_free"))
    return events.withColumn("offer", offer).withColumn(
        "event_url", F.coalesce("event_url", "page_url")).drop("page_url")


def calendar_first(calendars: DataFrame, feed_keys: list[str]) -> Adapter:
    """An adapter for pages of a source that publishes calendars too (columns ``feed_keys`` and text).

    A page whose path is that of a calendar event's address takes that event; of
    several the last counts. Other pages are read as usual.
    """
    order = [*feed_keys, "pos"]
    feed = feeds.ical_extracted(feeds.ical_events(calendars, feed_keys), order)
    fields = [c for c in feed.columns if c not in order]
    last = feed.groupBy(path_id(F.col("event_url")).alias("_path")).agg(
        F.max_by(F.struct(*fields), F.struct(*order)).alias("_feed"))

    def run(pages: DataFrame, keys: list[str]) -> DataFrame:
        found = page_events(pages, keys)
        known = pages.select(*keys, path_id(F.col("url")).alias("_path")).join(last, "_path").select(*keys, "_feed")
        listed = F.col("_feed").isNotNull()
        # One join: each calendar and each page is read once.
        return found.join(known, keys, "full").select(*[
            c if c in keys else F.when(listed, F.col(f"_feed.{c}")).otherwise(F.col(c)).alias(c) if c in fields
            else F.when(~listed, F.col(c)).alias(c)
            for c in found.columns])

    return run


def _linked(slug: str) -> Adapter:
    return lambda pages, keys: links.listing_links(pages.withColumn("source_slug", F.lit(slug)), key=tuple(keys))


# How the items of a source are found: links on its pages, or its feed.
LISTINGS: dict[str, Adapter] = {**{slug: _linked(slug) for slug in links.LINK_RULES}, "safety_harbor": feeds.rss_items}

ADAPTERS: dict[str, Adapter] = {
    **{slug: offered_page_events for slug in WITH_DEFAULT_OFFER},
    **{slug: page_events for slug in ("tampa_gov", "visit_st_pete_clearwater", "visit_tampa_bay", "unation",
                                      "dunedin_gov", "feverup", "tampa_bay_times", "tampa_bay_markets")},
    "ilovetheburg": feeds.plugin_extracted,
    "thats_so_tampa": feeds.plugin_extracted,
    "ticketmaster": feeds.ticketing_extracted,
}


def register(slug: str, adapter: Adapter) -> None:
    ADAPTERS[slug] = adapter
