"""Extracted records to stored rows, with a reject reason where one cannot be made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from marquee.dims import PLACE_CATEGORIES, TICKET_STATUSES
from marquee.functions.clock import parse_local
from marquee.functions.geo import finite
from marquee.functions.hashes import stable_hash
from marquee.functions.places import price_range
from marquee.functions.prices import currency, price_tiers
from marquee.functions.tags import canonical_tags
from marquee.functions.text import clean_inline, html_to_text, nonempty, refine_city, slugify
from marquee.functions.urls import http_url

EXTRACTED = ["title", "description", "start_local", "end_local", "all_day", "venue_name", "address",
             "city", "price_min", "price_max", "is_free", "categories", "image_url", "offer"]


def structured_hash() -> Column:
    """Content hash of an extracted event, the same for any column order."""
    return stable_hash(**{c: F.col(c) for c in EXTRACTED})


def _money(name: str) -> Column:
    return F.round(F.col(name), 2).cast("decimal(10,2)")


def normalize_events(extracted: DataFrame, keys: list[str]) -> DataFrame:
    """Stored columns plus ``reject_reason`` (null when the row is good).

    ``extracted`` has ``keys``, the extracted columns, event_url and content_hash.
    """
    clean = extracted.withColumns({
        "start_at": parse_local(F.col("start_local")),
        "end_at": parse_local(F.col("end_local")),
        "title": clean_inline(F.col("title")),
        "venue_name": nonempty(clean_inline(F.col("venue_name"))),
        "address": nonempty(clean_inline(F.col("address"))),
        "description": nonempty(html_to_text(F.col("description"))),
    })
    offer = F.col("offer")
    reason = (
        F.when(F.col("start_at").isNull(), F.concat(F.lit("invalid startLocal: "), F.coalesce("start_local", F.lit(""))))
        .when(F.col("title") == "", "empty title after sanitization"))
    status = F.when(offer["status"].isin(*TICKET_STATUSES), offer["status"])
    return clean.select(
        *keys, "title", "description", "start_at", "end_at", "all_day", "venue_name", "address",
        refine_city(F.col("city"), F.coalesce("address", "venue_name", F.lit(""))).alias("city"),
        _money("price_min").alias("price_min"), _money("price_max").alias("price_max"), "is_free",
        http_url(offer["ticket_url"]).alias("ticket_url"), status.alias("ticket_status"),
        currency(offer["currency"]).alias("ticket_currency"),
        parse_local(offer["on_sale_local"]).alias("on_sale_at"),
        parse_local(offer["valid_from_local"]).alias("valid_from_at"),
        price_tiers(offer["tiers"]).alias("price_tiers"),
        canonical_tags(F.col("categories")).alias("categories"),
        http_url(F.col("image_url")).alias("image_url"), "event_url", "content_hash",
        reason.alias("reject_reason"))


def events_only(extractions: DataFrame) -> DataFrame:
    """Extractions marked as an event that carry one."""
    return extractions.filter(F.col("is_event") & F.col("event").isNotNull())


def normalize_places(extracted: DataFrame, keys: list[str]) -> DataFrame:
    """Stored place columns plus ``reject_reason``."""
    clean = extracted.withColumns({
        "name": clean_inline(F.col("name")), "address": nonempty(clean_inline(F.col("address")))})
    where = F.concat_ws(" ", "name", "address")
    known = F.col("category").isin(*PLACE_CATEGORIES)
    return clean.select(
        *keys, "name", slugify(F.col("name")).alias("slug"),
        nonempty(html_to_text(F.col("description"))).alias("description"),
        F.when(known, F.col("category")).otherwise("other").alias("category"),
        refine_city(F.col("city"), where).alias("city"), "address",
        F.when(finite(F.col("lat")), F.col("lat")).alias("lat"), F.when(finite(F.col("lng")), F.col("lng")).alias("lng"),
        http_url(F.col("image_url")).alias("image_url"), http_url(F.col("website_url")).alias("website_url"),
        nonempty(clean_inline(F.col("phone_number"))).alias("phone_number"),
        price_range(F.col("price_range")).alias("price_range"), "hours",
        F.when(F.col("name") == "", "empty name after sanitization").alias("reject_reason"))
