"""Column types of the stored tables and of extracted records, as DDL strings.

Pass one to ``spark.read.schema``; no file is opened to infer types.
"""

from __future__ import annotations

_TIER = "STRUCT<name: STRING, min: DOUBLE, max: DOUBLE, currency: STRING>"
_OFFER = (
    "STRUCT<ticket_url: STRING, status: STRING, currency: STRING, on_sale_local: STRING, "
    f"valid_from_local: STRING, tiers: ARRAY<{_TIER}>>"
)

SOURCES = (
    "source_id STRING, source_slug STRING, source_label STRING, base_url STRING, enabled BOOLEAN, "
    "last_run_at TIMESTAMP, last_status STRING")

RUNS = (
    "run_id STRING, source_id STRING, started_at TIMESTAMP, finished_at TIMESTAMP, seen INT, "
    "inserted INT, updated INT, skipped INT, error STRING")

EVENTS = (
    "id STRING, source_id STRING, source_event_id STRING, canonical_id STRING, title STRING, "
    "description STRING, start_at TIMESTAMP, end_at TIMESTAMP, all_day BOOLEAN, venue_name STRING, "
    "address STRING, city STRING, lat DOUBLE, lng DOUBLE, price_min DECIMAL(10,2), "
    "price_max DECIMAL(10,2), is_free BOOLEAN, ticket_url STRING, ticket_status STRING, "
    f"ticket_currency STRING, on_sale_at TIMESTAMP, valid_from_at TIMESTAMP, price_tiers ARRAY<{_TIER}>, "
    "categories ARRAY<STRING>, image_url STRING, event_url STRING, content_hash STRING, "
    "last_seen_at TIMESTAMP, created_at TIMESTAMP, updated_at TIMESTAMP")

CANONICALS = (
    "canonical_id STRING, primary_event_id STRING, deduped_title STRING, summary STRING, "
    "vibes ARRAY<STRING>, audience STRING, indoor_outdoor STRING, tags ARRAY<STRING>, "
    "why_its_cool STRING, editorial_score DOUBLE, editorial_hash STRING, editorial_updated_at TIMESTAMP")

PLACES = (
    "id STRING, source_id STRING, source_place_id STRING, slug STRING, map_id STRING, name STRING, "
    "description STRING, category STRING, city STRING, address STRING, lat DOUBLE, lng DOUBLE, "
    "image_url STRING, website_url STRING, phone_number STRING, price_range STRING, "
    "hours ARRAY<STRING>, source_url STRING, content_hash STRING, search_type STRING, "
    "verified BOOLEAN, web_rating DOUBLE, web_review_count INT, summary STRING, "
    "vibes ARRAY<STRING>, tags ARRAY<STRING>, why_its_cool STRING, editorial_score DOUBLE, "
    "editorial_hash STRING, editorial_updated_at TIMESTAMP, last_seen_at TIMESTAMP")

METRICS = (
    "metric_id STRING, session_id STRING, action STRING, event_id STRING, place_id STRING, "
    "payload VARIANT, created_at TIMESTAMP")

USAGE = (
    "usage_id STRING, feature STRING, model STRING, prompt_tokens BIGINT, completion_tokens BIGINT, "
    "total_tokens BIGINT, estimated_cost_usd DOUBLE, latency_ms BIGINT, success BOOLEAN, error STRING, "
    "run_id STRING, meta VARIANT, created_at TIMESTAMP")

EXTRACTED_EVENT_TYPES = {
    "title": "STRING", "description": "STRING", "start_local": "STRING", "end_local": "STRING",
    "all_day": "BOOLEAN", "venue_name": "STRING", "address": "STRING", "city": "STRING",
    "price_min": "DOUBLE", "price_max": "DOUBLE", "is_free": "BOOLEAN",
    "categories": "ARRAY<STRING>", "image_url": "STRING", "offer": _OFFER,
}
EXTRACTED_EVENT = ", ".join(f"{name} {kind}" for name, kind in EXTRACTED_EVENT_TYPES.items())

EXTRACTED_PLACE = (
    "name STRING, description STRING, category STRING, city STRING, address STRING, lat DOUBLE, "
    "lng DOUBLE, image_url STRING, website_url STRING, phone_number STRING, price_range STRING, "
    "hours ARRAY<STRING>, vibes ARRAY<STRING>")
