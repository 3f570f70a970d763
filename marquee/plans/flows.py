"""Composed flows: stored pages to de-duplicated, ranked listings."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from marquee.functions.clock import window_bounds
from marquee.operators import listing, normalize, resolve, upsert

KEYS = ["source_id", "source_event_id"]


def ingest(stored: DataFrame, extracted: DataFrame, now: datetime, arrival: str | None = None) -> DataFrame:
    """Extracted events of one batch against the stored table: an upsert plan.

    ``extracted`` has the key columns, the extracted columns and event_url. Of
    several rows with one key the last by ``arrival`` counts.
    """
    extracted = upsert.last_per_key(extracted, KEYS, arrival)
    batch = extracted if "content_hash" in extracted.columns else extracted.withColumn(
        "content_hash", normalize.structured_hash())
    rows = normalize.normalize_events(batch, KEYS)
    gate = upsert.window_gate(*window_bounds("ingest", now))
    return upsert.plan_upsert(
        stored, rows, KEYS, now, gate, identity=("id", "canonical_id", "created_at"), reject="reject_reason")


def regroup(stored: DataFrame, sources: DataFrame) -> DataFrame:
    """Stored rows with the group they now belong to; disabled sources keep none."""
    enabled = sources.filter("enabled").select("source_id")
    live = stored.join(enabled, "source_id", "left_semi")
    groups = resolve.duplicate_groups(live, prior="canonical_id")
    named = groups.select("id", F.coalesce("kept_id", "group_id").alias("canonical_id"))
    return stored.drop("canonical_id").join(named, "id", "left")


def browse(stored: DataFrame, sources: DataFrame, canonicals: DataFrame, kind: str, now: datetime,
           limit: int = 100, **filters) -> DataFrame:
    """The ranked listing of a browse window."""
    rows = listing.visible(stored, sources, *window_bounds(kind, now), **filters)
    return listing.top(listing.listing(rows, canonicals, now), limit)
