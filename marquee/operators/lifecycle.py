"""Expiry, cascades and reference clean-up."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F

KEEP_DAYS = 14
STALE_DAYS = 90


def expired(now: datetime, days: int = KEEP_DAYS) -> Column:
    return F.coalesce("end_at", "start_at") < F.lit(now - timedelta(days=days))


def stale(now: datetime, days: int = STALE_DAYS) -> Column:
    return F.col("last_seen_at") < F.lit(now - timedelta(days=days))


def cascade(children: DataFrame, parent_ids: DataFrame, key: str) -> DataFrame:
    """Children left after their parents were deleted (null keys stay)."""
    return children.join(parent_ids.select(key), key, "left_anti")


def set_null(children: DataFrame, parent_ids: DataFrame, key: str) -> DataFrame:
    """Children with the reference cleared where the parent was deleted."""
    gone = parent_ids.select(key).distinct().withColumn("_gone", F.lit(True))
    joined = children.join(gone, key, "left")
    cleared = F.when(F.col("_gone").isNull(), F.col(key))
    return joined.select(*[cleared.alias(c) if c == key else F.col(c) for c in children.columns])


def clean_expired(events: DataFrame, metrics: DataFrame, groups: DataFrame, now: datetime) -> dict[str, DataFrame]:
    """Tables left after expiry: events, their metrics, and groups.

    Groups without events go only when some event expired.
    """
    gone = events.filter(expired(now)).select("id")
    kept = events.filter(~expired(now))
    any_gone = gone.agg((F.count("*") > 0).alias("any")).scalar()
    live = kept.select("canonical_id").filter("canonical_id is not null").distinct().withColumn("_live", F.lit(True))
    left = groups.join(live, "canonical_id", "left").filter(~any_gone | F.coalesce("_live", F.lit(False))).drop("_live")
    return {
        "events": kept,
        "metrics": cascade(metrics, gone.withColumnRenamed("id", "event_id"), "event_id"),
        "groups": left,
    }


def clean_stale_places(places: DataFrame, metrics: DataFrame, now: datetime) -> dict[str, DataFrame]:
    gone = places.filter(stale(now)).select(F.col("id").alias("place_id"))
    return {"places": places.filter(~stale(now)), "metrics": cascade(metrics, gone, "place_id")}


def deleted_counts(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """(table, deleted): one counting pass per table, joined as one small result."""
    out = None
    for name in before:
        was = before[name].agg(F.count("*").alias("n")).scalar()
        row = after[name].agg((was - F.count("*")).alias("deleted")).select(F.lit(name).alias("table"), "deleted")
        out = row if out is None else out.unionByName(row)
    return out


def delete_source(source_id, sources: DataFrame, children: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Delete one source; its events, runs and places go with it."""
    ids = sources.filter(F.col("source_id") == source_id).select("source_id")
    return {"sources": sources.filter(F.col("source_id") != source_id),
            **{name: cascade(df, ids, "source_id") for name, df in children.items()}}
