"""Plans: resolving ids, conflicts in time, and lists kept as JSON.

Conflicts are found with an equi-join on plan, local day and hour. Edits of the
ordered list are in ``plan_rows``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from marquee.functions.clock import effective_interval, local_day


def resolve_items(items: DataFrame, events: DataFrame, places: DataFrame) -> DataFrame:
    """Plan rows with what they name; an event wins over a place, unknown ids drop.

    ``items`` has session_id, pos, item_id; ``events`` and ``places`` have item_id.
    """
    e = events.select("item_id", F.col("title").alias("e_title"), "start_at", "end_at", "all_day",
                      F.lit(True).alias("is_event"))
    p = places.select("item_id", F.col("name").alias("p_title"), F.lit(True).alias("is_place"))
    both = items.join(e, "item_id", "left").join(p, "item_id", "left")
    kind = F.when(F.col("is_event"), "event").when(F.col("is_place"), "place")
    return both.select(
        "session_id", "pos", "item_id", kind.alias("kind"), F.coalesce("e_title", "p_title").alias("title"),
        "start_at", "end_at", "all_day").filter(F.col("kind").isNotNull())


def ordered_events(items: DataFrame, events: DataFrame) -> DataFrame:
    """Events in list order; ids without an event drop."""
    return items.join(events, "item_id")


def conflicts(rows: DataFrame) -> DataFrame:
    """Overlapping timed events of one plan and local start day, as (session_id, day, a, b).

    The earlier event is spread over the hours it covers that day; the later one
    looks only in the hour it starts. Each overlap is met exactly once.
    """
    low, high = effective_interval(F.col("start_at"), F.col("end_at"), F.col("all_day"))
    timed = rows.filter(~F.col("all_day")).select(
        "session_id", local_day(F.col("start_at")).alias("day"), F.col("item_id"),
        F.unix_micros(low).alias("low"), F.unix_micros(high).alias("high"))
    hour = 3_600_000_000
    first = F.floor(F.col("low") / hour)
    # Later starts on the same local day lie within 25 hours.
    last = F.greatest(first, F.least(F.floor(F.col("high") / hour), first + 25))
    early = timed.select(
        "session_id", "day", F.explode(F.sequence(first, last)).alias("hour"),
        F.col("item_id").alias("x"), F.col("low").alias("x_low"), F.col("high").alias("x_high"))
    late = timed.select(
        "session_id", "day", first.alias("hour"),
        F.col("item_id").alias("y"), F.col("low").alias("y_low"), F.col("high").alias("y_high"))
    ordered = (F.col("x_low") < F.col("y_low")) | ((F.col("x_low") == F.col("y_low")) & (F.col("x") < F.col("y")))
    meets = (F.col("x_low") < F.col("y_high")) & (F.col("y_low") < F.col("x_high"))
    return early.join(late, ["session_id", "day", "hour"]).filter(ordered & meets).select(
        "session_id", "day", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def conflict_days(pairs: DataFrame) -> DataFrame:
    """Distinct conflicting events per plan and day."""
    return (
        pairs.select("session_id", "day", F.explode(F.array("a", "b")).alias("item_id")).distinct()
        .groupBy("session_id", "day").agg(F.count("*").alias("events"))
    )


def parse_id_list(text: Column, limit: int | None = None) -> Column:
    """JSON array of UUIDs; anything invalid gives the empty list."""
    uuid = r"^(?i)[0-9a-f]{8}-[0-9a-f]{4}-[1-8][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
    return _json_list(text, limit, lambda x: F.rlike(x, F.lit(uuid)))


def parse_tag_list(text: Column, limit: int | None = None) -> Column:
    """JSON array of tags of 1 to 64 characters."""
    return _json_list(text, limit, lambda x: F.length(x).between(1, 64))


def _json_list(text: Column, limit: int | None, valid) -> Column:
    empty = F.array().cast("array<string>")
    # Only arrays of strings: numbers and objects would be read as text otherwise.
    shape = F.rlike(text, F.lit(r'^\s*\[\s*("([^"\\]|\\.)*"\s*(,\s*"([^"\\]|\\.)*"\s*)*)?\]\s*$'))
    parsed = F.from_json(text, "array<string>")
    ok = shape & (F.size(parsed) <= limit if limit is not None else F.lit(True)) & F.forall(parsed, valid)
    return F.when(F.coalesce(ok, F.lit(False)), parsed).otherwise(empty)


def hours_list(text: Column) -> Column:
    """Opening hours JSON to text entries; anything else gives the empty list."""
    return F.coalesce(
        F.filter(F.from_json(text, "array<string>"), lambda x: x.isNotNull()), F.array().cast("array<string>"))
