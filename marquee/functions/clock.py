"""Windows, local calendar days and local time strings (New York wall clock)."""

from __future__ import annotations

from datetime import datetime, time, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column, functions as F

from marquee.dims import TZ
from marquee.functions.text import let, strip

_ZONE = ZoneInfo(TZ)
_LAST = time(23, 59, 59, 999000)


def window_bounds(kind: str, now: datetime) -> tuple[datetime, datetime]:
    """UTC bounds of a browse window; both ends are inclusive.

    ``tonight`` starts at ``now``; ``weekend`` is today when today is Friday to
    Sunday, else the next Friday, plus two days; ``week`` is eight local days;
    ``ingest`` is fifteen.
    """
    local = now.astimezone(_ZONE)
    today = local.date()
    span = {"tonight": 0, "weekend": 2, "week": 7, "ingest": 14}[kind]
    first = today
    if kind == "weekend" and today.weekday() < 4:
        first = today + timedelta(days=4 - today.weekday())
    start = datetime.combine(first, time(0), _ZONE)
    end = datetime.combine(first + timedelta(days=span), _LAST, _ZONE)
    begin = now if kind == "tonight" else start
    return begin.astimezone(timezone.utc), end.astimezone(timezone.utc)


def local(ts: Column) -> Column:
    """UTC instant to a New York wall-clock timestamp."""
    return F.from_utc_timestamp(ts, TZ)


def to_utc(wall: Column) -> Column:
    return F.to_utc_timestamp(wall, TZ)


def local_day(ts: Column) -> Column:
    """Local calendar day as ``yyyy-MM-dd``."""
    return F.date_format(local(ts), "yyyy-MM-dd")


def window_columns(kind: str, now: Column) -> tuple[Column, Column]:
    """The same windows with a ``now`` per row."""
    day = F.to_date(local(now))
    if kind == "weekend":
        # dayofweek: Sunday 1, Friday 6, Saturday 7
        dow = F.dayofweek(day)
        day = F.when(dow.isin(1, 6, 7), day).otherwise(F.date_add(day, 6 - dow))
    span = {"tonight": 0, "weekend": 2, "week": 7, "ingest": 14}[kind]
    start = now if kind == "tonight" else to_utc(day.cast("timestamp"))
    last = F.date_add(day, span).cast("timestamp") + F.expr("INTERVAL '86399.999' SECOND")
    return start, to_utc(last)


def end_of_week(now: Column) -> Column:
    """End of the local week (weeks start on Sunday)."""
    day = F.to_date(local(now))
    saturday = F.date_add(day, 7 - F.dayofweek(day))
    return to_utc(saturday.cast("timestamp") + F.expr("INTERVAL '86399.999' SECOND"))


def overlaps(start: Column, end: Column, low: Column, high: Column) -> Column:
    return (start <= high) & (F.coalesce(end, start) >= low)


def parse_local(text: Column) -> Column:
    """Local ISO date or date-time to UTC; null when invalid.

    A numeric offset or ``Z`` at the end names the instant itself.
    """
    stamp = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?"

    def parse(full: Column) -> Column:
        instant = full.try_cast("timestamp")
        return F.when(F.rlike(full, F.lit(stamp + "$")), to_utc(instant)).when(
            F.rlike(full, F.lit(stamp + r"([zZ]|[+-]\d{2}:?\d{2})$")), instant)

    # A bare date gets midnight.
    return let(F.regexp_replace(strip(text), r"^(\d{4}-\d{2}-\d{2})$", "$1T00:00:00"), parse)


def format_day(ts: Column) -> Column:
    """``Friday, Jun 5``"""
    return F.date_format(local(ts), "EEEE, MMM d")


def format_time_range(start: Column, end: Column, all_day: Column) -> Column:
    begin, finish = local(start), local(end)
    clock = F.date_format(begin, "h:mm a")
    return (
        F.when(all_day, "All day")
        .when(end.isNull(), clock)
        .when(
            F.to_date(begin) == F.to_date(finish),
            F.concat(clock, F.lit(" \u2013 "), F.date_format(finish, "h:mm a")),
        )
        .otherwise(F.concat(clock, F.lit(" \u2192 "), F.date_format(finish, "MMM d, h:mm a")))
    )


def hours_between(a: Column, b: Column) -> Column:
    """Absolute distance in hours, to the microsecond."""
    return F.abs(F.unix_micros(a) - F.unix_micros(b)) / 3.6e9


def is_long(start: Column, end: Column, all_day: Column) -> Column:
    """All-day, or spanning twenty hours or more."""
    return all_day | F.coalesce(hours_between(start, end) >= 20, F.lit(False))


def effective_interval(start: Column, end: Column, all_day: Column) -> tuple[Column, Column]:
    """Half-open display interval: the local day, or start to end (default one hour)."""
    day = F.to_date(local(start))
    low = F.when(all_day, to_utc(day.cast("timestamp"))).otherwise(start)
    high = F.when(all_day, to_utc(F.date_add(day, 1).cast("timestamp"))).otherwise(
        F.coalesce(end, start + F.expr("INTERVAL 1 HOUR")))
    return low, high


def is_fresh(updated: Column, now: Column, hours: int = 48) -> Column:
    """Updated at most ``hours`` ago; null counts as not fresh."""
    age = F.unix_micros(now) - F.unix_micros(updated)
    return F.coalesce(age <= hours * 3_600_000_000, F.lit(False))


def relative_hours(since: Column, now: Column) -> Column:
    h = F.greatest(F.lit(0), F.floor((F.unix_micros(now) - F.unix_micros(since)) / 3.6e9))
    return F.when(h < 1, "just now").otherwise(F.concat(h.cast("string"), F.lit("h ago")))


_LOCAL_FORMAT = "yyyy-MM-dd'T'HH:mm:ss"


def iso_to_local(text: Column) -> Column:
    """ISO date or date-time to a local string; offsets are converted."""
    def convert(value: Column) -> Column:
        head = F.regexp_extract(value, r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(?::\d{2})?)", 1)
        return (
            F.when(F.rlike(value, F.lit(r"^\d{4}-\d{2}-\d{2}$")), F.concat(value, F.lit("T00:00:00")))
            .when(F.rlike(value, F.lit(r"[zZ]|[+-]\d{2}:?\d{2}$")),
                  F.date_format(local(value.try_cast("timestamp")), _LOCAL_FORMAT))
            .otherwise(let(head, lambda h: F.when(F.length(h) == 16, F.concat(h, F.lit(":00"))).when(h != "", h)))
        )

    return let(strip(text), convert)


def ics_to_local(value: Column, is_date: Column, is_utc: Column) -> Column:
    """Compact calendar value to a local string; UTC values are converted."""
    day = F.regexp_replace(value, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3T00:00:00")
    stamp = F.regexp_replace(
        value, r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})Z?$", "$1-$2-$3T$4:$5:$6")
    instant = F.concat(stamp, F.lit("Z")).try_cast("timestamp")
    return (
        F.when(is_date & F.rlike(value, F.lit(r"^\d{8}$")), day)
        .when(is_date | ~F.rlike(value, F.lit(r"^\d{8}T\d{6}Z?$")), None)
        .when(is_utc, F.date_format(local(instant), _LOCAL_FORMAT))
        .otherwise(stamp)
    )


def pick_local_iso(day: Column, clock: Column) -> Column:
    """Separate local date and time fields of a ticketing feed."""
    suffix = (
        F.when(F.rlike(clock, F.lit(r"^\d{2}:\d{2}:\d{2}$")), clock)
        .when(F.rlike(clock, F.lit(r"^\d{2}:\d{2}$")), F.concat(clock, F.lit(":00")))
        .otherwise(F.lit("00:00:00"))
    )
    return F.when(F.rlike(day, F.lit(r"^\d{4}-\d{2}-\d{2}$")), F.concat(day, F.lit("T"), suffix))


def feed_local_iso(value: Column) -> Column:
    """``yyyy-MM-dd HH:mm[:ss]`` (or with T) of a calendar plug-in feed."""
    spaced = F.replace(value, F.lit(" "), F.lit("T"))
    return (
        F.when(F.contains(value, F.lit("T")),
               F.when(F.length(value) == 16, F.concat(value, F.lit(":00"))).otherwise(value))
        .when(F.rlike(value, F.lit(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$")), spaced)
        .when(F.rlike(value, F.lit(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}$")), F.concat(spaced, F.lit(":00")))
        .when(F.rlike(value, F.lit(r"^\d{4}-\d{2}-\d{2}$")), F.concat(value, F.lit("T00:00:00")))
    )
