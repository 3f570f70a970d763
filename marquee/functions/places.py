"""Phone numbers, opening hours, price ranges."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from marquee.dims import DAY_ALIASES
from marquee.functions.text import strip


def phone(c: Column) -> Column:
    """``(xxx) xxx-xxxx`` for US numbers; 7 to 15 digits kept as written; else null."""
    digits = F.regexp_replace(c, r"[^0-9]", "")
    us = F.regexp_extract(digits, r"^1?(\d{10})$", 1)
    return (
        F.when(us != "", F.regexp_replace(us, r"^(\d{3})(\d{3})(\d{4})$", "($1) $2-$3"))
        .when(F.length(digits).between(7, 15), strip(c))
    )


def _hour_entry(entry: Column) -> Column:
    text = entry
    for short in dict.fromkeys(DAY_ALIASES.values()):
        names = "|".join(sorted((a for a, s in DAY_ALIASES.items() if s == short), key=len, reverse=True))
        text = F.regexp_replace(text, rf"(?i)\b(?:{names})\b", short)
    # Times: give every hour minutes, then tighten and lower the day-half mark.
    mark = r"([ap])(?:m|\.m\.)"
    text = F.regexp_replace(text, rf"(?i)(?<![\d:])(\d{{1,2}})\s*{mark}", "$1:00$2m")
    text = F.regexp_replace(text, rf"(?i)(\d{{1,2}}:\d{{2}})\s*{mark}", "$1$2m")
    text = F.regexp_replace(text, r"(\d{1,2}:\d{2})(?i:am)", "$1am")
    text = F.regexp_replace(text, r"(\d{1,2}:\d{2})(?i:pm)", "$1pm")
    text = F.regexp_replace(text, "\\s*[-\u2013\u2014]\\s*", "-")
    # A colon between digits is part of a time; any other separates day and time.
    text = F.regexp_replace(text, r"\s*(?<!\d):\s*|\s*:(?!\d)\s*|\s+:\s*|\s*:\s+", " ")
    return strip(F.regexp_replace(text, r"\s{2,}", " "))


def opening_hours(entries: Column) -> Column:
    """Normalized entries; closed days dropped; null when nothing is left.

    Each step is a pass over the list of the step before: inside a function of
    elements Spark computes an expression again for each of its uses.
    """
    given = F.filter(F.transform(entries, strip), lambda e: e != "")
    clean = F.transform(given, _hour_entry)
    kept = F.filter(clean, lambda e: (e != "") & ~F.rlike(e, F.lit(r"(?i)^\s*closed\s*$")))
    return F.get(F.filter(F.array(kept), lambda k: F.size(k) > 0), F.lit(0))


def price_range(c: Column) -> Column:
    value = strip(c)
    return F.when(F.rlike(value, F.lit(r"^\${1,4}$")), value)
