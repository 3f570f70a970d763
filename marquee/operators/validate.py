"""Input validation: named rules, accepted rows and rejects with reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from marquee.dims import CITY_KEYS, PLACE_CATEGORIES


def text(name: str, low: int = 0, high: int = 1 << 30, required: bool = False) -> tuple[str, Column]:
    ok = F.length(name).between(low, high)
    return name, F.coalesce(ok, F.lit(not required))


def number(name: str, low: float | None = None, high: float | None = None) -> tuple[str, Column]:
    c = F.col(name)
    ok = ~F.isnan(c.cast("double"))
    if low is not None:
        ok = ok & (c >= low)
    if high is not None:
        ok = ok & (c <= high)
    return name, F.coalesce(ok, F.lit(True))


def choice(name: str, values: list[str]) -> tuple[str, Column]:
    return name, F.coalesce(F.col(name).isin(*values), F.lit(False))


def texts(name: str, most: int, each: int, required: bool = True) -> tuple[str, Column]:
    ok = (F.size(name) <= most) & F.forall(name, lambda x: F.length(x) <= each)
    return name, F.coalesce(ok, F.lit(not required))


# Caps of an extracted event, of a place and of an enriched place.
EVENT_RULES = lambda: [
    text("title", 1, 300, True), text("description", 0, 2000), text("start_local", 1, required=True),
    text("venue_name", 0, 200), text("address", 0, 300), choice("city", CITY_KEYS),
    number("price_min"), number("price_max"), texts("categories", 6, 40),
]
PLACE_RULES = lambda: [
    text("name", 1, 200, True), text("description", 0, 2000), choice("category", PLACE_CATEGORIES),
    choice("city", CITY_KEYS), text("address", 0, 300), text("phone_number", 0, 30),
    text("price_range", 0, 4), texts("vibes", 10, 30),
]
ENRICHED_RULES = lambda: [
    text("name", 1, 200, True), text("description", 0, 1000), text("address", 0, 300),
    number("lat", -90, 90), number("lng", -180, 180), text("phone_number", 0, 30),
    text("website_url", 0, 500), text("image_url", 0, 1000), number("web_rating", 0, 5),
    number("web_review_count", 0),
]


def judged(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """Rows with ``errors``: the names of the rules they break."""
    broken = F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules])
    return df.withColumn("errors", F.filter(broken, lambda e: e.isNotNull()))


def split_valid(df: DataFrame, rules: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    rows = judged(df, rules)
    return rows.filter(F.size("errors") == 0).drop("errors"), rows.filter(F.size("errors") > 0)
