"""Constant dimensions. All are fixed values the results depend on."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

TZ = "America/New_York"

# City keys, labels and centroids (the last key has no centroid).
CITIES = [
    ("tampa", "Tampa", 27.9506, -82.4572),
    ("st_petersburg", "St. Petersburg", 27.7676, -82.6403),
    ("clearwater", "Clearwater", 27.9659, -82.8001),
    ("brandon", "Brandon", 27.9378, -82.2859),
    ("bradenton", "Bradenton", 27.4989, -82.5748),
    ("safety_harbor", "Safety Harbor", 28.0108, -82.6929),
    ("dunedin", "Dunedin", 28.0197, -82.7720),
]
CITY_KEYS = [c[0] for c in CITIES] + ["other"]
CITY_LABELS = {**{c[0]: c[1] for c in CITIES}, "other": "Other"}

# City hints, tried in this order on a location text.
CITY_HINTS = [
    ("tampa", r"\btampa\b|\bybor\b"),
    ("st_petersburg", r"st\.?\s*pete(rsburg)?|\bgulfport\b"),
    ("clearwater", r"clearwater"),
    ("brandon", r"\bbrandon\b|valrico|riverview"),
    ("bradenton", r"bradenton|palmetto|anna maria"),
    ("safety_harbor", r"safety\s*harbor"),
    ("dunedin", r"\bdunedin\b|palm\s*harbor"),
]

# Source slugs by display priority; all others rank last.
SOURCE_PRIORITY = [
    "eventbrite",
    "visit_tampa_bay",
    "visit_st_pete_clearwater",
    "tampa_gov",
    "ilovetheburg",
    "thats_so_tampa",
    "straz_center",
    "tampa_theatre",
    "side_splitters",
    "funny_bone_tampa",
    "dont_tell_comedy",
    "tampa_bay_times",
    "tampa_bay_markets",
    "safety_harbor",
    "ticketmaster",
]
UNRANKED = len(SOURCE_PRIORITY) + 100

# Tag aliases.
TAG_ALIASES = {
    "arts": "art",
    "art": "art",
    "theatre": "theater",
    "theater": "theater",
    "films": "film",
    "movies": "film",
    "movie": "film",
    "kids": "family",
    "child": "family",
    "children": "family",
    "outdoor": "outdoors",
    "outdoors": "outdoors",
    "drink": "drinks",
    "foods": "food",
    "markets": "market",
    "shopping": "market",
    "festivals": "festival",
    "musics": "music",
    "concert": "music",
    "concerts": "music",
    "live show": "music",
    "live music": "music",
    "r&b": "music",
}

# HTML named entities that are decoded.
NAMED_ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'",
    "nbsp": "\u00a0", "copy": "\u00a9", "reg": "\u00ae", "trade": "\u2122",
    "hellip": "\u2026", "mdash": "\u2014", "ndash": "\u2013",
    "lsquo": "\u2018", "rsquo": "\u2019", "ldquo": "\u201c", "rdquo": "\u201d",
    "sbquo": "\u201a", "bdquo": "\u201e", "laquo": "\u00ab", "raquo": "\u00bb",
    "lsaquo": "\u2039", "rsaquo": "\u203a", "middot": "\u00b7", "bull": "\u2022",
    "deg": "\u00b0", "plusmn": "\u00b1", "times": "\u00d7", "divide": "\u00f7",
    "sect": "\u00a7", "para": "\u00b6", "iexcl": "\u00a1", "iquest": "\u00bf",
    "cent": "\u00a2", "pound": "\u00a3", "euro": "\u20ac", "yen": "\u00a5",
}

TICKET_STATUSES = ["on_sale", "sold_out", "not_yet", "cancelled", "free", "rsvp", "unknown"]

# Schema.org availability to ticket status.
AVAILABILITY_STATUS = {
    "https://schema.org/InStock": "on_sale",
    "https://schema.org/SoldOut": "sold_out",
    "https://schema.org/PreOrder": "not_yet",
    "https://schema.org/LimitedAvailability": "on_sale",
    "https://schema.org/OnlineOnly": "on_sale",
    "https://schema.org/Discontinued": "cancelled",
    "InStock": "on_sale",
    "SoldOut": "sold_out",
    "PreOrder": "not_yet",
    "LimitedAvailability": "on_sale",
    "Discontinued": "cancelled",
}

# Ticketing feed status code to ticket status.
TICKETING_STATUS = {
    "onsale": "on_sale",
    "offsale": "not_yet",
    "cancelled": "cancelled",
    "postponed": "not_yet",
    "rescheduled": "on_sale",
}

# Place categories in display order, with labels.
PLACE_CATEGORIES = [
    "restaurant", "brewery", "bar", "cafe", "bakery", "museum", "gallery",
    "park", "beach", "shop", "venue", "attraction", "other",
]
CATEGORY_LABELS = {
    "restaurant": "Restaurant", "brewery": "Brewery", "bar": "Bar", "cafe": "Caf\u00e9",
    "bakery": "Bakery", "museum": "Museum", "gallery": "Gallery", "park": "Park",
    "beach": "Beach", "shop": "Shop", "venue": "Venue", "attraction": "Attraction",
    "other": "Place",
}
CATEGORY_LABELS_PLURAL = {
    "restaurant": "Restaurants", "brewery": "Breweries", "bar": "Bars", "cafe": "Caf\u00e9s",
    "bakery": "Bakeries", "museum": "Museums", "gallery": "Galleries", "park": "Parks",
    "beach": "Beaches", "shop": "Shops", "venue": "Venues", "attraction": "Attractions",
    "other": "Other",
}
VIBE_LABELS = {
    "dog_friendly": "Dog Friendly", "outdoor_seating": "Outdoor Seating",
    "kid_friendly": "Kid Friendly", "family": "Family", "late_night": "Late Night",
    "romantic": "Romantic", "hidden_gem": "Hidden Gem", "waterfront": "Waterfront",
    "live_music": "Live Music", "craft_beer": "Craft Beer", "brunch": "Brunch",
    "vegan_friendly": "Vegan Friendly", "pet_friendly": "Pet Friendly",
    "scenic_views": "Scenic Views",
}
SEARCH_TYPES = ["beaches", "bars", "restaurants", "breweries", "hidden_gems", "live_music"]
# Search type to place category, used when the raw text names none.
SEARCH_TYPE_CATEGORY = {
    "beaches": "beach",
    "bars": "bar",
    "restaurants": "restaurant",
    "breweries": "brewery",
    "hidden_gems": "attraction",
    "live_music": "venue",
}

# Day-name aliases for opening hours.
DAY_ALIASES = {
    "monday": "Mon", "mon": "Mon", "mo": "Mon",
    "tuesday": "Tue", "tue": "Tue", "tu": "Tue", "tues": "Tue",
    "wednesday": "Wed", "wed": "Wed", "we": "Wed",
    "thursday": "Thu", "thu": "Thu", "th": "Thu", "thur": "Thu", "thurs": "Thu",
    "friday": "Fri", "fri": "Fri", "fr": "Fri",
    "saturday": "Sat", "sat": "Sat", "sa": "Sat",
    "sunday": "Sun", "sun": "Sun", "su": "Sun",
}

# USD per million input and output tokens.
COST_RATES = {
    "gpt-4.1-mini": (0.40, 1.60),
    "gpt-4.1-nano": (0.10, 0.40),
    "gpt-4.1": (2.00, 8.00),
    "gpt-4o-mini": (0.15, 0.60),
    "gpt-4o": (2.50, 10.00),
    "gpt-5.4-mini": (0.40, 1.60),
}

METRIC_ACTIONS = [
    "add_to_plan", "remove_from_plan", "save_event", "unsave_event", "view_event", "view_place",
    "filter_tags", "search", "share_event", "share_plan", "open_ticket_link",
]
AI_FEATURES = [
    "extract_event", "extract_place", "extract_listings", "editorial_event", "editorial_place",
    "search_rerank",
]

# Signatures of challenge pages and of captchas.
CHALLENGE_PATTERNS = [
    r"incapsula", r"_incapsula_resource", r"captcha-delivery\.com", r"datadome",
    r"cf-browser-verification", r"cf_chl_opt", r"challenges\.cloudflare\.com",
    r"akamai.*bot.*manager", r"g-recaptcha", r"h-captcha",
]
CAPTCHA_PATTERNS = [r"g-recaptcha-response", r"h-captcha-response", r"captcha"]


def _literal(value: object) -> str:
    if isinstance(value, str):
        escaped = value.replace("\\", "\\\\").replace("'", "\\'")
        return f"'{escaped}'"
    return f"{value}D" if isinstance(value, float) else str(value)


def lookup(values: dict[str, object], key: Column, default: Column | None = None) -> Column:
    """Small constant map probed per row; no join, no shuffle."""
    entries = ", ".join(f"{_literal(k)}, {_literal(v)}" for k, v in values.items())
    found = F.try_element_at(F.expr(f"map({entries})"), key)
    return found if default is None else F.coalesce(found, default)


def source_rank(slug: Column) -> Column:
    """Display priority of a source slug; lower wins."""
    return lookup({s: i for i, s in enumerate(SOURCE_PRIORITY)}, slug, F.lit(UNRANKED))
