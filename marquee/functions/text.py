"""Text clean-up, matching keys and labels as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from marquee.dims import CITY_HINTS, NAMED_ENTITIES, PLACE_CATEGORIES, SEARCH_TYPE_CATEGORY, lookup

# White space as browsers define it; Java's \s knows only the ASCII part.
# The rare ones stand behind one range, which an ASCII character fails at once.
WS = r"[\t-\r \u00a0[\u1680-\ufeff&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]]]"
BLANKS = "\t\n\u000b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200b))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
ZERO_WIDTH = r"[\u200b-\ufeff&&[\u200b-\u200f\u202a-\u202e\u2060\ufeff]]"
CONTROL = r"[\u0000-\u001f\u007f-\u009f]"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Trim all white space, not only blanks."""
    return F.trim(c, F.lit(BLANKS))


def nonempty(c: Column) -> Column:
    """Null for the empty string."""
    return let(c, lambda t: F.when(t != "", t))


def _code_point(text: Column, base: int) -> Column:
    number = F.conv(text, base, 10).cast("decimal(20,0)")
    valid = number.between(1, 0x10FFFF)
    utf32 = F.unhex(F.lpad(F.hex(number.cast("bigint")), 8, "0"))
    return F.when(valid, F.decode(utf32, "UTF-32"))


def _decode_refs(text: Column, name_pattern: str, value_of) -> Column:
    """Replace ``&name;`` references in one pass over the pieces between ``&``."""

    def piece(p: Column) -> Column:
        return let(F.regexp_extract(p, f"^({name_pattern});", 1), lambda name: F.coalesce(
            F.concat(F.when(name != "", value_of(name)), F.substr(p, F.length(name) + 2)),
            F.concat(F.lit("&"), p)))

    def decoded(pieces: Column) -> Column:
        rest = F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), piece)
        return F.concat(F.get(pieces, F.lit(0)), F.array_join(rest, ""))

    return let(text, lambda t: F.when(F.contains(t, F.lit("&")), let(F.split(t, "&"), decoded)).otherwise(t))


def decode_entities(c: Column) -> Column:
    """Numeric references first, then the known named ones; unknown names stay."""

    def numeric(name: Column) -> Column:
        digits = F.substr(name, F.lit(2))
        return F.when(
            F.lower(F.substring(digits, 1, 1)) == "x", _code_point(F.substr(digits, F.lit(2)), 16)
        ).otherwise(_code_point(digits, 10))

    decoded = _decode_refs(c, r"#(?:[xX][0-9a-fA-F]{1,12}|[0-9]{1,15})", numeric)
    return _decode_refs(
        decoded, r"[a-zA-Z][a-zA-Z0-9]+", lambda name: lookup(NAMED_ENTITIES, F.lower(name))
    )


def clean_inline(c: Column) -> Column:
    """One-line field: decode, drop zero-width and control characters, collapse blanks."""
    text = F.regexp_replace(decode_entities(F.coalesce(c, F.lit(""))), ZERO_WIDTH, "")
    text = F.regexp_replace(text, CONTROL, "")
    return strip(F.regexp_replace(text, rf"{WS}+", " "))


def html_to_text(c: Column) -> Column:
    """Markup to plain text, keeping paragraph breaks."""
    text = F.coalesce(c, F.lit(""))
    text = F.regexp_replace(text, r"(?i)<\s*br\s*/?\s*>", "\n")
    text = F.regexp_replace(text, r"(?i)</\s*(?:p|div|li|h[1-6]|blockquote|tr)\s*>", "\n\n")
    text = F.regexp_replace(text, r"</?[a-zA-Z][^>]*>", "")
    text = F.regexp_replace(decode_entities(text), ZERO_WIDTH, "")
    text = F.regexp_replace(text, r"[\u0000-\u0008\u000b-\u001f\u007f-\u009f]", "")
    text = F.regexp_replace(text, r"[ \t\u00a0]+", " ")
    text = F.regexp_replace(text, r"[ \t]*\n[ \t]*", "\n")
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def match_text(c: Column) -> Column:
    """Comparison form of a title or venue."""
    text = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "&", " and ")
    text = F.regexp_replace(text, rf"(?:[^a-z0-9\s]|{WS})+", " ")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def match_tokens(normalized: Column) -> Column:
    """Distinct tokens of two or more characters."""
    return F.array_distinct(F.filter(F.split(normalized, " "), lambda t: F.length(t) >= 2))


def title_similarity(a: Column, b: Column, a_tokens: Column, b_tokens: Column) -> Column:
    """Token Jaccard, raised to 0.9 when one normalized title contains the other."""
    shared = F.size(F.array_intersect(a_tokens, b_tokens))
    union = F.size(a_tokens) + F.size(b_tokens) - shared
    jaccard = shared / union
    inside = F.contains(a, b) | F.contains(b, a)
    return (
        F.when((F.size(a_tokens) == 0) | (F.size(b_tokens) == 0), 0.0)
        .when(inside, F.greatest(jaccard, F.lit(0.9)))
        .otherwise(jaccard)
    )


def location_match(a: Column, b: Column) -> Column:
    """Equal or nested normalized locations; empty never matches."""
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))


def search_text(c: Column) -> Column:
    return F.lower(strip(F.regexp_replace(F.coalesce(c, F.lit("")), rf"{WS}+", " ")))


def search_tokens(query: str) -> list[str]:
    return [t for t in query.split(" ") if len(t) > 1]


def dedupe_title(c: Column, region_pattern: str = r"tampa\s*bay") -> Column:
    """Title key for search: four-digit words and the region phrase removed."""
    text = F.regexp_replace(F.lower(c), r"\b\d{4}\b", "")
    text = F.regexp_replace(text, region_pattern, "")
    return F.trim(F.regexp_replace(text, r"[^a-z0-9]+", " "))


def name_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^a-z0-9]", "")


def slugify(c: Column) -> Column:
    """Whole slugs: a cut one could be the key of two places."""
    slug = F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-")
    return F.regexp_replace(slug, r"^-+|-+$", "")


def place_slug(name: Column, city: Column) -> Column:
    slug = slugify(F.concat_ws("-", name, city))
    return F.coalesce(nonempty(slug), F.lit("place"))


def detect_city(location: Column) -> Column:
    """First city whose hint occurs in the text, else ``other``."""
    def first_hint(text: Column) -> Column:
        chain = None
        for key, pattern in CITY_HINTS:
            hit = F.rlike(text, F.lit(f"(?i){pattern}"))
            chain = F.when(hit, key) if chain is None else chain.when(hit, key)
        return F.coalesce(chain, F.lit("other"))

    return let(location, first_hint)


def refine_city(city: Column, location: Column) -> Column:
    return F.when(city != "other", city).otherwise(detect_city(location))


def place_category(raw: Column, search_type: Column) -> Column:
    """First category named in the text (in fixed order), else by search type."""
    lower = F.lower(raw)
    chain = None
    for category in PLACE_CATEGORIES:
        hit = F.contains(lower, F.lit(category))
        chain = F.when(hit, category) if chain is None else chain.when(hit, category)
    return F.coalesce(chain, lookup(SEARCH_TYPE_CATEGORY, search_type), F.lit("other"))


def join_parts(parts: list[Column], sep: str = ", ") -> Column:
    """Trimmed non-empty parts joined; used by every address shape."""
    trimmed = F.transform(F.array(*parts), strip)
    return F.array_join(F.filter(trimmed, lambda p: p.isNotNull() & (p != "")), sep)


def ellipsis(c: Column, limit: int) -> Column:
    return let(c, lambda t: F.when(
        F.length(t) > limit, F.concat(F.substring(t, 1, limit - 3), F.lit("..."))).otherwise(t))


def ordered_distinct(items: Column, limit: int | None = None) -> Column:
    """Trimmed, non-empty, first occurrence wins."""
    kept = F.array_distinct(F.filter(F.transform(items, strip), lambda x: x != ""))
    return kept if limit is None else F.slice(kept, 1, limit)


def map_search_url(address: Column) -> Column:
    encoded = F.replace(F.url_encode(address), F.lit("+"), F.lit("%20"))
    return F.concat(F.lit("https://www.google.com/maps/search/?api=1&query="), encoded)


def ticket_call(status: Column) -> Column:
    labels = {"rsvp": "RSVP", "free": "Get free tickets", "not_yet": "Notify me"}
    return lookup(labels, status, F.lit("Buy tickets"))
