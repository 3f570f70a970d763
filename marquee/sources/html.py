"""Tags and attributes of stored pages, found with regular expressions in the JVM.

Comments, scripts and styles are blanked first, so markup inside them is not
seen. Quoted attribute values may hold ``>``.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from marquee.functions.text import decode_entities, let, strip

_ATTRS = r"""(?:[^>"']++|"[^"]*"|'[^']*')*+"""


def visible_markup(html: Column) -> Column:
    text = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    return F.regexp_replace(text, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", "")


def tags(html: Column, name: str) -> Column:
    """Start tags of one kind, in page order."""
    return F.regexp_extract_all(html, F.lit(rf"(?i)<{name}(?=[\s/>]){_ATTRS}>"), 0)


def attribute(tag: Column, name: str) -> Column:
    """Decoded attribute value of a start tag; null when absent."""
    pattern = rf"""(?i)[\s"'/]{name}\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""
    return let(F.regexp_extract(tag, pattern, 1), lambda raw: F.when(
        raw != "", decode_entities(F.regexp_replace(raw, r"""^["']|["']$""", ""))))


def hrefs(html: Column) -> Column:
    """Link targets of anchors, in page order."""
    found = F.transform(tags(visible_markup(html), "a"), lambda t: attribute(t, "href"))
    return F.filter(found, lambda h: h.isNotNull() & (h != ""))


def first_meta(metas: Column, key: str, value: str, content: str = "content") -> Column:
    """Content of the first tag whose ``key`` attribute equals ``value``."""
    hits = F.filter(metas, lambda m: F.coalesce(attribute(m, key) == value, F.lit(False)))
    return attribute(F.get(hits, F.lit(0)), content)


def image_candidates(html: Column) -> Column:
    """Image links a page declares, best first."""
    def declared(page: Column) -> Column:
        metas = let(tags(page, "meta"), lambda m: F.array(
            first_meta(m, "property", "og:image"), first_meta(m, "name", "twitter:image"),
            first_meta(m, "property", "og:image:secure_url")))
        found = F.concat(metas, F.array(first_meta(tags(page, "link"), "rel", "image_src", "href")))
        return F.filter(F.transform(found, strip), lambda u: u.isNotNull() & (u != ""))

    return let(visible_markup(html), declared)


def calendar_link(html: Column) -> Column:
    """Advertised calendar feed, else the first iCal-looking anchor; unresolved."""
    page = visible_markup(html)
    kind = lambda t: F.lower(F.coalesce(attribute(t, "type"), F.lit("")))
    declared = F.filter(
        tags(page, "link"),
        lambda t: F.coalesce(attribute(t, "rel") == "alternate", F.lit(False))
        & F.rlike(kind(t), F.lit("calendar|ical")) & (F.coalesce(attribute(t, "href"), F.lit("")) != ""))
    anchors = F.filter(hrefs(html), lambda h: F.rlike(h, F.lit(r"(?i)\.ics(?:$|[?#])|[?&]format=ical")))
    return F.coalesce(attribute(F.get(declared, F.lit(0)), "href"), F.get(anchors, F.lit(0)))
