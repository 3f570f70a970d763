"""Listing links per source: anchor, absolute URL, pattern, id, first per URL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from marquee.dims import lookup
from marquee.functions.urls import path_id, path_segments, resolve_url, url_host, url_path
from marquee.sources.html import hrefs

# Slugs and sections that are not events.
MARKET_SKIP = [
    "cart", "jobs", "photos", "programs", "our-markets", "our-sponsors", "special-events",
    "market-and-events", "upcoming-markets-events", "gogreen", "fulfill-your-destiny-vendor-grant",
    "page", "about", "contact", "privacy", "terms", "newsletter", "blog", "news", "press",
]
SECTION_SKIP = ["all-events", "submit-an-event", "tampa-music-festivals"]


@dataclass(frozen=True)
class LinkRule:
    """``pick(href, url)`` gives (id, url) columns; a null id drops the link."""

    base: str
    pick: Callable[[Column, Column], tuple[Column, Column]]


def _none() -> Column:
    return F.lit(None).cast("string")


def _when(*conditions: Column) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return F.coalesce(out, F.lit(False))


def _match(text: Column, pattern: str, group: int = 1) -> Column:
    value = F.regexp_extract(text, pattern, group)
    return F.when(value != "", value)


def _plain_path(url: Column) -> Column:
    return F.regexp_replace(url_path(url), "/+$", "")


def _on_host(url: Column, host: str, path_pattern: str, make_id: Callable[[Column], Column]):
    """Path rule on one host: the URL is rebuilt without query and trailing slash."""
    path = _plain_path(url)
    ok = _when(url_host(url) == host, F.rlike(path, F.lit(path_pattern)))
    return F.when(ok, make_id(path)), F.concat(F.lit(f"https://{host}"), path)


def _trailing_number(href: Column, url: Column):
    absolute = F.when(F.startswith(href, F.lit("http")), href).otherwise(F.concat(F.lit("https://www.eventbrite.com"), href))
    part = _match(absolute, r"^https://www\.eventbrite\.com/e/([^/?#]+)")
    found = F.when(F.contains(href, F.lit("/e/")), _match(F.substring_index(part, "-", -1), r"^(\d+)$"))
    return found, F.concat(F.lit("https://www.eventbrite.com/e/"), part)


def _city_calendar(href: Column, url: Column):
    pattern = r"(?i)^/events/([a-z0-9-]+)/(\d+)$"
    return _on_host(url, "www.tampa.gov", pattern, lambda p: F.regexp_replace(p, pattern, "$1-$2"))


def _last_segment(href: Column, url: Column):
    parts = path_segments(url)
    ok = _when(
        F.rlike(href, F.lit("/events?/")), F.contains(url_host(url), F.lit("unation.com")), F.size(parts) >= 2,
        F.array_contains(parts, "events") | F.array_contains(parts, "event"))
    return F.when(ok, F.element_at(parts, -1)), url


def _events_path(href: Column, url: Column):
    found = _match(url_path(url), r"^/events/(.+?)/*$")
    return F.when(F.contains(href, F.lit("/events/")), found), url


def _clean_event_page(href: Column, url: Column):
    clean = F.regexp_replace(F.substring_index(url, "?", 1), "/$", "")
    ok = _when(
        F.contains(href, F.lit("/event")), F.rlike(clean, F.lit(r"(?i)/events?/[a-z0-9-]+")),
        ~F.rlike(clean, F.lit(r"(?i)/events?/?$")))
    last = F.element_at(F.filter(F.split(clean, "/"), lambda s: s != ""), -1)
    return F.when(ok, last), clean


def _venue_or_series(href: Column, url: Column):
    path = url_path(url)
    found = F.coalesce(
        _match(path, r"^/event/([^/]+)/tampa-funny-bone/?$"),
        _match(path, r"^/events/category/series/([^/]+)/tampa-funny-bone/?$"))
    return F.when(F.contains(href, F.lit("/event")), found), url


def _performance(href: Column, url: Column):
    shown = _match(F.concat(F.lit("?"), F.regexp_extract(url, r"\?([^#]*)", 1)), r"[?&]performanceId=(\d+)(?:&|$)")
    made = _match(url_path(url), r"/production/(\d+)")
    ok = _when(F.rlike(F.regexp_replace(url_host(url), r":\d+$", ""), F.lit(r"(?i)ovationtix\.com$")), shown.isNotNull())
    return F.when(ok, F.concat_ws(":", made, shown)), url


def _folder(prefix: str, origin: str):
    def pick(href: Column, url: Column):
        ok = _when(F.startswith(href, F.lit(f"/{prefix}/")) | F.startswith(href, F.lit(f"{origin}/{prefix}/")))
        return F.when(ok, _match(url_path(url), rf"^/{prefix}/([^/]+)/?$")), url

    return pick


def _root_slug(href: Column, url: Column):
    slug, clean = _on_host(
        url, "www.tampabaymarkets.com", r"(?i)^/[a-z0-9][a-z0-9-]*$", lambda p: F.substr(p, F.lit(2)))
    return F.when(~slug.isin(*MARKET_SKIP), slug), clean


def _dated_article(href: Column, url: Column):
    pattern = r"(?i)^/life-culture/entertainment/things-to-do/(\d{4})/(\d{2})/(\d{2})/([a-z0-9-]+)$"
    return _on_host(url, "www.tampabay.com", pattern, lambda p: F.regexp_replace(p, pattern, "$1$2$3-$4"))


def _section_slug(href: Column, url: Column):
    parts = path_segments(url)
    section, slug = F.get(parts, F.lit(1)), F.get(parts, F.lit(2))
    ok = _when(
        url_host(url) == "www.visittampabay.com", F.size(parts) >= 3, F.get(parts, F.lit(0)) == "tampa-events",
        ~section.isin(*SECTION_SKIP), F.rlike(slug, F.lit(r"(?i)^[a-z0-9-]+$")))
    return F.when(ok, F.concat_ws("-", section, slug)), F.concat(
        F.lit("https://www.visittampabay.com/"), F.array_join(parts, "/"))


def _municipal(href: Column, url: Column):
    return F.when(F.contains(url_host(url), F.lit("dunedinfl.net")), path_id(url)), url


def is_plan_page(url: Column) -> Column:
    """Four or more segments with ``plans`` third, or a short ``/m/<id>`` link."""
    parts = path_segments(url)
    long_form = (F.size(parts) >= 4) & (F.get(parts, F.lit(2)) == "plans")
    short_form = (F.get(parts, F.lit(0)) == "m") & (F.size(parts) >= 2)
    return _when(F.contains(url_host(url), F.lit("feverup.com")), long_form | short_form)


def _plan_page(href: Column, url: Column):
    return F.when(is_plan_page(url), F.element_at(path_segments(url), -1)), url


def _any_page(href: Column, url: Column):
    return F.when(F.rlike(url, F.lit("^https?://")), path_id(url)), url


# Sources with their base URLs and link shapes.
LINK_RULES: dict[str, LinkRule] = {
    "eventbrite": LinkRule("https://www.eventbrite.com", _trailing_number),
    "tampa_gov": LinkRule("https://www.tampa.gov", _city_calendar),
    "unation": LinkRule("https://www.unation.com", _last_segment),
    "straz_center": LinkRule("https://www.strazcenter.org", _events_path),
    "visit_st_pete_clearwater": LinkRule("https://www.visitstpeteclearwater.com", _clean_event_page),
    "funny_bone_tampa": LinkRule("https://tampa.funnybone.com", _venue_or_series),
    "side_splitters": LinkRule("https://sidesplitterscomedy.com", _performance),
    "dont_tell_comedy": LinkRule(
        "https://www.donttellcomedy.com", _folder("shows", "https://www.donttellcomedy.com")),
    "tampa_theatre": LinkRule("https://tampatheatre.org", _folder("live", "https://tampatheatre.org")),
    "tampa_bay_markets": LinkRule("https://www.tampabaymarkets.com", _root_slug),
    "tampa_bay_times": LinkRule("https://www.tampabay.com", _dated_article),
    "visit_tampa_bay": LinkRule("https://www.visittampabay.com", _section_slug),
    "dunedin_gov": LinkRule("https://www.dunedinfl.net", _municipal),
    "feverup": LinkRule("https://feverup.com", _plan_page),
}
ANY_PAGE = LinkRule("", _any_page)


def page_links(pages: DataFrame, key: list[str], base: Column, html: str = "html") -> DataFrame:
    """(key, pos, href, url) for every anchor; with references resolved."""
    anchors = pages.select(*key, base.alias("base"), F.posexplode(hrefs(F.col(html))).alias("pos", "href"))
    return anchors.withColumn("url", resolve_url(F.col("href"), F.col("base"))).drop("base").filter("url is not null")


def listing_links(pages: DataFrame, source: str = "source_slug", key: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Links of known sources: (key, source, source_event_id, url), first per URL and page."""
    known = pages.filter(F.col(source).isin(*LINK_RULES))
    anchors = known.select(*key, source, F.posexplode(hrefs(F.col("html"))).alias("pos", "href"))

    def hit(url: Column) -> Column:
        chosen = None
        for slug, rule in LINK_RULES.items():
            found, clean = rule.pick(F.col("href"), url)
            pair = F.struct(found.alias("id"), clean.alias("url"))
            here = F.col(source) == slug
            chosen = F.when(here, pair) if chosen is None else chosen.when(here, pair)
        return chosen

    base = lookup({slug: rule.base for slug, rule in LINK_RULES.items()}, F.col(source))
    found = F.transform(F.array(resolve_url(F.col("href"), base)), hit)
    # The outer form keeps the filter above the expansion, so each link is judged once.
    hits = anchors.select(*key, source, "pos", F.inline_outer(found)).filter("id is not null and url is not null")
    return (
        hits.groupBy(*key, source, "url").agg(F.min(F.struct("pos", "id")).alias("first"))
        .select(*key, source, F.col("first.id").alias("source_event_id"), "url", F.col("first.pos").alias("pos"))
    )


def clean_urls(links: DataFrame, key: list[str]) -> DataFrame:
    """Absolute http(s) URLs, first position per URL."""
    return links.filter(F.rlike("url", F.lit("^https?://"))).groupBy(*key, "url").agg(F.min("pos").alias("pos"))
