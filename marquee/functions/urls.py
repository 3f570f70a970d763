"""URL checks and resolution of relative references."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from marquee.functions.text import let


def _absolute(c: Column) -> Column:
    return F.rlike(c, F.lit(r"^(?i:https?)://[^\s/?#]+"))


def http_url(c: Column) -> Column:
    """The URL when it is absolute http(s), with host lower-cased and a root path."""
    def clean(value: Column) -> Column:
        origin = F.lower(F.regexp_extract(value, r"^[A-Za-z]+://[^\s/?#]+", 0))
        rest = F.regexp_replace(value, r"^[A-Za-z]+://[^\s/?#]+/?", "/")
        return F.when(_absolute(value), F.concat(origin, F.replace(rest, F.lit(" "), F.lit("%20"))))

    return let(F.trim(c), clean)


def url_path(c: Column) -> Column:
    path = F.regexp_extract(F.trim(c), r"^[A-Za-z][A-Za-z0-9+.-]*://[^\s/?#]*([^?#]*)", 1)
    return F.regexp_replace(path, "^$", "/")


def url_host(c: Column) -> Column:
    return F.lower(F.regexp_extract(F.trim(c), r"^[A-Za-z][A-Za-z0-9+.-]*://([^\s/?#]*)", 1))


def path_segments(c: Column) -> Column:
    return F.filter(F.split(url_path(c), "/"), lambda s: s != "")


def path_id(c: Column) -> Column:
    """Id from the whole path: separators become dashes."""
    path = F.regexp_replace(F.regexp_replace(url_path(c), r"^/", ""), r"/+$", "")
    return F.coalesce(F.nullif(F.replace(path, F.lit("/"), F.lit("-")), F.lit("")), c)


def plausible_image(c: Column) -> Column:
    """An http(s) URL that does not look like an icon or a tracking pixel."""
    path = url_path(c)
    return F.coalesce(
        _absolute(F.trim(c))
        & (F.length(path) >= 5)
        & ~F.rlike(path, F.lit(r"(?i)\.(svg|ico|gif)$"))
        & ~F.rlike(c, F.lit(r"(?i)1x1|pixel|tracking|beacon")),
        F.lit(False),
    )


def valid_image(c: Column) -> Column:
    return F.coalesce(_absolute(F.trim(c)) & (F.length(url_path(c)) >= 2), F.lit(False))


_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"


def _fold_dots(path: Column) -> Column:
    """Remove ``.`` and ``..`` segments."""

    def step(kept: Column, part: Column) -> Column:
        return (
            F.when(part == ".", kept)
            .when(part == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(1))))
            .otherwise(F.array_append(kept, part)))

    parts = F.split(F.regexp_replace(path, r"/\.{1,2}$", "$0/"), "/")
    folded = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.when(F.rlike(path, F.lit(r"/\.{1,2}(/|$)")), F.array_join(folded, "/")).otherwise(path)


def _tidy(url: Column) -> Column:
    """Lower-case origin, a path of at least ``/``, dots folded, blanks encoded."""
    origin = F.lower(F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]+", 0))
    path = F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]+([^?#]*)", 1)
    tail = F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]+[^?#]*(.*)$", 1)
    rooted = F.regexp_replace(path, "^$", "/")
    whole = F.concat(origin, let(rooted, _fold_dots), tail)
    return F.when(F.rlike(url, F.lit(r"^(?i:https?)://[^/?#]+")), F.replace(whole, F.lit(" "), F.lit("%20"))).when(
        ~F.rlike(url, F.lit(r"^(?i:https?):")), url)


def resolve_url(href: Column, base: Column) -> Column:
    """Resolve a reference against ``base``; null when the result is not absolute."""

    def join(h: Column) -> Column:
        origin = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0)
        scheme = F.regexp_extract(base, _SCHEME, 0)
        page = F.regexp_extract(base, "^[^#]*", 0)
        folder = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*((?:/[^/?#]*)*)/", 1)
        return (
            F.when(F.rlike(h, F.lit(_SCHEME)), h)
            .when(origin == "", None)
            .when(F.startswith(h, F.lit("//")), F.concat(scheme, h))
            .when(F.startswith(h, F.lit("/")), F.concat(origin, h))
            .when(F.startswith(h, F.lit("?")), F.concat(F.regexp_extract(base, "^[^?#]*", 0), h))
            .when((h == "") | F.startswith(h, F.lit("#")), F.concat(page, h))
            .otherwise(F.concat(origin, folder, F.lit("/"), h)))

    return let(let(F.regexp_replace(F.trim(href), r"[\t\n\r]", ""), join), _tidy)
