"""Calendar, RSS and vendor JSON feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from marquee.dims import TICKETING_STATUS, lookup
from marquee.functions.clock import feed_local_iso, ics_to_local, pick_local_iso
from marquee.functions.prices import currency, says_free
from marquee.functions.tags import canonical_tags, plain_tags
from marquee.functions.text import (
    clean_inline, decode_entities, detect_city, html_to_text, join_parts, let, nonempty, strip,
)
from marquee.functions.urls import http_url
from marquee.sources.structured import offer_struct

# --- iCal ------------------------------------------------------------------


def _unescape(c: Column) -> Column:
    for raw, plain in (("\\n", "\n"), ("\\,", ","), ("\\;", ";"), ("\\\\", "\\")):
        c = F.replace(c, F.lit(raw), F.lit(plain))
    return c


_PROPERTIES = ["UID", "SUMMARY", "DESCRIPTION", "LOCATION", "URL", "CATEGORIES", "DTSTART", "DTEND"]


def _properties(block: Column) -> Column:
    """The lines of a block with a known name, in order: name, parameters in capitals, and value.

    Each line is split once, at its first colon; no pattern is searched.
    """

    def of_line(line: Column) -> Column:
        head = F.upper(F.substring_index(line, ":", 1))
        return F.struct(
            F.substring_index(head, ";", 1).alias("name"), head.alias("head"), F.substr(line, F.instr(line, ":") + 1).alias("value"))

    lines = F.filter(F.split(block, "\n"), lambda x: F.contains(x, F.lit(":")))
    return F.filter(F.transform(lines, of_line), lambda p: p["name"].isin(_PROPERTIES))


def _property(properties: Column, name: str) -> Column:
    """Parameters (``head``) and ``value`` of the last line with this name; null when absent."""
    last = F.get(F.reverse(F.filter(properties, lambda p: p["name"] == name)), F.lit(0))
    return let(last, lambda p: F.struct(p["head"].alias("head"), _unescape(p["value"]).alias("value")))


def ical_events(feeds: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """Calendar text to one row per event that has a uid and a start."""
    unfolded = F.regexp_replace(F.regexp_replace(F.col(text), "\r\n", "\n"), r"\n[ \t]", "")
    tidy = F.regexp_replace(unfolded, r"(?m)^[ \t\r]+|[ \t\r]+$", "")
    begun = let(F.split(tidy, r"(?m)^BEGIN:VEVENT$"), lambda parts: F.slice(parts, F.lit(2), F.size(parts)))
    ended = F.transform(begun, lambda b: F.split(b, r"(?m)^END:VEVENT$"))
    chunks = F.transform(F.filter(ended, lambda b: F.size(b) > 1), lambda b: b[0])
    rows = feeds.select(*key, F.posexplode(chunks).alias("pos", "block")).select(*key, "pos", _properties(F.col("block")).alias("block"))
    # Filtered as an array: a filter of rows would be moved below and read every line again for each use.
    events = F.array(F.struct(*[_property(F.col("block"), name).alias(f"_{name.lower()}") for name in _PROPERTIES]))
    rows = rows.select(*key, "pos", F.inline(F.filter(
        events, lambda e: (e["_uid"]["value"] != "") & e["_dtstart"]["value"].isNotNull())))
    out = {}
    for name in ("uid", "summary", "description", "location", "url", "categories"):
        out[name] = F.col(f"_{name}.value")
    for name in ("dtstart", "dtend"):
        head, value = F.col(f"_{name}.head"), F.col(f"_{name}.value")
        out[name] = value
        out[f"{name}_date"] = F.coalesce(F.rlike(head, F.lit(r";VALUE=DATE(;|$)")), F.lit(False)) | F.coalesce(
            F.rlike(value, F.lit(r"^\d{8}$")), F.lit(False))
        out[f"{name}_utc"] = F.coalesce(F.endswith(value, F.lit("Z")), F.lit(False))
        out[f"{name}_tzid"] = nonempty(F.regexp_extract(head, r";TZID=([^;]*)", 1))
    return rows.select(*key, "pos", *[c.alias(name) for name, c in out.items()])


def ical_extracted(events: DataFrame, key: list[str]) -> DataFrame:
    """Calendar events to extracted events; venue is the text before the first comma."""
    location = clean_inline(F.col("location"))
    none = F.lit(None)
    rows = events.filter("summary <> ''").withColumns({
        "start_local": ics_to_local(F.col("dtstart"), F.col("dtstart_date"), F.col("dtstart_utc")),
        "end_local": ics_to_local(F.col("dtend"), F.col("dtend_date"), F.col("dtend_utc")),
    }).filter("start_local is not null")
    return rows.select(
        *key, "uid",
        clean_inline(F.col("summary")).alias("title"),
        nonempty(html_to_text(F.col("description"))).alias("description"),
        "start_local", "end_local", F.col("dtstart_date").alias("all_day"),
        nonempty(clean_inline(F.substring_index("location", ",", 1))).alias("venue_name"),
        nonempty(location).alias("address"), detect_city(location).alias("city"),
        none.cast("double").alias("price_min"), none.cast("double").alias("price_max"), F.lit(False).alias("is_free"),
        plain_tags(F.split("categories", ",")).alias("categories"), none.cast("string").alias("image_url"),
        F.col("url").alias("event_url"))


def prefer_feed(items: DataFrame, feed: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Item fields, overridden by the feed's row of the same id."""
    other = feed.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    joined = items.join(other, key, "left")
    return joined.select(*[
        F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in items.columns])


# --- RSS -------------------------------------------------------------------


def _element(item: Column, name: str) -> Column:
    def text(body: Column) -> Column:
        cdata = F.regexp_extract(body, r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$", 1)
        return F.coalesce(nonempty(cdata), decode_entities(body))

    return let(F.regexp_extract(item, rf"(?is)<{name}\b[^>]*>(.*?)</{name}\s*>", 1), text)


def rss_items(feeds: DataFrame, key: list[str], text: str = "text", origin: str = "https://cityofsafetyharbor.com") -> DataFrame:
    """Feed items with an ``EID`` in their link, first per id."""
    items = F.regexp_extract_all(F.col(text), F.lit(r"(?is)<item\b[^>]*>(.*?)</item\s*>"), 1)
    numbered = F.transform(items, lambda item, pos: F.struct(
        pos.alias("pos"), item.alias("item"),
        F.regexp_extract(strip(_element(item, "link")), r"(?i)[?&]EID=(\d+)", 1).alias("eid")))
    rows = feeds.select(*key, F.inline(F.filter(numbered, lambda i: i["eid"] != ""))).select(
        *key, "pos", "eid", clean_inline(_element(F.col("item"), "title")).alias("title"),
        html_to_text(_element(F.col("item"), "description")).alias("hint"))
    first = F.min_by(F.struct("title", "hint"), "pos")
    url = F.concat(F.lit(f"{origin}/Calendar.aspx?EID="), "eid")
    return rows.groupBy(*key, "eid").agg(first.alias("f")).select(*key, "eid", "f.title", url.alias("url"), "f.hint")


# --- calendar plug-in JSON --------------------------------------------------

PLUGIN_SCHEMA = """events array<struct<id:bigint,url:string,title:string,description:string,excerpt:string,
start_date:string,end_date:string,all_day:boolean,timezone:string,cost:string,
cost_details:struct<values:array<string>,currency_code:string>,image:variant,venue:variant,
categories:array<struct<name:string>>,tags:array<struct<name:string>>>>"""


def _plugin_rows(feeds: DataFrame, key: list[str], text: str) -> DataFrame:
    rows = feeds.select(*key, F.posexplode(F.from_json(F.col(text), PLUGIN_SCHEMA)["events"]).alias("pos", "e"))
    usable = rows.filter("e.id is not null and e.url <> ''")
    return usable.groupBy(*key, F.col("e.id").alias("event_id")).agg(F.min_by("e", "pos").alias("e"))


def _plugin_fields(rows: DataFrame) -> DataFrame:
    e = F.col("e")
    kind = F.regexp_extract(F.schema_of_variant(e["venue"]), r"^[A-Z]+", 0)
    venue = F.when(kind == "ARRAY", F.try_variant_get(e["venue"], "$[0]", "variant")).otherwise(e["venue"])

    def of(name: str) -> Column:
        return F.try_variant_get(venue, f"$.{name}", "string")

    numbers = F.filter(F.transform(e["cost_details"]["values"], lambda x: x.try_cast("double")), lambda x: x.isNotNull())
    address = join_parts([F.coalesce(of(p), F.lit("")) for p in ("address", "city", "state", "zip")])
    names = F.concat(*[
        F.coalesce(F.transform(e[c], lambda x: x["name"]), F.array().cast("array<string>")) for c in ("categories", "tags")])
    return rows.withColumns({
        "title": clean_inline(e["title"]), "text": html_to_text(F.coalesce(e["description"], e["excerpt"])),
        "venue_name": nonempty(clean_inline(of("venue"))), "address": nonempty(clean_inline(address)),
        "low": F.array_min(numbers), "high": F.array_max(numbers), "is_free": says_free(e["cost"]),
        "image_url": nonempty(F.try_variant_get(e["image"], "$.url", "string")),
        "tags": plain_tags(names, 6, 40)})


def plugin_extracted(feeds: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """Calendar plug-in feed to extracted events, first per typed id."""
    e, none = F.col("e"), F.lit(None).cast("string")
    rows = _plugin_fields(_plugin_rows(feeds, key, text).filter("e.title <> ''"))
    status = F.when(F.col("is_free"), "free").otherwise("on_sale")
    return rows.select(
        *key, F.col("event_id").cast("string").alias("source_event_id"), "title",
        nonempty(F.col("text")).alias("description"),
        feed_local_iso(e["start_date"]).alias("start_local"), feed_local_iso(e["end_date"]).alias("end_local"),
        F.coalesce(e["all_day"], F.lit(False)).alias("all_day"),
        "venue_name", "address",
        detect_city(F.concat_ws(" ", "venue_name", "address")).alias("city"),
        F.col("low").alias("price_min"), F.col("high").alias("price_max"), "is_free",
        F.col("tags").alias("categories"), "image_url",
        offer_struct(e["url"], status, F.lit("USD"), none, none, F.lit(None)).alias("offer"), e["url"].alias("event_url"),
    ).filter("start_local is not null")


def plugin_text(feeds: DataFrame, key: list[str], label: str, text: str = "text") -> DataFrame:
    """Text document of a plug-in record, for the text path."""
    e = F.col("e")
    rows = _plugin_fields(_plugin_rows(feeds, key, text))
    iso = lambda c: F.replace(c, F.lit(" "), F.lit("T"))
    document = F.to_json(F.struct(
        F.lit("https://schema.org").alias("@context"), F.lit("Event").alias("@type"), F.col("title").alias("name"),
        F.col("text").alias("description"), iso(e["start_date"]).alias("startDate"), iso(e["end_date"]).alias("endDate"),
        e["url"].alias("url"), F.col("image_url").alias("image"), F.col("is_free").alias("isAccessibleForFree"),
        F.when(F.col("low").isNotNull(), F.struct(
            F.lit("Offer").alias("@type"), F.coalesce(e["cost_details"]["currency_code"], F.lit("USD")).alias("priceCurrency"),
            F.col("low").alias("price"), F.col("high").alias("highPrice"))).alias("offers"),
        F.struct(F.lit("Place").alias("@type"), F.col("venue_name").alias("name"), F.col("address").alias("address")).alias("location"),
        F.col("tags").alias("keywords")))
    meta = F.concat_ws(
        "\n", F.concat(F.lit("og:title: "), "title"), F.concat(F.lit("og:url: "), e["url"]),
        F.concat(F.lit("og:image: "), "image_url"), F.concat(F.lit("event:start_time: "), iso(e["start_date"])),
        F.concat(F.lit("event:end_time: "), iso(e["end_date"])), F.concat(F.lit("event:timezone: "), e["timezone"]),
        F.concat(F.lit("event:cost: "), nonempty(e["cost"])))
    lines = F.concat_ws(
        "\n", F.lit(f"Source: {label}"), F.concat(F.lit("Title: "), "title"), F.concat(F.lit("Venue: "), "venue_name"),
        F.concat(F.lit("Address: "), "address"), F.concat(F.lit("Cost: "), nonempty(e["cost"])),
        F.concat(F.lit("Starts (local): "), e["start_date"], F.coalesce(F.concat(F.lit(" "), e["timezone"]), F.lit(""))),
        F.concat(F.lit("Ends (local): "), e["end_date"]), F.concat(F.lit("\n"), nonempty(F.col("text"))))
    whole = F.concat_ws("\n", F.lit("JSON-LD:"), document, F.lit(""), F.lit("MetaTags:"), meta, F.lit(""), F.lit("Text:"), lines)
    return rows.select(*key, F.col("event_id").cast("string").alias("source_event_id"), whole.alias("reduced"))


# --- ticketing JSON ----------------------------------------------------------

TICKETING_SCHEMA = """_embedded struct<events:array<struct<id:string,name:string,url:string,info:string,description:string,
pleaseNote:string,images:array<struct<url:string,width:int,height:int>>,
classifications:array<struct<segment:struct<name:string>,genre:struct<name:string>,subGenre:struct<name:string>>>,
priceRanges:array<struct<type:string,currency:string,min:double,max:double>>,
dates:struct<start:struct<localDate:string,localTime:string,noSpecificTime:boolean>,
end:struct<localDate:string,localTime:string>,status:struct<code:string>>,
sales:struct<public:struct<startDateTime:string>>,
_embedded:struct<venues:array<struct<name:string,city:struct<name:string>,state:struct<name:string,stateCode:string>,
postalCode:string,address:struct<line1:string,line2:string>>>>>>>"""


def best_image(images: Column) -> Column:
    """URL of the largest image; the first one on ties."""
    seed = F.struct(F.lit(None).cast("string").alias("url"), F.lit(-1).cast("bigint").alias("area"))

    def larger(best: Column, i: Column) -> Column:
        area = (F.coalesce(i["width"], F.lit(0)) * F.coalesce(i["height"], F.lit(0))).cast("bigint")
        better = F.coalesce(i["url"] != "", F.lit(False)) & (area > best["area"])
        return F.when(better, F.struct(i["url"].alias("url"), area.alias("area"))).otherwise(best)

    return http_url(F.aggregate(F.coalesce(images, F.array()), seed, larger)["url"])


def preferred_range(ranges: Column) -> Column:
    """The ``standard`` price range, else the first."""
    return F.coalesce(
        F.get(F.filter(ranges, lambda r: F.coalesce(r["type"] == "standard", F.lit(False))), F.lit(0)),
        F.get(ranges, F.lit(0)))


def _ticketing_fields(feeds: DataFrame, key: list[str], text: str) -> DataFrame:
    """Records of the feed, first per id, with what both readings of them need."""
    parsed = F.from_json(F.col(text), TICKETING_SCHEMA)["_embedded"]["events"]
    rows = feeds.select(*key, F.posexplode(parsed).alias("pos", "e")).filter("e.id <> '' and e.name <> ''")
    rows = rows.groupBy(*key, F.col("e.id").alias("source_event_id")).agg(F.min_by("e", "pos").alias("e"))
    e = F.col("e")
    venue = F.get(e["_embedded"]["venues"], F.lit(0))
    parts = [venue["address"]["line1"], venue["address"]["line2"], venue["city"]["name"],
             F.coalesce(venue["state"]["stateCode"], venue["state"]["name"]), venue["postalCode"]]
    start, end = e["dates"]["start"], e["dates"]["end"]
    price = preferred_range(e["priceRanges"])
    names = F.flatten(F.transform(
        F.coalesce(e["classifications"], F.array()),
        lambda c: F.filter(F.array(c["segment"]["name"], c["genre"]["name"], c["subGenre"]["name"]), lambda n: n != "")))
    segments = F.filter(F.transform(F.array(e["description"], e["info"], e["pleaseNote"]), html_to_text), lambda s: s != "")
    return rows.withColumns({
        "names": names,
        "start_local": pick_local_iso(start["localDate"], start["localTime"]),
        "end_local": pick_local_iso(end["localDate"], end["localTime"]),
        "venue_name": nonempty(clean_inline(venue["name"])),
        "address": nonempty(clean_inline(join_parts([F.coalesce(p, F.lit("")) for p in parts]))),
        "low": price["min"], "high": F.coalesce(price["max"], price["min"]), "text": F.array_join(segments, "\n\n"),
        "is_free": F.coalesce((price["min"] == 0) & (F.coalesce(price["max"], F.lit(0.0)) == 0), F.lit(False)),
    })


def ticketing_text(feeds: DataFrame, key: list[str], label: str, text: str = "text") -> DataFrame:
    """Text document of a ticketing record, for the text path."""
    rows = _ticketing_fields(feeds, key, text).withColumn("title", clean_inline(F.col("e.name")))
    e = F.col("e")
    document = F.to_json(F.struct(
        F.lit("https://schema.org").alias("@context"), F.lit("Event").alias("@type"), F.col("title").alias("name"),
        F.col("text").alias("description"), F.coalesce("start_local", F.lit("")).alias("startDate"), F.col("end_local").alias("endDate"),
        e["url"].alias("url"), best_image(e["images"]).alias("image"),
        F.when(F.size(e["_embedded"]["venues"]) > 0, F.struct(
            F.lit("Place").alias("@type"), F.col("venue_name").alias("name"), F.col("address").alias("address"))).alias("location"),
        F.when(F.col("low").isNotNull(), F.struct(
            F.lit("AggregateOffer").alias("@type"), F.coalesce(F.get(e["priceRanges"], F.lit(0))["currency"], F.lit("USD")).alias("priceCurrency"),
            F.col("low").alias("lowPrice"), F.col("high").alias("highPrice"))).alias("offers"),
        canonical_tags(F.col("names")).alias("keywords")))
    plain = lambda c: F.regexp_replace(c.cast("string"), r"\.0$", "")
    dash = F.when(F.coalesce(F.col("high") != 0, F.lit(False)) & (F.col("high") != F.col("low")), F.concat(F.lit(" \u2013 $"), plain(F.col("high"))))
    lines = F.concat_ws(
        "\n", F.lit(f"Source: {label}"), F.concat(F.lit("Title: "), "title"), F.concat(F.lit("Venue: "), "venue_name"),
        F.concat(F.lit("Address: "), "address"), F.concat(F.lit("Starts (local): "), "start_local"),
        F.concat(F.lit("Ends (local): "), "end_local"),
        F.concat(F.lit("Price: $"), plain(F.col("low")), F.coalesce(dash, F.lit(""))), F.concat(F.lit("\n"), nonempty(F.col("text"))))
    whole = F.concat_ws("\n", F.lit("JSON-LD:"), document, F.lit(""), F.lit("Text:"), lines)
    return rows.select(*key, "source_event_id", whole.alias("reduced"))


def ticketing_extracted(feeds: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """Ticketing feed to extracted events, first per id.

    The on-sale instant becomes New York local time.
    """
    rows = _ticketing_fields(feeds, key, text).filter("start_local is not null")
    e = F.col("e")
    start = e["dates"]["start"]
    names = F.col("names")
    money = F.coalesce(currency(F.get(e["priceRanges"], F.lit(0))["currency"]), F.lit("USD"))
    status = F.when(F.col("is_free"), "free").otherwise(
        lookup(TICKETING_STATUS, F.lower(e["dates"]["status"]["code"]), F.lit("on_sale")))
    on_sale = F.date_format(F.from_utc_timestamp(
        e["sales"]["public"]["startDateTime"].try_cast("timestamp"), "America/New_York"), "yyyy-MM-dd'T'HH:mm:ss")
    tiers = F.transform(F.filter(e["priceRanges"], lambda r: r["min"].isNotNull()), lambda r: F.struct(
        F.coalesce(r["type"], F.lit("Ticket")).alias("name"), r["min"].alias("min"),
        F.coalesce(r["max"], r["min"]).alias("max"), F.coalesce(currency(r["currency"]), money).alias("currency")))
    offer = offer_struct(http_url(e["url"]), status, money, on_sale, F.lit(None),
                         F.when(F.size(tiers) > 1, tiers))
    return rows.select(
        *key, "source_event_id", clean_inline(e["name"]).alias("title"),
        nonempty(F.col("text")).alias("description"), "start_local", "end_local",
        (F.coalesce(start["noSpecificTime"], F.lit(False)) | start["localTime"].isNull()).alias("all_day"),
        "venue_name", "address",
        detect_city(F.concat_ws(" ", "venue_name", "address")).alias("city"),
        F.col("low").alias("price_min"), F.col("high").alias("price_max"), "is_free",
        canonical_tags(names).alias("categories"), best_image(e["images"]).alias("image_url"),
        offer.alias("offer"), http_url(e["url"]).alias("event_url"))
