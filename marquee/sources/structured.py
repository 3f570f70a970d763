"""schema.org events in JSON-LD blocks, mapped to the extracted-event shape.

Blocks are parsed to Variants; arrays and ``@graph`` are opened level by level
until none is left. Each object is then cast once to its fields, and every field
is read from there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from marquee.dims import AVAILABILITY_STATUS, lookup
from marquee.functions.clock import iso_to_local
from marquee.functions.prices import currency, parse_price
from marquee.functions.tags import plain_tags
from marquee.functions.text import (
    clean_inline, detect_city, html_to_text, join_parts, let, nonempty, strip,
)
from marquee.functions.urls import http_url
from marquee.session import write_table

_BLOCK = r"""(?is)<script\b[^>]*?\stype\s*=\s*["']?application/ld\+json["']?[^>]*>(.*?)</script\s*>"""
_EVENT_KINDS = ["Event", "Festival", "Hackathon"]


def jsonld_blocks(html: Column) -> Column:
    """JSON-LD script bodies, control characters removed."""
    page = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    bodies = F.transform(
        F.regexp_extract_all(page, F.lit(_BLOCK), 1),
        lambda b: F.regexp_replace(strip(b), r"[\u0000-\u0008\u000b\u000c\u000e-\u001f]", ""))
    return F.filter(bodies, lambda b: b != "")


def _list(v: Column) -> Column:
    """The items of a JSON array; null for anything else."""
    return F.try_variant_get(v, "$", "array<variant>")


def _is_event(node: Column) -> Column:
    def named(kind: Column) -> Column:
        return kind.isin(_EVENT_KINDS) | F.endswith(F.lower(kind), F.lit("event"))

    one, many = (F.try_variant_get(node, "$['@type']", k) for k in ("string", "array<string>"))
    return F.coalesce(named(one), F.lit(False)) | F.coalesce(F.exists(many, named), F.lit(False))


def jsonld_events(pages: DataFrame, key: list[str], html: str = "html") -> DataFrame:
    """(key, pos, ev): one Variant per event object; bad JSON is skipped.

    ``pos`` is the object's path: places in arrays, with the members of a
    ``@graph`` before the object that holds it. Paths sort in document order.
    """
    # The brackets make text behind a value an error, as it is to a JSON parser that reads to the end.
    parsed = _list(F.try_parse_json(F.concat(F.lit("["), F.col("text"), F.lit("]"))))

    # What is exploded is computed once; a filter on a computed column would compute it again for each use.
    whole = let(parsed, lambda items: F.when(F.size(items) == 1, items))
    text = F.col("text")
    # Only such texts hold more than one object that counts; the last test is for names in escapes.
    holding = F.startswith(text, F.lit("[")) | F.contains(text, F.lit("@graph")) | F.contains(text, F.lit("\\u"))
    holds = F.contains(html, F.lit("ld+json"))
    blocks = pages.select(*key, F.posexplode(F.when(holds, jsonld_blocks(F.col(html)))).alias("n", "text"))
    level = blocks.select(*key, F.array("n").alias("path"), holding.alias("holding"), F.explode(whole).alias("node"))
    node, path = F.col("node"), F.col("path")
    inner = F.coalesce(
        F.transform(_list(node), lambda x, i: F.struct(F.concat(path, F.array(i)).alias("path"), x.alias("node"))),
        F.transform(F.try_variant_get(node, "$['@graph']", "array<variant>"), lambda x, i: F.struct(
            F.concat(path, F.array(F.lit(0), i)).alias("path"), x.alias("node"))))
    read, levels = pages.sparkSession.read.schema(level.schema), []
    while not levels or not read.parquet(levels[-1]).isEmpty():
        levels.append(write_table(level))
        level = read.parquet(levels[-1]).filter("holding").select(*key, "holding", F.inline(inner)).select(level.columns)
    # One scan of all levels: each text is parsed once, and what reads the events is planned once.
    return read.parquet(*levels).filter(_is_event(node)).select(*key, F.concat(path, F.array(F.lit(1))).alias("pos"), node.alias("ev"))


def _fields(v: Column, *names: str) -> Column:
    """The named fields of a JSON object as Variants, in one cast; null for anything else."""
    return F.try_variant_get(v, "$", "struct<" + ", ".join(f"`{n}`: variant" for n in names) + ">")


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _text(v: Column) -> Column:
    """The value when it is a JSON string, else null."""
    return F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _has(v: Column) -> Column:
    return v.isNotNull() & ~F.is_variant_null(v)


def _items(v: Column) -> Column:
    """A scalar, object or array field as an array of Variants."""
    return F.coalesce(_list(v), F.when(_has(v), F.array(v)).otherwise(F.array().cast("array<variant>")))


def _price(v: Column) -> Column:
    return F.when(_kind(v) == "STRING", parse_price(F.try_variant_get(v, "$", "string"))).otherwise(
        F.try_variant_get(v, "$", "double"))


def _low(offer: Column) -> Column:
    return F.when(_has(offer["lowPrice"]), _price(offer["lowPrice"])).otherwise(_price(offer["price"]))


def _image(images: Column) -> Column:
    urls = F.transform(images, lambda i: http_url(F.coalesce(_text(i), _text(F.try_variant_get(i, "$.url", "variant")))))
    return F.get(F.filter(urls, lambda u: u.isNotNull()), F.lit(0))


def _keywords(words: Column, about: Column) -> Column:
    named = F.transform(_items(about), lambda a: _text(F.try_variant_get(a, "$.name", "variant")))
    listed = F.coalesce(
        F.split(_text(words), ","), F.try_variant_get(words, "$", "array<string>"), F.array().cast("array<string>"))
    return F.filter(F.concat(listed, named), lambda w: w.isNotNull() & (w != ""))


TIER = "struct<name:string,min:double,max:double,currency:string>"


def offer_struct(url: Column, status: Column, money: Column, on_sale: Column, valid: Column, tiers: Column) -> Column:
    return F.struct(
        url.alias("ticket_url"), status.alias("status"), money.alias("currency"),
        on_sale.cast("string").alias("on_sale_local"), valid.cast("string").alias("valid_from_local"),
        tiers.cast(f"array<{TIER}>").alias("tiers"))


def _tiers(offers: Column, money: Column) -> Column:
    built = F.transform(offers, lambda o: F.struct(
        F.coalesce(_text(o["name"]), _text(o["@type"]), F.lit("Ticket")).alias("name"),
        _low(o).alias("min"),
        F.coalesce(F.when(_has(o["highPrice"]), _price(o["highPrice"])).otherwise(_price(o["price"])), _low(o)).alias("max"),
        F.coalesce(currency(_text(o["priceCurrency"])), money).alias("currency")))
    priced = F.filter(built, lambda t: t["min"].isNotNull() | t["max"].isNotNull())
    return F.when(F.size(priced) > 1, priced)


_EVENT_FIELDS = ("name", "startDate", "endDate", "location", "offers", "image", "keywords", "about", "description", "url", "isAccessibleForFree")
_OFFER_FIELDS = ("name", "@type", "price", "lowPrice", "highPrice", "priceCurrency", "availability", "url", "validFrom")
_ADDRESS_FIELDS = ("streetAddress", "addressLocality", "addressRegion", "postalCode")


def extracted_events(events: DataFrame, key: list[str]) -> DataFrame:
    """JSON-LD Variants to extracted events; rows without name or start drop."""
    rows = events.select(*key, "pos", _fields(F.col("ev"), *_EVENT_FIELDS).alias("e"))
    v = F.col("e")
    start = _text(v["startDate"])
    named = F.array(F.struct(_text(v["name"]).alias("name"), start.alias("start"), iso_to_local(start).alias("start_local")))
    # Filtered as an array: a filter of rows would be moved below and open every object again for each use.
    rows = rows.select(*key, "pos", "e", F.inline(F.filter(
        named, lambda n: (n["name"] != "") & (n["start"] != "") & n["start_local"].isNotNull())))
    rows = rows.withColumns({
        "where": F.get(_items(v["location"]), F.lit(0)),
        "offers": F.transform(_items(v["offers"]), lambda o: _fields(o, *_OFFER_FIELDS))})
    rows = rows.withColumn("place", _fields(F.col("where"), "name", "address"))
    rows = rows.withColumn("parts", _fields(F.col("place.address"), *_ADDRESS_FIELDS))
    place, parts, offers = F.col("place"), F.col("parts"), F.col("offers")
    address = F.coalesce(_text(place["address"]), F.when(
        parts.isNotNull(), join_parts([F.coalesce(_text(parts[p]), F.lit("")) for p in _ADDRESS_FIELDS])))
    first = F.get(offers, F.lit(0))
    free_flag = F.try_variant_get(v["isAccessibleForFree"], "$", "string")
    rows = rows.withColumns({
        "end_local": iso_to_local(_text(v["endDate"])),
        "venue": nonempty(clean_inline(F.coalesce(_text(F.col("where")), _text(place["name"])))),
        "addr": nonempty(clean_inline(address)),
        "price_min": _low(first),
        "high": F.coalesce(_price(first["highPrice"]), _price(first["price"]), _low(first)),
        "money": currency(_text(first["priceCurrency"])),
        "flagged": F.coalesce(F.lower(free_flag) == "true", F.lit(False)),
    })
    rows = rows.withColumn("is_free", F.col("flagged") | F.coalesce(
        (F.col("price_min") == 0) & (F.col("high") == 0), F.lit(False)))
    status = F.when(F.col("is_free"), "free").when(
        _text(first["availability"]) != "", lookup(AVAILABILITY_STATUS, _text(first["availability"]), F.lit("unknown")))
    ticket = F.coalesce(http_url(_text(first["url"])), http_url(_text(v["url"])))
    rows = rows.withColumns({
        "ticket": ticket, "status": status,
        "tiers": F.when(F.size(offers) > 1, _tiers(offers, F.col("money"))),
        "valid_from": iso_to_local(_text(first["validFrom"]))})
    offered = (F.size(offers) > 0) | F.col("is_free")
    some = F.coalesce("ticket", "status").isNotNull() | F.col("tiers").isNotNull()
    offer = F.when(offered & some, offer_struct(
        F.col("ticket"), F.col("status"), F.col("money"), F.lit(None), F.col("valid_from"), F.col("tiers")))
    return rows.select(
        *key, "pos",
        clean_inline(F.col("name")).alias("title"),
        nonempty(html_to_text(_text(v["description"]))).alias("description"),
        "start_local", "end_local",
        F.rlike("start", F.lit(r"^\d{4}-\d{2}-\d{2}$")).alias("all_day"),
        F.col("venue").alias("venue_name"), F.col("addr").alias("address"),
        detect_city(F.concat_ws(" ", "venue", "addr")).alias("city"),
        "price_min", F.col("high").alias("price_max"), "is_free",
        plain_tags(_keywords(v["keywords"], v["about"])).alias("categories"),
        _image(_items(v["image"])).alias("image_url"), offer.alias("offer"),
        http_url(_text(v["url"])).alias("event_url"))


def first_structured(extracted: DataFrame, key: list[str]) -> DataFrame:
    """The first usable event of each page."""
    row = F.struct(*[c for c in extracted.columns if c not in key])
    return extracted.groupBy(*key).agg(F.min_by(row, "pos").alias("row")).select(*key, "row.*")


def structured_or_text(pages: DataFrame, structured: DataFrame, reduced: DataFrame, key: list[str]) -> DataFrame:
    """Which path each page takes: ``structured``, ``text``, or skipped as ``short_html``."""
    hit = structured.select(*key).distinct().withColumn("_s", F.lit(True))
    joined = pages.select(*key).join(hit, key, "left").join(reduced.select(*key, "reduced"), key, "left")
    return joined.select(
        *key,
        F.when(F.col("_s"), "structured").when(F.length("reduced") >= 200, "text").otherwise("skipped").alias("path"),
        F.when(F.col("_s").isNull() & ~F.coalesce(F.length("reduced") >= 200, F.lit(False)), "short_html").alias("reason"))
