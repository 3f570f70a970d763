"""Extraction from pages and feeds, and nested place names, on small hand-made inputs."""

import random

from pyspark.sql import functions as F

from marquee.operators import places
from marquee.sources import feeds, structured


def script(body):
    return f'<p>x</p><script type="application/ld+json">{body}</script>'


def names(spark, *bodies):
    pages = spark.createDataFrame([(1, "".join(map(script, bodies)))], "id int, html string")
    found = structured.jsonld_events(pages, ["id"])
    rows = found.select("pos", F.try_variant_get("ev", "$.name", "string").alias("name")).collect()
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    return [r["name"] for r in sorted(rows, key=lambda r: r["pos"])]


def test_members_of_a_graph_come_before_their_owner(spark):
    owner = ('{"@type": "EventSeries", "name": "no"}', '{"@type": "Festival", "name": "owner", "@graph": [{"@type": "MusicEvent", "name": "a"},'
             '[[{"@type": ["Thing", "danceEVENT"], "name": "b"}]], {"@graph": [{"@type": "Event", "name": "c"}]}, {"@type": 5}]}')
    assert names(spark, *owner, '[[], [{"@type": "Hackathon", "name": "d"}], {"@type": "Event", "name": "e"}]') == ["a", "b", "c", "owner", "d", "e"]


def test_only_whole_json_counts(spark):
    good = '{"@type": "Event", "name": "x", "name": "last"}'
    assert names(spark, good + "}", good + ", 1", "", "{", '"Event"', "[" * 5 + good + "]" * 5, good) == ["last", "last"]
    assert names(spark, '{"@type": "Event", "name": "a\nb"}', '{"@type": "Event", "name": "a\x01b"}') == ["ab"]


def test_fields_of_every_shape(spark):
    body = ('{"@type": "Event", "name": "Show", "startDate": "2026-05-01", "location": ["Hall", 5], "offers": ["x", {"price": "$5"}, {"lowPrice": 0, "highPrice": 3}],'
            '"image": {"url": "https://i.example.com/a.png"}, "keywords": ["A", 5], "about": [{"name": "B"}, "c"], "isAccessibleForFree": "TRUE"}')
    pages = spark.createDataFrame([(1, script(body)), (2, script('{"@type": "Event", "name": 5, "startDate": "2026-05-01"}'))], "id int, html string")
    rows = structured.extracted_events(structured.jsonld_events(pages, ["id"]), ["id"]).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r["venue_name"], r["address"], r["all_day"], r["is_free"], r["image_url"]) == ("Hall", None, True, True, "https://i.example.com/a.png")
    assert r["price_min"] is None and r["categories"] == ["a", "5", "b"]
    assert [(t["min"], t["max"]) for t in r["offer"]["tiers"]] == [(5.0, 5.0), (0.0, 3.0)]


def test_calendar_lines(spark):
    text = ("BEGIN:VEVENT\r\nuid;x=1:first\r\nUID:1\r\nSUMMARY;LANGUAGE=en:A: b\\, c\\;d\\ne\r\nDTSTART;TZID=America/New_York;value=date:20260502\r\n"
            "X-UID:no\r\nno colon\r\nDTEND:20260503T010203Z\r\nCATEGORIES:a,b\r\n ,c\r\nEND:VEVENT\r\n")
    r = feeds.ical_events(spark.createDataFrame([(1, text)], "id int, text string"), ["id"]).first()
    assert (r["uid"], r["summary"], r["categories"]) == ("1", "A: b, c;d\ne", "a,b,c")
    assert (r["dtstart"], r["dtstart_date"], r["dtstart_utc"], r["dtstart_tzid"]) == ("20260502", True, False, "AMERICA/NEW_YORK")
    assert (r["dtend_date"], r["dtend_utc"], r["url"], r["location"]) == (False, True, None, None)


REGISTRY = "map_id int, city string, name string, lat double, lng double, street string, locality string, region string, postcode string, phone string, website string"


def test_nested_names_equal_all_pairs(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("ab") for _ in range(rnd.randrange(2, 12)))
    known = [(i, rnd.choice("xy"), word(), 1.0, 2.0, None, None, None, None, None, None) for i in range(60)]
    own = [(100 + i, rnd.choice("xyz"), word(), 0.0, 0.0, None, None) for i in range(80)]
    got = places.verify(
        spark.createDataFrame(own, "id int, city string, name string, lat double, lng double, phone_number string, website_url string"),
        spark.createDataFrame(known, REGISTRY))
    want = {}
    for i, city, name, *_ in own:
        near = [((n != name), abs(len(n) - len(name)), k) for k, c, n, *_ in known
                if c == city and (n == name or (min(len(n), len(name)) >= 4 and (n in name or name in n)))]
        want[i] = min(near)[2] if near else None
    assert {r["id"]: r["map_id"] for r in got.collect()} == want
    empty = spark.createDataFrame([], REGISTRY)
    assert places.verify(spark.createDataFrame(own[:3], "id int, city string, name string, lat double, lng double, phone_number string, website_url string"), empty).filter("verified").count() == 0


def test_a_short_name_in_many_others(spark):
    reg = spark.range(20000).select(
        F.col("id").cast("int").alias("map_id"), F.lit("x").alias("city"), F.concat(F.lit("club"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("name"),
        F.lit(1.0).alias("lat"), F.lit(2.0).alias("lng"), *[F.lit(None).cast("string").alias(c) for c in ("street", "locality", "region", "postcode", "phone", "website")])
    own = spark.range(2000).select(
        "id", F.lit("x").alias("city"), F.when(F.col("id") % 2 == 0, "Club!").otherwise(F.concat(F.lit("The club"), F.lpad(F.col("id").cast("string"), 6, "0"))).alias("name"),
        F.lit(0.0).alias("lat"), F.lit(0.0).alias("lng"), F.lit(None).cast("string").alias("phone_number"), F.lit(None).cast("string").alias("website_url"))
    got = {r["id"]: r["map_id"] for r in places.verify(own, reg).collect()}
    assert got == {i: 0 if i % 2 == 0 else i for i in range(2000)}
