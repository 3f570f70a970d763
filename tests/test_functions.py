"""Scalar functions on hand-made rows, one per known trap."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from marquee.dims import source_rank
from marquee.functions import clock, geo, hashes, places, prices, tags, text, urls
from marquee.operators import itinerary, search
from marquee.functions.scores import EVENT_POINTS, effective_score
from marquee.sources import classify


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


L = F.lit


def cases():
    return [
        (text.match_text(L(" Arts & Theatre: Live! ")), "arts and theatre live"),
        (text.search_text(L("  Live   Music  ")), "live music"),
        (text.clean_inline(L("a\nb")), "ab"),
        (text.clean_inline(L("a  b ")), "a b"),
        (text.clean_inline(L("Pete&#8217;s &amp; Co &#x2019; &bogus;")), "Pete’s & Co ’ &bogus;"),
        (text.decode_entities(L("&#38;lt; &AMP; &#0; &#1114112;")), "< & &#0; &#1114112;"),
        (text.html_to_text(L("<p>A<br/>B</p><p>C</p>\n\n\n\nD")), "A\nB\n\nC\n\nD"),
        (text.dedupe_title(L("Tampa Bay Fest 2026")), "fest"),
        (text.dedupe_title(L("2026")), ""),
        (text.place_category(L("barbershop"), L("beaches")), "bar"),
        (text.place_category(L("unknown"), L("beaches")), "beach"),
        (text.place_category(L("unknown"), L("nothing")), "other"),
        (text.place_slug(L("!!!"), L("")), "place"),
        (text.detect_city(L("St. Pete")), "st_petersburg"),
        (text.detect_city(L("Tampania")), "other"),
        (text.ellipsis(L("x" * 141), 140), "x" * 137 + "..."),
        (text.ticket_call(L("rsvp")), "RSVP"),
        (tags.canonical_tags(F.array(*map(L, ["Markets/Shopping", "Arts & Theatre", "Live Show", "Kids", "markets"])), 6),
         ["market", "art", "theater", "music", "family"]),
        (tags.canonical_tags(F.array(L("R&B"), L("/x"), L("a" * 17)), 6), ["music", "a" * 17]),
        (prices.parse_price(L("Free")), 0.0),
        (prices.parse_price(L("$1,200.50")), 1200.5),
        (prices.parse_price(L("1.2.3")), None),
        (prices.says_free(L(" $0 ")), True),
        (prices.format_price(L(2.5), L(7.5), L(False)), "$3 – $8"),
        (prices.format_price(L(0.0), L(None).cast("double"), L(False)), "Free"),
        (places.phone(L("1 (813) 555-0100")), "(813) 555-0100"),
        (places.phone(L("+44 20 7946 0958")), "+44 20 7946 0958"),
        (places.phone(L("12345")), None),
        (places.opening_hours(F.array(L("Monday-Friday: 11:00 AM - 10:00 PM"), L("Saturday 10AM-11PM"), L("closed"))),
         ["Mon-Fri 11:00am-10:00pm", "Sat 10:00am-11:00pm"]),
        (places.price_range(L(" $$ ")), "$$"),
        (places.price_range(L("cheap")), None),
        (geo.nearest_city(L(28.1), L(-82.78)), "dunedin"),
        (geo.nearest_city(L(60.0), L(10.0)).isNotNull() & (geo.nearest_city(L(60.0), L(10.0)) != "other"), True),
        (geo.nearest_city(L(None).cast("double"), L(10.0)), None),
        (urls.http_url(L("ftp://x.example.com/a")), None),
        (urls.http_url(L("HTTPS://X.Example.com")), "https://x.example.com/"),
        (urls.plausible_image(L("https://x.example.com/pixel.png")), False),
        (urls.resolve_url(L("../b?x=1"), L("https://a.example.com/c/d/e")), "https://a.example.com/c/b?x=1"),
        (urls.resolve_url(L("//B.example.com"), L("https://a.example.com/c")), "https://b.example.com/"),
        (urls.resolve_url(L("?q"), L("https://a.example.com/c/d?z#f")), "https://a.example.com/c/d?q"),
        (urls.resolve_url(L("x y"), L("https://a.example.com")), "https://a.example.com/x%20y"),
        (urls.resolve_url(L("rel"), L("nowhere")), None),
        (urls.resolve_url(L("mailto:a@b.c"), L("https://a.example.com")), "mailto:a@b.c"),
        (clock.iso_to_local(L("2026-05-02T23:30:00Z")), "2026-05-02T19:30:00"),
        (clock.iso_to_local(L("2026-05-02")), "2026-05-02T00:00:00"),
        (clock.iso_to_local(L("soon")), None),
        (clock.ics_to_local(L("20260502T193000Z"), L(False), L(True)), "2026-05-02T15:30:00"),
        (clock.ics_to_local(L("20260502"), L(True), L(False)), "2026-05-02T00:00:00"),
        (clock.pick_local_iso(L("2026-05-02"), L("19:30")), "2026-05-02T19:30:00"),
        (clock.parse_local(L("junk")), None),
        (source_rank(L("dunedin_gov")), 115),
        (source_rank(L("eventbrite")), 0),
        (classify.is_transient(L("HTTP 503 for x")), True),
        (classify.is_transient(L("HTTP 404 for x")), False),
        (itinerary.parse_id_list(L("not json")), []),
        (itinerary.parse_tag_list(L('["a","b"]')), ["a", "b"]),
        (itinerary.parse_tag_list(L('["a",1]')), []),
        (itinerary.hours_list(L('["Mon 9-5"]')), ["Mon 9-5"]),
    ]


def test_scalars(spark):
    pairs = cases()
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(pairs)]).first()
    wrong = [(i, got, want) for i, (got, (_, want)) in enumerate(zip(row, pairs)) if got != want]
    assert not wrong


def test_similarity_of_contained_title(spark):
    a, b = L("tampa riverfest"), L("tampa riverfest presented by publix")
    s = one(spark, text.title_similarity(a, b, text.match_tokens(a), text.match_tokens(b)))
    assert s >= 0.9


def test_windows():
    friday = datetime(1998, 6, 5, 16, tzinfo=timezone.utc)
    utc = lambda *a: datetime(*a, tzinfo=timezone.utc)
    assert clock.window_bounds("week", friday) == (utc(1998, 6, 5, 4), utc(1998, 6, 13, 3, 59, 59, 999000))
    assert clock.window_bounds("tonight", friday)[0] == friday
    saturday, sunday, monday = utc(1998, 6, 6, 16), utc(1998, 6, 7, 16), utc(1998, 6, 8, 16)
    assert clock.window_bounds("weekend", saturday) == (utc(1998, 6, 6, 4), utc(1998, 6, 9, 3, 59, 59, 999000))
    assert clock.window_bounds("weekend", sunday)[1] == utc(1998, 6, 10, 3, 59, 59, 999000)
    assert clock.window_bounds("weekend", monday)[0] == utc(1998, 6, 12, 4)


def test_effective_score(spark):
    now = L(datetime(2026, 1, 3, tzinfo=timezone.utc))
    fresh, old = L(datetime(2026, 1, 2, tzinfo=timezone.utc)), L(datetime(2025, 1, 1, tzinfo=timezone.utc))
    assert one(spark, effective_score(L(None).cast("double"), fresh, L("x"), now)) == -1
    assert one(spark, effective_score(L(0.5), fresh, L("x"), now)) == 0.5
    assert one(spark, effective_score(L(0.5), old, L(""), now)) == pytest.approx(0.2)


def test_hash_ignores_order(spark):
    df = spark.createDataFrame([(1, "a", "b"), (2, "c", None)], "i int, slug string, title string")
    up = df.orderBy("i").groupBy().agg(hashes.group_hash(F.collect_list(F.struct("slug", "title"))).alias("h")).first()
    down = df.orderBy(F.desc("i")).groupBy().agg(hashes.group_hash(F.collect_list(F.struct("slug", "title"))).alias("h")).first()
    assert up == down
    assert one(spark, hashes.stable_hash(a=L(1), b=L(2))) == one(spark, hashes.stable_hash(b=L(2), a=L(1)))


def test_search_scores(spark):
    row = ("e1", "Riverfest Tampa", None, "Park", "tampa", ["music"], None, ["lively"], 0.9)
    other = ("e2", "Quilting", "riverfest nearby", "Hall", "tampa", [], None, [], 0.9)
    schema = ("id string, title string, description string, venue_name string, city string, categories array<string>, "
              "why_its_cool string, vibes array<string>, editorial_score double")
    rows = spark.createDataFrame([row, other], schema)
    got = {r["id"]: r["score"] for r in search.score_events(rows, "riverfest").collect()}
    assert got["e1"] == pytest.approx(100 + 70 + 28 + 9) and got["e2"] == pytest.approx(20 + 8 + 9)
    assert search.score_events(rows, "a").count() == 0
    assert search.score_events(rows, "quantum gardening").count() == 0
    assert set(EVENT_POINTS) == {"title", "venue_name", "city", "categories", "description", "why_its_cool", "vibes"}
