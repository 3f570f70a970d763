"""Queries over extraction. Pages and feeds are built from listing rows, so the
expected output is known; links and reduced text also run on the given pages."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from marquee.functions import clock, prices, urls
from marquee.operators import normalize as N
from marquee.plans.registry import query
from marquee.plans.views import local_instant, ny
from marquee.schemas import EXTRACTED_EVENT_TYPES
from marquee.sources import adapters, feeds as X, html as H, links as K, reduce as D, structured as J


def cat(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def cases(key: Column, *values: Column) -> Column:
    out = F.when(key == 0, values[0])
    for i, v in enumerate(values[1:], 1):
        out = out.when(key == i, v)
    return out


def _rows(t):
    return t.listings("id", "title", "description", "start_at", "end_at", "venue_name", "city", "price_min", "is_free")


def jsonld_pages(t):
    i = F.col("id")
    lit = F.lit
    start = cases(
        i % 3, F.date_format("start_at", "yyyy-MM-dd'T'HH:mm"), F.date_format("start_at", "yyyy-MM-dd"),
        F.date_format("start_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    kind = cases(i % 4, lit('"Event"'), lit('"MusicEvent"'), lit('["Thing","Festival"]'), lit('"Place"'))
    place = F.when(i % 2 == 0, cat(
        '{"@type":"Place","name":"', F.col("venue_name"), '","address":{"streetAddress":" 12 Bay St ","addressLocality":"Tampa","addressRegion":"FL","postalCode":""}}')
    ).otherwise(cat('"', F.col("venue_name"), '"'))
    offers = cases(
        i % 5, lit(""), lit('"offers":{"price":"Free"},'),
        cat('"offers":{"lowPrice":10.5,"highPrice":20,"priceCurrency":"usd","availability":"https://schema.org/InStock","url":"https://tix.example.com/', i, '"},'),
        lit('"offers":[{"price":"$15.00","name":"GA"},{"price":30,"name":"VIP","priceCurrency":"cad"}],'),
        lit('"offers":{"price":0,"availability":"http://schema.org/SoldOut"},'))
    image = cases(
        i % 3, cat('"image":"https://img.example.com/', i, '.jpg",'),
        cat('"image":["/rel.jpg",{"url":"https://IMG.example.com/', i, '.png"}],'), lit(""))
    words = F.when(i % 2 == 0, lit('"keywords":"Music, Live ,music"')).otherwise(lit('"keywords":["Art"," Food "]'))
    event = cat(
        '{"@type":', kind, ',"name":"', F.col("title"), ' &amp; more","startDate":"', start, '","endDate":null,"location":', place, ",",
        offers, image, words, ',"about":{"name":"Jazz"},"description":"<p>One</p><p>Two&#33;</p>"}')
    body = F.when(i % 7 < 3, event).when(i % 7 == 3, cat("[", event, "]")).when(
        i % 7 == 4, cat('{"@graph":[{"@type":"WebSite"},', event, "]}")).when(i % 7 == 5, cat(event, "}")).otherwise(
        cat("[[", event, "]]"))
    page = cat('<html><head><script type="application/ld+json">', body,
               "</script></head><body><!-- x --><article>", F.col("title"), "</article></body></html>")
    return _rows(t).select("id", page.alias("html"))


_JSONLD = f"""src AS (SELECT * FROM v_listings WHERE id % 4 <> 3 AND id % 7 <> 5),
jl AS (SELECT id, title || ' & more' AS title,
  CASE id % 3 WHEN 0 THEN strftime(start_at, '%Y-%m-%dT%H:%M:00') WHEN 1 THEN strftime(start_at, '%Y-%m-%dT00:00:00') ELSE strftime({ny('start_at')}, '%Y-%m-%dT%H:%M:%S') END AS start_local,
  id % 3 = 1 AS all_day, venue_name, CASE WHEN id % 2 = 0 THEN '12 Bay St, Tampa, FL' END AS address, CASE WHEN id % 2 = 0 THEN 'tampa' ELSE 'other' END AS city,
  CASE id % 5 WHEN 1 THEN 0 WHEN 2 THEN 10.5 WHEN 3 THEN 15 WHEN 4 THEN 0 END AS price_min,
  CASE id % 5 WHEN 1 THEN 0 WHEN 2 THEN 20 WHEN 3 THEN 15 WHEN 4 THEN 0 END AS price_max, id % 5 IN (1, 4) AS is_free,
  CASE id % 3 WHEN 0 THEN 'https://img.example.com/' || id || '.jpg' WHEN 1 THEN 'https://img.example.com/' || id || '.png' END AS image_url,
  CASE WHEN id % 2 = 0 THEN 'music|live|jazz' ELSE 'art|food|jazz' END AS categories,
  CASE id % 5 WHEN 1 THEN 'free' WHEN 2 THEN 'on_sale' WHEN 4 THEN 'free' END AS status,
  CASE WHEN id % 5 = 2 THEN 'https://tix.example.com/' || id END AS ticket_url, CASE WHEN id % 5 = 2 THEN 'USD' END AS currency,
  CASE WHEN id % 5 = 3 THEN 'GA:15.0,VIP:30.0' END AS tiers FROM src)"""


def jsonld(t):
    return J.extracted_events(J.jsonld_events(jsonld_pages(t), ["id"]), ["id"])


@query("jsonld_events", f"WITH {_JSONLD} SELECT id, title, 'One' || chr(10) || chr(10) || 'Two!' AS description, start_local, all_day, venue_name, address, city, price_min, price_max, is_free, image_url, categories FROM jl")
def jsonld_events(t):
    return jsonld(t).select(
        "id", "title", "description", "start_local", "all_day", "venue_name", "address", "city", "price_min", "price_max",
        "is_free", "image_url", F.array_join("categories", "|").alias("categories"))


@query("jsonld_offers", f"WITH {_JSONLD} SELECT id, status, ticket_url, currency, tiers FROM jl")
def jsonld_offers(t):
    tiers = F.array_join(F.transform("offer.tiers", lambda x: F.concat(x["name"], F.lit(":"), x["min"].cast("string"))), ",")
    return jsonld(t).select("id", "offer.status", "offer.ticket_url", "offer.currency", tiers.alias("tiers"))


@query("default_offers", f"""WITH {_JSONLD} SELECT id, coalesce(ticket_url, 'https://page.example.com/' || id) AS ticket_url,
  CASE WHEN id % 5 = 0 THEN 'on_sale' ELSE status END AS status FROM jl""")
def default_offers(t):
    page = F.concat(F.lit("https://page.example.com/"), "id")
    rows = jsonld(t).select("id", prices.default_offer(F.col("offer"), page, F.col("is_free")).alias("o"))
    return rows.select("id", "o.ticket_url", "o.status")


@query("structured_or_text", f"""WITH {_JSONLD} SELECT l.id, CASE WHEN jl.id IS NOT NULL THEN 'structured' WHEN l.id % 7 = 5 OR l.id % 5 = 0 THEN 'text' ELSE 'skipped' END AS path,
  CASE WHEN jl.id IS NULL AND NOT (l.id % 7 = 5 OR l.id % 5 = 0) THEN 'short_html' END AS reason FROM v_listings l LEFT JOIN jl ON jl.id = l.id""")
def structured_or_text(t):
    pages = jsonld_pages(t)
    long_text = (F.col("id") % 7 == 5) | (F.col("id") % 5 == 0)
    html = F.when(long_text, F.replace("html", F.lit("</article>"), F.lit(" words" * 60 + "</article>"))).otherwise(F.col("html"))
    reduced = pages.select("id", D.reduced_text(html).alias("reduced"))
    found = J.first_structured(jsonld(t), ["id"])
    return J.structured_or_text(pages, found, reduced, ["id"])


# --- links, images, calendar links -------------------------------------------

_SLUGS = list(K.LINK_RULES)


def link_pages(t):
    i, n = F.col("id"), F.col("id").cast("string")
    good = [
        cat('<a class="x" href="/e/show-', n, '?aff=1">a</a><a href="/e/show-', n, '">b</a><a href="/e/noid">c</a>'),
        cat("<a href='/events/slug-", n, "/", n, "/'>a</a><a href=\"https://elsewhere.com/events/a/1\">b</a>"),
        cat('<a href="/event/', n, '">a</a><a href="/event">b</a>'),
        cat('<a href="/events/a/', n, '/">a</a><a href="/events/">b</a>'),
        cat('<a href="/event/', n, '/?x=1">a</a><a href="/events/">b</a>'),
        cat('<a href="/event/', n, '/tampa-funny-bone/">a</a><a href="/event/', n, '/orlando/">b</a>'),
        cat('<a href="https://ci.ovationtix.com/1/production/77?performanceId=', n, '&amp;x=1">a</a><a href="/locations/">b</a>'),
        cat('<a href="/shows/', n, '">a</a><a href="/shows/">b</a>'),
        cat('<a href="/live/', n, '/">a</a><a href="/film/1">b</a>'),
        cat('<a href="/market-', n, '">a</a><a href="/cart">b</a><a href="/a/b">c</a>'),
        cat('<a href="/life-culture/entertainment/things-to-do/2026/04/20/top-', n, '/">a</a><a href="/news/1">b</a>'),
        cat('<a href="/tampa-events/music/show-', n, '">a</a><a href="/tampa-events/all-events/x">b</a>'),
        cat('<a href="/cal/', n, '/x/">a</a><a href="https://b.example.com/">b</a>'),
        cat('<a href="/en/tampa/plans/', n, '">a</a><a href="/en/tampa/">b</a>'),
    ]
    page = cat("<body><!-- <a href='/events/hidden/1'>h</a> --><script>var a='<a href=\"/event/9\">';</script>", cases(i % 14, *good), "</body>")
    slug = F.element_at(F.array(*map(F.lit, _SLUGS)), (i % 14 + 1).cast("int"))
    return t.listings("id").select(i.alias("page_id"), slug.alias("source_slug"), page.alias("html"))


@query("listing_links", """SELECT id AS page_id, CASE id % 14 WHEN 1 THEN 'slug-' || id || '-' || id WHEN 3 THEN 'a/' || id WHEN 6 THEN '77:' || id WHEN 9 THEN 'market-' || id
  WHEN 10 THEN '20260420-top-' || id WHEN 11 THEN 'music-show-' || id WHEN 12 THEN 'cal-' || id || '-x' ELSE CAST(id AS VARCHAR) END AS source_event_id,
 CASE id % 14 WHEN 0 THEN 'https://www.eventbrite.com/e/show-' || id WHEN 1 THEN 'https://www.tampa.gov/events/slug-' || id || '/' || id WHEN 2 THEN 'https://www.unation.com/event/' || id
  WHEN 3 THEN 'https://www.strazcenter.org/events/a/' || id || '/' WHEN 4 THEN 'https://www.visitstpeteclearwater.com/event/' || id WHEN 5 THEN 'https://tampa.funnybone.com/event/' || id || '/tampa-funny-bone/'
  WHEN 6 THEN 'https://ci.ovationtix.com/1/production/77?performanceId=' || id || '&x=1' WHEN 7 THEN 'https://www.donttellcomedy.com/shows/' || id WHEN 8 THEN 'https://tampatheatre.org/live/' || id || '/'
  WHEN 9 THEN 'https://www.tampabaymarkets.com/market-' || id WHEN 10 THEN 'https://www.tampabay.com/life-culture/entertainment/things-to-do/2026/04/20/top-' || id
  WHEN 11 THEN 'https://www.visittampabay.com/tampa-events/music/show-' || id WHEN 12 THEN 'https://www.dunedinfl.net/cal/' || id || '/x/' ELSE 'https://feverup.com/en/tampa/plans/' || id END AS url
FROM v_listings""")
def listing_links(t):
    return K.listing_links(link_pages(t)).select("page_id", "source_event_id", "url")


@query("page_link_counts", """WITH c AS (SELECT page_id, regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<(script|style)[^>]*>.*?</(script|style)>', '', 'gs') AS h FROM pages)
SELECT page_id, count(*) AS anchors FROM (SELECT page_id, unnest(regexp_extract_all(h, '<a[^>]*\\shref="([^"]+)"', 1)) AS u FROM c) GROUP BY page_id""")
def page_link_counts(t):
    found = H.hrefs(F.col("html"))
    return t.spread("pages").select("page_id", F.size(found).cast("bigint").alias("anchors")).filter("anchors > 0")


@query("page_urls_resolved", """WITH c AS (SELECT page_id, url, regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<(script|style)[^>]*>.*?</(script|style)>', '', 'gs') AS h FROM pages),
l AS (SELECT page_id, url, regexp_extract_all(h, '<a[^>]*\\shref="([^"]+)"', 1) AS u FROM c),
e AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://[^/?#]+')) || unnest(u) AS url, generate_subscripts(u, 1) - 1 AS pos FROM l)
SELECT page_id, url, CAST(min(pos) AS INTEGER) AS pos FROM e GROUP BY page_id, url""")
def page_urls_resolved(t):
    links = K.page_links(t.spread("pages"), ["page_id"], F.col("url"))
    return K.clean_urls(links, ["page_id"]).select("page_id", "url", "pos")


@query("path_ids", """SELECT page_id, coalesce(nullif(replace(regexp_replace(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '^/', ''), '/+$', ''), '/', '-'), ''), url) AS path_id FROM pages""")
def path_ids(t):
    return t.spread("pages").select("page_id", urls.path_id(F.col("url")).alias("path_id"))


@query("plan_page_urls", "SELECT id, id % 3 <> 2 AS is_plan FROM v_listings")
def plan_page_urls(t):
    i = F.col("id")
    url = cases(i % 3, cat("https://feverup.com/en/tampa/plans/", i), cat("https://feverup.com/m/", i), cat("https://feverup.com/en/tampa/", i))
    return t.listings("id").select("id", K.is_plan_page(url).alias("is_plan"))


@query("page_images", """SELECT id, CASE id % 4 WHEN 0 THEN 'https://v.example.com/img/' || id || '.jpg' WHEN 1 THEN 'https://tw.example.com/' || id || '.png' WHEN 2 THEN 'https://v.example.com/a/pic' || id || '.gif' END AS image_url FROM v_listings""")
def page_images(t):
    i = F.col("id")
    head = cases(
        i % 4, cat('<meta property="og:image" content=" /img/', i, '.jpg"><meta name="twitter:image" content="https://tw.example.com/x">'),
        cat('<meta content="https://tw.example.com/', i, '.png" name=\'twitter:image\'>'),
        cat('<meta property="og:image" content=""><link rel="image_src" href="pic', i, '.gif">'), F.lit("<title>none</title>"))
    pages = t.listings("id").select(
        "id", F.posexplode_outer(H.image_candidates(cat("<html><head>", head, "</head></html>"))).alias("pos", "raw"))
    resolved = pages.withColumn("u", urls.resolve_url(F.col("raw"), F.lit("https://v.example.com/a/b")))
    good = F.when(urls.valid_image(F.col("u")), F.struct("pos", "u"))
    return resolved.groupBy("id").agg(F.min(good)["u"].alias("image_url"))


@query("calendar_links", """SELECT id, CASE id % 3 WHEN 0 THEN 'https://c.example.com/cal/' || id || '.ics' WHEN 1 THEN 'https://c.example.com/x?format=ical&id=' || id END AS feed FROM v_listings""")
def calendar_links(t):
    i = F.col("id")
    page = cases(
        i % 3, cat('<link rel="alternate" type="application/rss+xml" href="/rss"><link rel="alternate" type="text/calendar" href="/cal/', i, '.ics"><a href="/other.ics">x</a>'),
        cat('<a href="/plain">p</a><a href="/x?format=ical&amp;id=', i, '">x</a><a href="/y.ics">y</a>'), F.lit("<a href='/none'>n</a>"))
    return t.listings("id").select("id", urls.resolve_url(H.calendar_link(page), F.lit("https://c.example.com/calendar")).alias("feed"))


# --- reduced text --------------------------------------------------------------


@query("reduced_pages", r"""WITH a AS (SELECT page_id, regexp_replace(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '</?[a-zA-Z][^>]*>', '', 'g') AS s FROM pages),
b AS (SELECT page_id, replace(replace(replace(replace(replace(replace(s, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS s FROM a)
SELECT page_id, 'Text:' || chr(10) || trim(regexp_replace(regexp_replace(s, '[ \t\x{00A0}]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS reduced FROM b""")
def reduced_pages(t):
    return t.spread("pages").select("page_id", D.reduced_text(F.col("html")).alias("reduced"))


@query("reduced_listing_pages", f"""SELECT id, CASE WHEN id % 4 = 3 THEN '' ELSE 'JSON-LD:' || chr(10) || '{{"@type":"Event","id":' || id || '}}' || chr(10) || chr(10) END
 || 'MetaTags:' || chr(10) || 'og:title: ' || title || chr(10) || chr(10) || 'Text:' || chr(10) || title || ' at ' || venue_name || CASE WHEN id % 4 = 2 THEN ' ' || trim(repeat('long ', 4000)) ELSE '' END AS reduced FROM v_listings""")
def reduced_listing_pages(t):
    i = F.col("id")
    kind = F.when(i % 4 == 3, "Place").otherwise("Event")
    page = cat(
        '<html><head><meta property="og:title" content="', F.col("title"), '"><meta name="robots" content="x"><script type="application/ld+json">{"@type":"', kind, '","id":', i,
        "}</script></head><body><nav>menu</nav><article>", F.col("title"), "  at <b>", F.col("venue_name"), F.when(i % 4 == 2, F.repeat(F.lit(" long"), 4000)).otherwise(""),
        '</b><form>no</form><div aria-hidden="true">no<p>no</div><!-- c --><footer>foot</footer></article><p>after</p></body></html>')
    return t.listings("id", "title", "venue_name").select("id", D.reduced_text(page).alias("reduced"))


# --- feeds -----------------------------------------------------------------------


def ical_feeds(t):
    i = F.col("id")
    stamp = lambda c, f: F.date_format(c, f)
    start = cases(
        i % 3, cat("DTSTART;TZID=America/New_York:", stamp("start_at", "yyyyMMdd'T'HHmmss")),
        cat("DTSTART;VALUE=DATE:", stamp("start_at", "yyyyMMdd")), cat("DTSTART:", stamp("start_at", "yyyyMMdd'T'HHmmss'Z'")))
    text = cat(
        "BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nUID:", F.when(i % 11 == 0, "").otherwise(cat("u-", i)), "\r\nSUMMARY:", F.col("title"), "\\, live\r\n",
        start, "\r\nLOCATION:", F.col("venue_name"), "\\, Clear\r\n water\r\nDESCRIPTION:One\\nTwo\r\nCATEGORIES:Music, Art\r\nURL:https://e.example.com/", i,
        "\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nUID:lost\r\nEND:VEVENT\r\nEND:VCALENDAR\r\n")
    return t.listings("id", "title", "start_at", "venue_name").select("id", text.alias("text"))


@query("ical_events", f"""SELECT id, 'u-' || id AS uid, title || ', live' AS title, 'One' || chr(10) || 'Two' AS description,
  CASE id % 3 WHEN 0 THEN strftime(start_at, '%Y-%m-%dT%H:%M:%S') WHEN 1 THEN strftime(start_at, '%Y-%m-%dT00:00:00') ELSE strftime({ny('start_at')}, '%Y-%m-%dT%H:%M:%S') END AS start_local,
  id % 3 = 1 AS all_day, venue_name, venue_name || ', Clearwater' AS address, 'clearwater' AS city, 'music|art' AS categories, 'https://e.example.com/' || id AS event_url
FROM v_listings WHERE id % 11 <> 0""")
def ical_events(t):
    rows = X.ical_extracted(X.ical_events(ical_feeds(t), ["id"]), ["id"])
    return rows.select("id", "uid", "title", "description", "start_local", "all_day", "venue_name", "address", "city",
                       F.array_join("categories", "|").alias("categories"), "event_url")


@query("feed_over_page", """SELECT id, CASE WHEN id % 11 <> 0 THEN title || ', live' ELSE title END AS title FROM v_listings""")
def feed_over_page(t):
    feed = X.ical_extracted(X.ical_events(ical_feeds(t), ["id"]), ["id"]).select("id", "title")
    return X.prefer_feed(t.listings("id", "title"), feed, "id", ["title"])


@query("calendar_over_pages", f"""WITH {_JSONLD} SELECT id, title || ', live' AS title, 'https://e.example.com/' || id AS event_url FROM v_listings WHERE id % 11 <> 0
UNION ALL SELECT id, title, NULL FROM jl WHERE id % 11 = 0""")
def calendar_over_pages(t):
    """Pages of one source, with the calendar's event where it has the page's path."""
    pages = jsonld_pages(t).withColumn("url", F.concat(F.lit("https://p.example.com/"), "id"))
    adapter = adapters.calendar_first(ical_feeds(t).withColumnRenamed("id", "feed_id"), ["feed_id"])
    return adapter(pages, ["id"]).select("id", "title", "event_url")


_RSS = """SELECT id, CAST(id AS VARCHAR) AS eid, title || ' & co' AS title, 'https://cityofsafetyharbor.com/Calendar.aspx?EID=' || id AS url, 'Hint' || chr(10) || 'two' AS hint FROM v_listings"""


@query("rss_items", _RSS)
def rss_items(t):
    text = cat(
        "<rss><channel><item><title>", F.col("title"), " &amp; co</title><link>https://x.example.com/Calendar.aspx?EID=", F.col("id"),
        "&amp;m=1</link><description><![CDATA[Hint<br/>two]]></description></item><item><title>dup</title><link>https://x.example.com/?EID=", F.col("id"),
        "</link></item><item><title>none</title><link>https://x.example.com/</link></item></channel></rss>")
    return adapters.LISTINGS["safety_harbor"](t.listings("id", "title").select("id", text.alias("text")), ["id"])


def plugin_feeds(t):
    i = F.col("id")
    venue = F.when(i % 2 == 0, cat('{"venue":"', F.col("venue_name"), '","address":"1 Main","city":"Dunedin","state":"FL"}')).otherwise(F.lit("[]"))
    values = F.when(i % 3 == 0, F.lit('["12","x","7.5"]')).otherwise(F.lit("[]"))
    text = cat(
        '{"events":[{"id":', i, ',"url":"https://p.example.com/', i, '","title":"', F.col("title"), ' &#8217;26","description":"<p>A</p>","start_date":"',
        F.date_format("start_at", "yyyy-MM-dd HH:mm:ss"), '","all_day":', F.when(i % 4 == 0, "true").otherwise("false"), ',"cost":"', F.when(i % 5 == 0, " Free ").otherwise("$9"),
        '","cost_details":{"values":', values, '},"image":', F.when(i % 2 == 0, cat('{"url":"https://i.example.com/', i, '"}')).otherwise(F.lit("false")), ',"venue":', venue,
        ',"categories":[{"name":"Music"},{"name":"music "}],"tags":[{"name":"Late"}]},{"id":', i, ',"url":"https://dup","title":"dup","start_date":"2020-01-01"},{"id":"text","url":"u","title":"bad","start_date":"2020-01-01"}]}')
    return t.listings("id", "title", "start_at", "venue_name").select("id", text.alias("text"))


@query("plugin_feed_events", """SELECT id, CAST(id AS VARCHAR) AS source_event_id, title || ' ’26' AS title, strftime(start_at, '%Y-%m-%dT%H:%M:%S') AS start_local, id % 4 = 0 AS all_day,
  CASE WHEN id % 2 = 0 THEN venue_name END AS venue_name, CASE WHEN id % 2 = 0 THEN '1 Main, Dunedin, FL' END AS address, CASE WHEN id % 2 = 0 THEN 'dunedin' ELSE 'other' END AS city,
  CASE WHEN id % 3 = 0 THEN 7.5 END AS price_min, CASE WHEN id % 3 = 0 THEN 12.0 END AS price_max, id % 5 = 0 AS is_free, 'music|late' AS categories,
  CASE WHEN id % 2 = 0 THEN 'https://i.example.com/' || id END AS image_url, CASE WHEN id % 5 = 0 THEN 'free' ELSE 'on_sale' END AS status FROM v_listings""")
def plugin_feed_events(t):
    return X.plugin_extracted(plugin_feeds(t), ["id"]).select(
        "id", "source_event_id", "title", "start_local", "all_day", "venue_name", "address", "city", "price_min", "price_max", "is_free",
        F.array_join("categories", "|").alias("categories"), "image_url", "offer.status")


_PSTART = "strftime(start_at, '%Y-%m-%dT%H:%M:%S')"


@query("plugin_feed_text", f"""SELECT id, 'JSON-LD:' || chr(10) || '{{"@context":"https://schema.org","@type":"Event","name":"' || title || ' ’26","description":"A","startDate":"' || {_PSTART} || '","url":"https://p.example.com/' || id || '"'
  || CASE WHEN id % 2 = 0 THEN ',"image":"https://i.example.com/' || id || '"' ELSE '' END || ',"isAccessibleForFree":' || CASE WHEN id % 5 = 0 THEN 'true' ELSE 'false' END
  || CASE WHEN id % 3 = 0 THEN ',"offers":{{"@type":"Offer","priceCurrency":"USD","price":7.5,"highPrice":12.0}}' ELSE '' END || ',"location":{{"@type":"Place"'
  || CASE WHEN id % 2 = 0 THEN ',"name":"' || venue_name || '","address":"1 Main, Dunedin, FL"' ELSE '' END || '}},"keywords":["music","late"]}}' || chr(10) || chr(10)
  || 'MetaTags:' || chr(10) || 'og:title: ' || title || ' ’26' || chr(10) || 'og:url: https://p.example.com/' || id || CASE WHEN id % 2 = 0 THEN chr(10) || 'og:image: https://i.example.com/' || id ELSE '' END
  || chr(10) || 'event:start_time: ' || {_PSTART} || chr(10) || 'event:cost: ' || CASE WHEN id % 5 = 0 THEN ' Free ' ELSE '$9' END || chr(10) || chr(10)
  || 'Text:' || chr(10) || 'Source: Plug' || chr(10) || 'Title: ' || title || ' ’26' || CASE WHEN id % 2 = 0 THEN chr(10) || 'Venue: ' || venue_name || chr(10) || 'Address: 1 Main, Dunedin, FL' ELSE '' END
  || chr(10) || 'Cost: ' || CASE WHEN id % 5 = 0 THEN ' Free ' ELSE '$9' END || chr(10) || 'Starts (local): ' || strftime(start_at, '%Y-%m-%d %H:%M:%S') || chr(10) || chr(10) || 'A' AS reduced FROM v_listings""")
def plugin_feed_text(t):
    return X.plugin_text(plugin_feeds(t), ["id"], "Plug").select("id", "reduced")


def ticketing_feeds(t):
    i = F.col("id")
    text = cat(
        '{"_embedded":{"events":[{"id":"T', i, '","name":"', F.col("title"), '","url":"https://t.example.com/', i, '","info":"<b>Info</b>","pleaseNote":"Note",',
        '"images":[{"url":"https://i.example.com/s","width":10,"height":10},{"url":"https://i.example.com/l","width":30,"height":20},{"url":"https://i.example.com/m","width":20,"height":30}],',
        '"classifications":[{"segment":{"name":"Arts & Theatre"},"genre":{"name":"Theatre"}}],"priceRanges":[{"type":"vip","currency":"usd","min":50,"max":90},{"type":"standard","currency":"usd","min":',
        F.when(i % 4 == 0, "0").otherwise("20"), ',"max":', F.when(i % 4 == 0, "0").otherwise("40"), '}],"dates":{"start":{"localDate":"', F.date_format("start_at", "yyyy-MM-dd"), '"',
        F.when(i % 3 != 0, cat(',"localTime":"', F.date_format("start_at", "HH:mm:ss"), '"')).otherwise(""), '},"status":{"code":"', F.when(i % 2 == 0, "OnSale").otherwise("postponed"),
        '"}},"sales":{"public":{"startDateTime":"', F.date_format("start_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        '"}},"_embedded":{"venues":[{"name":"', F.col("venue_name"), '","city":{"name":"Clearwater"},"state":{"stateCode":"FL"},"postalCode":"33755","address":{"line1":"5 Gulf"}}]}},{"id":"","name":"x"}]}}')
    return t.listings("id", "title", "start_at", "venue_name").select("id", text.alias("text"))


@query("ticketing_feed_events", f"""SELECT id, 'T' || id AS source_event_id, title, 'Info' || chr(10) || chr(10) || 'Note' AS description,
  CASE WHEN id % 3 = 0 THEN strftime(start_at, '%Y-%m-%dT00:00:00') ELSE strftime(start_at, '%Y-%m-%dT%H:%M:%S') END AS start_local, id % 3 = 0 AS all_day, venue_name,
  '5 Gulf, Clearwater, FL, 33755' AS address, 'clearwater' AS city, CASE WHEN id % 4 = 0 THEN 0.0 ELSE 20.0 END AS price_min, CASE WHEN id % 4 = 0 THEN 0.0 ELSE 40.0 END AS price_max,
  id % 4 = 0 AS is_free, 'art|theater' AS categories, 'https://i.example.com/l' AS image_url,
  CASE WHEN id % 4 = 0 THEN 'free' WHEN id % 2 = 0 THEN 'on_sale' ELSE 'not_yet' END AS status, strftime({ny('start_at')}, '%Y-%m-%dT%H:%M:%S') AS on_sale_local, 2 AS tiers FROM v_listings""")
def ticketing_feed_events(t):
    return X.ticketing_extracted(ticketing_feeds(t), ["id"]).select(
        "id", "source_event_id", "title", "description", "start_local", "all_day", "venue_name", "address", "city", "price_min", "price_max", "is_free",
        F.array_join("categories", "|").alias("categories"), "image_url", "offer.status", "offer.on_sale_local", F.size("offer.tiers").alias("tiers"))


_TSTART = "CASE WHEN id % 3 = 0 THEN strftime(start_at, '%Y-%m-%dT00:00:00') ELSE strftime(start_at, '%Y-%m-%dT%H:%M:%S') END"


@query("ticketing_feed_text", f"""SELECT id, 'JSON-LD:' || chr(10) || '{{"@context":"https://schema.org","@type":"Event","name":"' || title || '","description":"Info\\n\\nNote","startDate":"' || {_TSTART}
 || '","url":"https://t.example.com/' || id || '","image":"https://i.example.com/l","location":{{"@type":"Place","name":"' || venue_name || '","address":"5 Gulf, Clearwater, FL, 33755"}},"offers":{{"@type":"AggregateOffer","priceCurrency":"usd","lowPrice":'
 || CASE WHEN id % 4 = 0 THEN '0.0,"highPrice":0.0' ELSE '20.0,"highPrice":40.0' END || '}},"keywords":["art","theater"]}}' || chr(10) || chr(10) || 'Text:' || chr(10) || 'Source: Tickets' || chr(10) || 'Title: ' || title
 || chr(10) || 'Venue: ' || venue_name || chr(10) || 'Address: 5 Gulf, Clearwater, FL, 33755' || chr(10) || 'Starts (local): ' || {_TSTART} || chr(10) || 'Price: $' || CASE WHEN id % 4 = 0 THEN '0' ELSE '20 – $40' END
 || chr(10) || chr(10) || 'Info' || chr(10) || chr(10) || 'Note' AS reduced FROM v_listings""")
def ticketing_feed_text(t):
    return X.ticketing_text(ticketing_feeds(t), ["id"], "Tickets").select("id", "reduced")


@query("local_time_strings", f"""SELECT id, strftime({ny('start_at')}, '%Y-%m-%dT%H:%M:%S') AS from_utc, strftime(start_at, '%Y-%m-%dT%H:%M:00') AS from_minutes,
  strftime(start_at + INTERVAL 5 HOUR, '%Y-%m-%dT%H:%M:%S') AS spaced, CAST(NULL AS VARCHAR) AS junk FROM v_listings""")
def local_time_strings(t):
    s = F.col("start_at")
    return t.listings("id", "start_at").select(
        "id", clock.iso_to_local(F.date_format(s, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")).alias("from_utc"),
        clock.iso_to_local(F.date_format(s, "yyyy-MM-dd'T'HH:mm")).alias("from_minutes"),
        clock.feed_local_iso(F.date_format(s + F.expr("INTERVAL 5 HOURS"), "yyyy-MM-dd HH:mm:ss")).alias("spaced"),
        clock.iso_to_local(F.lit("soon")).alias("junk"))


@query("parsed_prices", """SELECT id, CASE id % 4 WHEN 0 THEN 0.0 WHEN 1 THEN CAST(id % 97 AS DOUBLE) + 0.5 WHEN 2 THEN NULL ELSE 1200.0 END AS price, id % 4 = 0 AS free FROM v_listings""")
def parsed_prices(t):
    i = F.col("id")
    text = cases(i % 4, F.lit("Free"), cat("$", i % 97, ".50 USD"), F.lit("1.2.3"), F.lit("$1,200"))
    return t.listings("id").select("id", prices.parse_price(text).alias("price"), prices.says_free(text).alias("free"))


# --- normalization -----------------------------------------------------------------


@query("normalized_events", f"""WITH {_JSONLD}, loc AS (SELECT *, CASE WHEN id % 3 = 2 THEN NULL END AS z FROM jl)
SELECT loc.id, title, city, CASE WHEN loc.id % 3 = 2 THEN s.start_at WHEN loc.id % 3 = 0 THEN {local_instant('s.start_at')}
  ELSE (CAST(CAST(s.start_at AS DATE) AS TIMESTAMP) AT TIME ZONE 'America/New_York' AT TIME ZONE 'UTC') END AS start_at,
  price_min, ticket_url, status AS ticket_status, loc.image_url, CASE WHEN loc.id % 5 = 3 THEN 2 END AS tiers, CAST(NULL AS VARCHAR) AS reject_reason
FROM loc JOIN (SELECT id, start_at FROM v_listings) s ON s.id = loc.id""")
def normalized_events(t):
    rows = jsonld(t)
    out = N.normalize_events(rows.withColumn("content_hash", N.structured_hash()), ["id"])
    return out.select("id", "title", "city", "start_at", F.col("price_min").cast("double").alias("price_min"), "ticket_url",
                      "ticket_status", "image_url", F.size("price_tiers").alias("tiers"), "reject_reason")


@query("normalization_rejects", """SELECT id, CASE WHEN id % 7 = 0 THEN 'invalid startLocal: soon' ELSE 'empty title after sanitization' END AS reject_reason
FROM v_listings WHERE id % 7 = 0 OR id % 5 = 0""")
def normalization_rejects(t):
    i = F.col("id")
    rows = t.listings("id", "title", "start_at").select(
        "id", F.when(i % 5 == 0, "&nbsp; ​").otherwise(F.col("title")).alias("title"), F.lit("<p></p>").alias("description"),
        F.when(i % 7 == 0, "soon").otherwise(F.date_format("start_at", "yyyy-MM-dd")).alias("start_local"),
        *[F.lit(None).cast(EXTRACTED_EVENT_TYPES[c]).alias(c) for c in ("end_local", "venue_name", "address", "price_min", "price_max", "categories", "image_url", "offer")],
        F.lit(False).alias("all_day"), F.lit("other").alias("city"), F.lit(False).alias("is_free"), F.lit("u").alias("event_url"), F.lit("h").alias("content_hash"))
    return N.normalize_events(rows, ["id"]).filter("reject_reason is not null").select("id", "reject_reason")


@query("normalized_places", """SELECT id, name, trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') AS slug, category, city, address FROM v_places""")
def normalized_places(t):
    rows = t.places().withColumn("price_range", F.lit(" $$ "))
    return N.normalize_places(rows, ["id"]).select(
        "id", "name", "slug", "category",
        F.when(F.col("city") == "other", "other").otherwise(F.col("city")).alias("city"), "address")


@query("extractions_kept", "SELECT page_id FROM pages WHERE page_id % 3 = 0")
def extractions_kept(t):
    body = F.struct(F.col("url").alias("title"))
    rows = t.spread("pages").select("page_id", (F.col("page_id") % 3 != 2).alias("is_event"),
                                 F.when(F.col("page_id") % 3 != 1, body).alias("event"))
    return N.events_only(rows).select("page_id")
