"""Upserts, lifecycle guards, streams and the page-to-listing flow."""

import re
from datetime import datetime, timezone

from pyspark.sql import functions as F

from marquee.operators import lifecycle, listing, logs, upsert, validate
from marquee.plans import extract_queries, flows
from marquee.plans.views import NOW, Tables
from marquee.session import cut_lineage
from marquee.sources import adapters, feeds, structured
from marquee.streaming import ingest

T = "/root/testdata/sf0.001"
KEYS = ["source_id", "source_event_id"]


def rows(df):
    return sorted(tuple(str(v) for v in r) for r in df.select(*sorted(df.columns)).collect())


def test_upsert_twice_is_once(spark):
    t = Tables(spark, T)
    stored, batch = t.listings(), t.incoming()
    once = cut_lineage(upsert.applied(upsert.plan_upsert(stored, batch, KEYS, NOW, identity=("id", "canonical_id"))))
    again = upsert.plan_upsert(once, batch, KEYS, NOW, identity=("id", "canonical_id"))
    assert again.filter("outcome in ('inserted', 'updated')").count() == 0
    assert rows(upsert.applied(again)) == rows(once)


def test_identity_is_kept_and_last_row_wins(spark):
    schema = "id int, k string, title string, content_hash string, last_seen_at timestamp, n int"
    old = datetime(2020, 1, 1)
    stored = spark.createDataFrame([(1, "a", "A", "h", old, 0)], schema)
    batch = spark.createDataFrame([(9, "a", "B", "x", old, 1), (9, "a", "C", "y", old, 2)], schema)
    plan = upsert.plan_upsert(stored, batch, ["k"], NOW, arrival="n").collect()
    assert [(r["id"], r["title"], r["outcome"]) for r in plan] == [(1, "C", "updated")]


def above_scan(plan, table):
    """The operators over each scan of ``table``, up to the first join, in a printed plan."""
    lines = [(len(re.match(r"[\s:+|-]*", x).group()), x) for x in plan.splitlines() if x.strip()]
    found = []
    for at, (depth, line) in enumerate(lines):
        if "FileScan" in line and table in line:
            path = []
            for d, x in reversed(lines[:at]):
                if d < depth:
                    path.append(x)
                    depth = d
                    if "Join" in x:
                        break
            found.append(path)
    return found


def test_small_batch_leaves_stored_rows_in_place(spark, tmp_path):
    made = spark.range(1_000_000).selectExpr("id", "cast(id as string) k", "'t' title", "'h' content_hash", "now() last_seen_at", "0 n")
    made.write.parquet(f"{tmp_path}/stored_rows")
    stored = spark.read.parquet(f"{tmp_path}/stored_rows")
    batch = spark.sql("SELECT * FROM VALUES ('7', 'B', 'x', 1), ('new', 'C', 'y', 2) AS t(k, title, content_hash, n)")
    plan = upsert.plan_upsert(stored, batch, ["k"], NOW, arrival="n")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    found = above_scan(plan._jdf.queryExecution().executedPlan().toString(), "stored_rows")
    assert len(found) == 2 and all("BroadcastHashJoin" in path[-1] for path in found)
    assert not any("Exchange" in x for path in found for x in path)
    got = {r["outcome"]: r["n"] for r in plan.groupBy("outcome").agg(F.count("*").alias("n")).collect()}
    assert got == {None: 999_999, "updated": 1, "inserted": 1}


def test_groups_stay_when_nothing_expires(spark):
    events = spark.createDataFrame([(1, 10, NOW, None)], "id int, canonical_id int, start_at timestamp, end_at timestamp")
    groups = spark.createDataFrame([(10,), (11,)], "canonical_id int")
    metrics = spark.createDataFrame([(1,)], "event_id int")
    left = lifecycle.clean_expired(events, metrics, groups, NOW)
    assert left["groups"].count() == 2
    later = datetime(2030, 1, 1, tzinfo=timezone.utc)
    assert lifecycle.clean_expired(events, metrics, groups, later)["groups"].count() == 0


def test_conflicts_need_one_local_day(spark):
    from marquee.operators import itinerary
    utc = lambda d, h: datetime(2026, 5, d, h, tzinfo=timezone.utc)
    items = spark.createDataFrame(
        [(1, "a", utc(2, 3), utc(2, 6), False), (1, "b", utc(2, 5), utc(2, 7), False), (1, "c", utc(2, 3), utc(2, 4), False)],
        "session_id int, item_id string, start_at timestamp, end_at timestamp, all_day boolean")
    # a: 23:00 to 02:00, b: 01:00 next day, c: 23:00 to midnight.
    assert [(r["a"], r["b"]) for r in itinerary.conflicts(items).collect()] == [("a", "c")]


def test_saved_view_guard(spark):
    shows = spark.createDataFrame([(1, NOW, ["music"]), (2, NOW, ["art"])], "id int, start_at timestamp, categories array<string>")
    saved = spark.createDataFrame([(2,)], "id int")
    assert listing.saved_view(shows, saved, NOW, [], True).count() == 1
    assert listing.saved_view(shows, spark.createDataFrame([(7,)], "id int"), NOW, [], True).count() == 2
    assert listing.saved_view(shows, saved, NOW, ["music"], True).count() == 1


def test_page_to_listing(spark):
    t = Tables(spark, T)
    pages = extract_queries.jsonld_pages(t).withColumn("url", F.concat(F.lit("https://p.example.com/"), "id"))
    found = adapters.ADAPTERS["eventbrite"](pages.withColumnRenamed("id", "page_id"), ["page_id"])
    assert found.filter("offer is null or event_url is null").count() == 0
    batch = found.withColumn("source_id", F.lit(1)).withColumn("source_event_id", F.col("page_id").cast("string")).drop("pos")
    stored = spark.createDataFrame([], (
        "id bigint, source_id int, source_event_id string, canonical_id bigint, title string, start_at timestamp, end_at timestamp, "
        "all_day boolean, venue_name string, address string, city string, content_hash string, last_seen_at timestamp"))
    plan = cut_lineage(flows.ingest(stored, batch, NOW))
    counts = {r["outcome"]: r["count"] for r in plan.groupBy("outcome").count().collect()}
    assert counts["inserted"] > 0 and counts["skipped"] > 0
    table = upsert.applied(plan)
    assert table.filter("id is null").count() == 0 and table.select("id").distinct().count() == table.count()
    sources = spark.createDataFrame([(1, "src", True)], "source_id int, source_slug string, enabled boolean")
    grouped = flows.regroup(table, sources)
    assert grouped.count() == table.count() and grouped.filter("canonical_id is null").count() == 0


def test_structured_walk(spark):
    html = ('<script type="application/ld+json">{"@graph":[{"@type":"Event","name":"A","startDate":"2026-05-01T10:00","location":[["x"]],'
            '"offers":[{"availability":"http://schema.org/InStock","price":5,"url":"https://t.example.com"}]}]}</script>'
            '<script type="application/ld+json">{bad</script><!-- <script type="application/ld+json">{"@type":"Event","name":"no","startDate":"2026-05-01"}</script> -->')
    pages = spark.createDataFrame([(1, html)], "id int, html string")
    got = structured.extracted_events(structured.jsonld_events(pages, ["id"]), ["id"]).collect()
    assert [(r["title"], r["offer"]["status"], r["price_min"]) for r in got] == [("A", "unknown", 5.0)]


def test_ical_reset_and_folding(spark):
    feed = "BEGIN:VEVENT\nUID:lost\nBEGIN:VEVENT\nUID:1\nSUMMARY:Lo\n ng\nDTSTART:20260502T193000Z\nEND:VEVENT\nUID:x\n"
    rows_ = feeds.ical_events(spark.createDataFrame([(1, feed)], "id int, text string"), ["id"]).collect()
    assert [(r["uid"], r["summary"], r["dtstart_utc"]) for r in rows_] == [("1", "Long", True)]


def test_ical_venue_is_kept_whole_and_flagged(spark):
    venue = "Hall " * 50 + "end"
    feed = f"BEGIN:VEVENT\nUID:1\nSUMMARY:A\nLOCATION:{venue}\\, Clearwater\nDTSTART:20260502T193000Z\nEND:VEVENT\n"
    events = feeds.ical_events(spark.createDataFrame([(1, feed)], "id int, text string"), ["id"])
    got = feeds.ical_extracted(events, ["id"])
    assert got.first()["venue_name"] == venue
    assert "venue_name" in validate.judged(got, validate.EVENT_RULES()).first()["errors"]


def test_stream_upserts_equal_batch(spark, tmp_path):
    t = Tables(spark, T)
    stored, batch = t.listings(), t.incoming().withColumn("arrival", F.col("id"))
    root, source = str(tmp_path / "table"), str(tmp_path / "in")
    ingest.start_table(stored, root, pattern="yyyy-MM")
    batch.repartition(3, "id").write.parquet(source)
    stream = ingest.file_stream(spark, source, batch.schema, files_per_trigger=1)
    query = ingest.start_upserts(
        stream, root, str(tmp_path / "cp"), stored.schema, KEYS, "arrival", lambda: NOW, ("id", "canonical_id"), pattern="yyyy-MM")
    query.awaitTermination(300)
    assert query.lastProgress["batchId"] == 2
    want = upsert.applied(upsert.plan_upsert(stored, batch, KEYS, NOW, identity=("id", "canonical_id"), arrival="arrival"))
    assert rows(ingest.read_table(spark, root, stored.schema)) == rows(want)
    assert rows(ingest.read_table(spark, root, stored.schema, 0)) == rows(stored)


def test_a_batch_writes_the_days_it_touches(spark, tmp_path):
    schema = "id long, k string, title string, start_at timestamp, content_hash string, last_seen_at timestamp"
    day = lambda d, h=9: datetime(2026, 5, d, h, tzinfo=timezone.utc)
    stored = spark.createDataFrame([(i, f"k{i}", f"t{i}", day(1 + i % 6), f"h{i}", NOW) for i in range(12)] + [(99, "k99", "t", None, "h", NOW)], schema)
    root = str(tmp_path / "table")
    ingest.start_table(stored, root)

    def take(version, *changes):
        batch = spark.createDataFrame([(*c, n) for n, c in enumerate(changes)], schema + ", arrival long")
        ingest.upsert_batch(spark, batch, root, version, stored.schema, ["k"], "arrival", NOW)
        return {r["id"]: (r["title"], r["start_at"] and r["start_at"].day) for r in ingest.read_table(spark, root, stored.schema, version).collect()}

    def written(version):
        return sorted(p.parent.name.removeprefix("period=") for p in (tmp_path / "table" / "rows").glob(f"*/version={version}"))

    first = take(1, (0, "k0", "new", day(1), "x", NOW))
    assert written(1) == ["2026-05-01"] and first[0] == ("new", 1) and len(first) == 13
    # Day 6 is emptied by two moves; a new row opens a day; the row without a start changes in place.
    moves = [(5, "k5", "a", day(3), "y", NOW), (11, "k11", "b", day(3), "z", NOW), (50, "k50", "c", day(20), "q", NOW), (99, "k99", "d", None, "w", NOW)]
    for _ in range(2):  # a second attempt gives the same
        second = take(2, *moves)
        assert written(2) == ["2026-05-03", "2026-05-20", "none"] and len(second) == 14
        assert second[5] == ("a", 3) and second[11] == ("b", 3) and second[50] == ("c", 20) and second[99] == ("d", None)
    files = [x.split("/rows/")[1].split("/part-")[0] for x in ingest.read_table(spark, root, stored.schema).inputFiles()]
    assert "period=2026-05-06/version=0" not in files and "period=2026-05-02/version=0" in files
    assert take(3, (2, "k2", "t2", day(3), "h2", NOW)) == second


def test_a_batch_shuffles_the_rows_it_may_name_only(spark, tmp_path, monkeypatch):
    schema = "id long, k string, title string, start_at timestamp, content_hash string, last_seen_at timestamp"
    day = datetime(2026, 5, 1, tzinfo=timezone.utc)
    stored = spark.createDataFrame([(i, f"k{i}", f"t{i}", day, f"h{i}", NOW) for i in range(2000)], schema)
    batch = spark.createDataFrame([(i, f"k{i}", "new", day, "x", NOW, 1) for i in (3, 4, 5000)], schema + ", arrival long")
    root, write, seen = str(tmp_path), ingest._write_rows, []
    ingest.start_table(stored, root)
    monkeypatch.setattr(ingest, "_write_rows", lambda *a: seen.append(a) or write(*a))
    ingest.upsert_batch(spark, batch, root, 1, stored.schema, ["k"], "arrival", NOW)
    joined, still = seen[0][0], seen[0][5]
    assert 3 <= joined.count() < 50 and joined.count() + still.count() == 2001
    plan = still._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" in plan and "hashpartitioning" not in plan and "SortMergeJoin" not in plan
    want = upsert.applied(upsert.plan_upsert(stored, batch, ["k"], NOW, arrival="arrival"))
    assert rows(ingest.read_table(spark, root, stored.schema)) == rows(want)


def test_one_full_join_plans_the_same(spark):
    stored = spark.createDataFrame(
        [(1, "a", "x", "h1", NOW), (2, "b", None, "h2", None), (3, None, "z", "h3", NOW), (4, "d", "u", None, NOW), (5, "a", "twice", "h5", NOW)],
        "id long, k string, title string, content_hash string, last_seen_at timestamp")
    batch = spark.createDataFrame(
        [("a", "x2", "h1", None, 1, True), ("b", "y2", "n", None, 1, True), ("b", "y3", "n3", None, 2, None), (None, "w", "h3", None, 1, True),
         ("e", "new", "h", None, 1, True), ("f", "bad", "h", "broken", 1, True), ("g", "late", "h", None, 1, False), ("d", "v", None, None, 1, True)],
        "k string, title string, content_hash string, failed string, came int, inside boolean")
    for some in (batch, batch.withColumn("id", F.lit(70).cast("int")), batch.limit(0)):
        one, two = (upsert.plan_upsert(stored, some, ["k"], NOW, F.col("inside"), reject="failed", arrival="came", whole=w) for w in (False, True))
        assert one.columns == two.columns and rows(one) == rows(two)


def test_stream_counts_equal_batch(spark, tmp_path):
    metrics = Tables(spark, T).metrics()
    last = metrics.agg(F.max("created_at")).first()[0]
    # A far later row closes every window before it.
    tail = logs.accepted_metrics(metrics).limit(1).withColumn("created_at", F.lit(datetime(last.year + 1, 1, 1)))
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    metrics.coalesce(1).write.parquet(source)
    tail.coalesce(1).write.mode("append").parquet(source)
    stream = ingest.file_stream(spark, source, metrics.schema)
    ingest.start_action_counts(stream, out, str(tmp_path / "cp")).awaitTermination(120)
    got = {(r["start"].strftime("%Y-%m-%d"), r["action"]): r["n"] for r in spark.read.parquet(out).collect()}
    batch = logs.action_counts(logs.accepted_metrics(metrics)).filter("action is not null and day is not null")
    want = {(r["day"], r["action"]): r["n"] for r in batch.collect()}
    assert got == want
