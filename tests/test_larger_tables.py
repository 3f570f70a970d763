"""Steps that held at the size of the test tables and not at sixty times it."""

from pyspark.sql import functions as F

from marquee.functions import text
from marquee.functions.places import opening_hours
from marquee.operators import listing as L, places as P, resolve as R
from marquee.plans.place_queries import registry
from marquee.plans.listing_queries import whole
from marquee.plans.views import NOW, Tables
from marquee.sources import adapters, feeds, structured
from marquee.sources.reduce import reduce_page

T = "/root/testdata/sf0.001"


def test_registry_names_are_not_broadcast(spark):
    t = Tables(spark, T)
    found = P.verify(t.places(), registry(t))
    assert found.count() == t.places().count()
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_places_spread_and_hours_are_worked_out_once(spark):
    passed = P.normalization_pass(Tables(spark, T).places())
    assert passed.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    plan = passed.select("hours")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("11:00 AM") > 0 and plan.count("monday") == 1


def test_odd_hours(spark):
    given = [None, [], [None, " ", ""], ["closed", " CLOSED "], [None, "Monday 9am", "closed", "Tue: 10:00 p.m."], ["closed day"], [" - "]]
    rows = spark.createDataFrame(list(enumerate(given)), "i int, hours array<string>").repartition(2)
    got = rows.select("i", opening_hours(F.col("hours")).alias("h")).orderBy("i").collect()
    assert [r["h"] for r in got] == [None, None, None, None, ["Mon 9:00am", "Tue 10:00pm"], ["closed day"], ["-"]]


def test_tasks_grow_with_the_rows(spark, tmp_path):
    spark.range(1_000_000).coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    assert Tables(spark, str(tmp_path)).spread("orders").rdd.getNumPartitions() == 20
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "8m"


def test_shuffles_grow_with_the_rows(spark, tmp_path):
    """A sort for a group has a share of the rows, whatever their number."""
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    spark.range(1_000_000).coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    try:
        rows = Tables(spark, str(tmp_path)).spread("orders").groupBy("id").agg(F.max("id"))
        assert "hashpartitioning(id" in (plan := rows._jdf.queryExecution().executedPlan().toString())
        assert int(plan.split("hashpartitioning(id")[1].split(",")[1].split(")")[0]) == 20
    finally:
        spark.conf.unset(key)


def test_similar_titles_are_judged_once(spark):
    """Two similar titles on 400 days in two cities: one pair, and the days are linked."""
    rows = spark.range(1600).select(
        "id", F.when(F.col("id") % 2 == 0, "river jazz fest").otherwise("the river jazz fest show").alias("title"),
        F.when(F.col("id") % 4 < 2, "tampa").otherwise("brandon").alias("city"),
        (F.lit("2026-01-01 10:00:00").cast("timestamp") + F.make_dt_interval(days=F.floor(F.col("id") / 4).cast("int"))).alias("start_at"),
        F.lit(None).cast("timestamp").alias("end_at"), F.lit(False).alias("all_day"),
        F.lit("Hall").alias("venue_name"), F.lit(None).cast("string").alias("address"))
    keyed = R.keyed_rows(rows)
    found = R.similar_titles(keyed)
    assert isinstance(found, tuple) and found[1].count() == 1 and found[0].count() == 2
    assert R.similar_edges(keyed, R.title_cells(keyed)).count() == 800
    assert R.similar_pairs(keyed).count() == 800


def test_blanks_of_reduced_text():
    assert reduce_page("<p>a   b\t\tc \u00a0\u00a0 d\n\n\n\n\ne f </p>") == "Text:\na b c d\n\ne f"


def _feeds(spark, path, text):
    spark.createDataFrame([(1, text)], "id long, text string").write.parquet(f"{path}/feeds")
    return spark.read.parquet(f"{path}/feeds")


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_json_ld_objects_are_opened_once(spark, tmp_path):
    html = '<script type="application/ld+json">[{"@type":"Event","name":"a","startDate":"2026-01-02"},{"@graph":[{"@type":"Festival","name":"b","startDate":"2026-01-03"}]}]</script>'
    found = structured.jsonld_events(_feeds(spark, tmp_path, html), ["id"], "text")
    assert _optimized(found).count("Relation") == 1
    events = structured.extracted_events(found, ["id"])
    assert [r[0] for r in events.orderBy("pos").select("title").collect()] == ["a", "b"]
    filters = [x for x in _optimized(events).splitlines() if "Filter" in x]
    assert not any("startDate" in x for x in filters)


def test_calendar_lines_are_read_once(spark, tmp_path):
    text = "BEGIN:VEVENT\nUID:1\nDTSTART:20260102\nSUMMARY:a\nURL:https://e.example.com/1\nEND:VEVENT\n"
    feeds_ = _feeds(spark, tmp_path, text)
    plan = _optimized(feeds.ical_extracted(feeds.ical_events(feeds_, ["id"]), ["id"]))
    assert plan.count("= SUMMARY") == 1 and plan.count("= DTSTART)") == 1
    pages = spark.createDataFrame([(1, "https://p.example.com/1", ""), (2, "https://p.example.com/2", "")], "id long, url string, html string")
    rows = adapters.calendar_first(feeds_.withColumnRenamed("id", "feed_id"), ["feed_id"])(pages, ["id"])
    assert [tuple(r) for r in rows.select("id", "title", "event_url").collect()] == [(1, "a", "https://e.example.com/1")]
    assert _optimized(rows).count("BEGIN:VEVENT") == 1


def test_feed_items_are_read_once(spark, tmp_path):
    text = "<item><title>a</title><link>https://x.example.com/?EID=7</link></item><item><link>/</link></item>"
    rows = feeds.rss_items(_feeds(spark, tmp_path, text), ["id"])
    assert [r[0] for r in rows.select("eid").collect()] == ["7"]
    assert _optimized(rows).count("EID=(") == 1


def test_rows_without_a_group_join_by_their_id(spark):
    rows = spark.range(8).withColumn("canonical_id", F.when(F.col("id") == 0, F.lit(5).cast("bigint")))
    groups = spark.createDataFrame([(5, 0.5)], "canonical_id long, editorial_score double")
    joined = L.with_group(rows, groups.hint("merge"))
    assert sorted(map(tuple, joined.select("id", "editorial_score").collect()))[:2] == [(0, 0.5), (1, None)]
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(unit") == 2 and "hashpartitioning(canonical_id" not in plan
    t = Tables(spark, T)
    listed = L.listing(whole(t), t.canonicals().hint("merge"), NOW)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftOuter, (unit#" in listed


def test_blanks_are_those_of_the_pattern(spark):
    """Trimming by characters and by pattern agree on every character, whatever stands around it."""
    chars = spark.range(0x10000).filter("id not between 55296 and 57343 and id <> 133").select(
        F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    both = chars.select("c", F.concat("c", F.lit("a b"), "c").alias("t")).select(
        text.strip(F.col("t")).alias("s"), F.regexp_replace("t", f"^{text.WS}+|{text.WS}+$", "").alias("r"))
    assert both.filter("s <> r").count() == 0 and both.filter("s = 'a b'").count() == len(text.BLANKS) == 25
