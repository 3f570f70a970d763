"""Resolution against brute force over all pairs of small random fixtures."""

import random
import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from marquee.operators import resolve as R
from marquee.session import CLEAN_SHUFFLES, cut_lineage

SCHEMA = ("id bigint, title string, city string, start_at timestamp, end_at timestamp, all_day boolean, "
          "venue_name string, address string, canonical_id bigint")
BASE = datetime(2026, 5, 1, tzinfo=timezone.utc)
WORDS = ["jazz", "night", "river", "fest", "art", "by", "a", "party", "live", "go"]


def random_rows(seed: int, n: int):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        start = BASE + timedelta(hours=rnd.choice([0, 1, 2, 5, 11, 13, 24, 40, 49, 60, 71, 90]), minutes=rnd.choice([0, 0, 30]))
        end = rnd.choice([None, start + timedelta(hours=2), start + timedelta(hours=25)])
        title = " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(1, 4)))
        rows.append((i, rnd.choice([title, title.upper() + "!", ""]) if rnd.random() < 0.1 else title,
                     rnd.choice(["tampa", "tampa", "other", "brandon"]), start, end, rnd.random() < 0.15,
                     rnd.choice(["Hall", "Big Hall", "Park", None]), rnd.choice([None, "1 Main St", "Main St"]),
                     rnd.choice([None, None, None, rnd.randint(1, 6)])))
    return rows


def all_pairs(df):
    rows = R.match_columns(df)
    a = rows.select(*[F.col(c).alias(f"a_{c}") for c in rows.columns])
    b = rows.select(*[F.col(c).alias(f"b_{c}") for c in rows.columns])
    x, y = R.Side("a_"), R.Side("b_")
    pairs = a.crossJoin(b).filter("a_id < b_id").filter(R.same_event(x, y) & (R.reaches(x, y) | R.reaches(y, x)))
    return [(r["a_id"], r["b_id"], r["a_title_key"] == r["b_title_key"]) for r in pairs.collect()]


def components(ids, edges):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        ra, rb = find(a), find(b)
        root[max(ra, rb)] = min(ra, rb)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("seed,n", [(1, 120), (2, 200), (3, 60)])
def test_groups_equal_brute_force(spark, seed, n):
    rows = random_rows(seed, n)
    df = spark.createDataFrame(rows, SCHEMA)
    pairs = all_pairs(df)
    similar = {(r["a"], r["b"]) for r in R.similar_pairs(R.keyed_rows(df)).collect()}
    assert similar == {(a, b) for a, b, equal in pairs if not equal}
    got = {r["id"]: r["group_id"] for r in R.duplicate_groups(df).collect()}
    assert got == components([r[0] for r in rows], [(a, b) for a, b, _ in pairs])

    firsts = {}
    for r in rows:
        if r[8] is not None:
            firsts.setdefault(r[8], []).append(r[0])
    held = [(min(m), i) for m in firsts.values() for i in m]
    sticky = {r["id"]: r["group_id"] for r in R.duplicate_groups(df, prior="canonical_id").collect()}
    assert sticky == components([r[0] for r in rows], [(a, b) for a, b, _ in pairs] + held)


def test_cells_of_one_half_day_hide_no_link(spark):
    """A short row and an all-day row 46 hours apart, each with one of the other kind in its own half day."""
    t = lambda d, h: datetime(2026, 5, d, h, tzinfo=timezone.utc)
    rows = [(i, "small plate", "brandon", s, None, day, "Hall", None, None) for i, (s, day) in enumerate([
        (t(6, 2), True), (t(6, 10), False), (t(8, 8), True), (t(8, 11), False)])]
    df = spark.createDataFrame(rows, SCHEMA)
    cells = R.title_cells(R.keyed_rows(df))
    edges = [(r["a"], r["b"]) for r in R.equal_title_edges(cells).collect()]
    assert components(range(4), edges) == {0: 0, 1: 0, 2: 0, 3: 0}
    assert {r["id"]: r["group_id"] for r in R.duplicate_groups(df).collect()} == {0: 0, 1: 0, 2: 0, 3: 0}


def test_runs_of_a_title_are_one_node(spark):
    """A daily title of two years is one node, and no links are left; a row without a city stays by itself."""
    days = spark.range(730).select(
        "id", F.lit("jazz").alias("title"), F.when(F.col("id") < 728, "tampa").alias("city"),
        (F.lit(BASE) + F.make_dt_interval(days=F.floor(F.col("id") / 2).cast("int"), hours=(F.col("id") % 2 * 12).cast("int"))).alias("start_at"),
        F.lit(None).cast("timestamp").alias("end_at"), F.lit(False).alias("all_day"), F.lit("Hall").alias("venue_name"),
        F.lit(None).cast("string").alias("address"))
    cells = R.merged_cells(R.title_cells(R.keyed_rows(days)))
    assert sorted(r[0] for r in cells.select("node").distinct().collect()) == [0, 728, 729]
    assert R.equal_title_edges(cells.filter("city is not null")).count() == 0


def test_similar_pairs_are_met_once(spark):
    """Pairs at a common venue and a common address, of a score that needs a place and of one that needs none: no list to make distinct."""
    t = lambda h: datetime(2026, 5, 1, h, tzinfo=timezone.utc)
    titles = ["one two three four five six", "one two three four five seven", "one two three four five", "one two three four five six nine"]
    rows = [(4 * k + n, title, city, t(10 + n % 2), None, k % 3 == 2, "Hall", "1 Main St", None)
            for k, city in enumerate(["tampa", "tampa", "tampa", "other"]) for n, title in enumerate(titles)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = R.similar_pairs(R.keyed_rows(df))
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = [(r["a"], r["b"]) for r in found.collect()]
    want = {(a, b) for a, b, equal in all_pairs(df) if not equal}
    assert len(got) == len(set(got)) and set(got) == want
    twice = R.similar_pairs(R.keyed_rows(df.unionByName(df)))
    assert sorted((r["a"], r["b"]) for r in twice.collect()) == sorted(want)


def test_shuffle_files_go_with_a_table(spark):
    rows = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n"))
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for f in blocks.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}
    before = files()
    table = cut_lineage(rows)
    end = time.time() + 20
    while files() - before and time.time() < end:  # they go in the background
        time.sleep(0.2)
    assert not files() - before and spark.conf.get(CLEAN_SHUFFLES) == "false"
    assert table.agg(F.sum("n")).first()[0] == 1000


def test_candidate_counts_equal_brute_force(spark):
    df = spark.createDataFrame(random_rows(7, 150), SCHEMA)
    rows = R.match_columns(df)
    a = rows.select(*[F.col(c).alias(f"a_{c}") for c in rows.columns])
    b = rows.select(*[F.col(c).alias(f"b_{c}") for c in rows.columns])
    hits = a.crossJoin(b).filter("a_id <> b_id").filter(R.reaches(R.Side("a_"), R.Side("b_")))
    want = {r["a_id"]: r["n"] for r in hits.groupBy("a_id").agg(F.count("*").alias("n")).collect()}
    got = {r["id"]: r["candidates"] for r in R.candidate_counts(df).collect()}
    assert {k: v for k, v in got.items() if v} == want


def test_one_hot_title(spark):
    """A third of all rows share one title and one moment: no pair explosion, one group."""
    hot = spark.range(30000).select(
        "id", F.when(F.col("id") % 3 == 0, "hot show").otherwise(F.concat(F.lit("show "), F.col("id").cast("string"))).alias("title"),
        F.lit("tampa").alias("city"), F.lit(BASE).alias("start_at"), F.lit(None).cast("timestamp").alias("end_at"),
        F.lit(False).alias("all_day"), F.lit("Hall").alias("venue_name"), F.lit(None).cast("string").alias("address"))
    groups = R.duplicate_groups(hot)
    assert groups.filter("group_id = 0").count() == 10000
    assert groups.count() == 30000


def test_hot_similar_titles(spark):
    """Three similar titles of 20,000 rows each at one moment: their cells are linked once."""
    title = F.element_at(F.array(F.lit("tampa river jazz fest"), F.lit("river jazz fest"), F.lit("the river jazz fest show")), (F.col("id") % 3 + 1).cast("int"))
    hot = spark.range(60000).select(
        "id", title.alias("title"), F.lit("tampa").alias("city"), F.lit(BASE).alias("start_at"), F.lit(None).cast("timestamp").alias("end_at"),
        F.lit(False).alias("all_day"), F.lit("Hall").alias("venue_name"), F.lit(None).cast("string").alias("address"))
    keyed = R.keyed_rows(hot)
    assert R.similar_edges(keyed, R.title_cells(keyed)).count() <= 3
    assert R.duplicate_groups(hot).filter("group_id = 0").count() == 60000


@pytest.mark.parametrize("other", ["the river jazz fest of tampa show", "summer river jazz fest of tampa"])
def test_hot_similar_titles_at_different_minutes(spark, other):
    """Two similar titles (one inside the other; five of seven words) of 20,000 rows each at other moments and places."""
    title = F.when(F.col("id") % 2 == 0, "river jazz fest of tampa winter" if "summer" in other else "river jazz fest of tampa").otherwise(other)
    hot = spark.range(40000).select(
        "id", title.alias("title"), F.lit("tampa").alias("city"),
        (F.lit(BASE) + F.make_dt_interval(mins=(F.col("id") * 7 % 40000).cast("int"))).alias("start_at"),
        F.lit(None).cast("timestamp").alias("end_at"), F.lit(False).alias("all_day"),
        F.when(F.col("id") % 4 < 2, "Hall").otherwise(F.concat(F.lit("Hall "), (F.col("id") % 7).cast("string"))).alias("venue_name"),
        F.lit(None).cast("string").alias("address"))
    keyed = R.keyed_rows(hot)
    cells = R.title_cells(keyed)
    edges = R.similar_edges(keyed, cells)
    assert 0 < edges.count() <= 3 * cells.count() < 1000
    got = {r["id"]: r["group_id"] for r in R.duplicate_groups(hot).collect()}
    some = hot.filter("id % 40 < 3")
    rows = [r[0] for r in some.select("id").collect()]
    want = components(rows, [(a, b) for a, b, _ in all_pairs(some)])
    assert {r["id"]: r["group_id"] for r in R.duplicate_groups(some).collect()} == want
    assert len(set(got.values())) == 1


def test_nested_places(spark):
    t = lambda h, m=0: datetime(2026, 5, 1, h, m, tzinfo=timezone.utc)
    names = ["a", "ab", "x ab y", "", None, "b", "hall", "the hall"]
    rows = [(2 * k + d, title, "tampa", t(10 + d, 30 * d), None, False, v, None, None)
            for k, v in enumerate(names) for d, title in ((0, f"one two three four six n{k}"), (1, f"one two three six n{k} five"))]
    rows += [(100 + k, "red blue green", "tampa", t(10), None, False, v, None, None) for k, v in enumerate(names)]
    rows += [(200 + k, "red blue green brown", "other", t(11, k), None, k % 2 == 1, None, v, None) for k, v in enumerate(names)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["id"]: r["group_id"] for r in R.duplicate_groups(df).collect()}
    assert got == components([r[0] for r in rows], [(a, b) for a, b, _ in all_pairs(df)])


def test_long_chain_settles(spark):
    edges = spark.range(500).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    out = R.connected_components(edges)
    assert out.count() == 501 and out.filter("root <> 0").count() == 0


def test_reference_cases(spark):
    t = lambda *a: datetime(2026, 5, *a, tzinfo=timezone.utc)
    rows = [
        (1, "Tampa Riverfest presented by Publix", "tampa", t(1, 19), None, False, "Curtis Hixon Park", "600 N Ashley Dr, Tampa, FL", None),
        (2, "Tampa Riverfest", "tampa", t(1, 20), None, False, "Curtis Hixon Park", "600 N Ashley Dr, Tampa, FL", None),
        (3, "Spring Fair", "brandon", t(1, 7), datetime(2026, 5, 3, 6, 59, 59, tzinfo=timezone.utc), True, None, None, None),
        (4, "Spring Fair", "brandon", t(2, 13), None, False, None, None, None),
        # A city row is found from the side of ``other`` only.
        (5, "Night Market", "clearwater", t(9, 13), None, False, None, None, None),
        (6, "Night Market", "other", t(9, 14), None, False, None, None, None),
    ]
    got = {r["id"]: r["group_id"] for r in R.duplicate_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 5}
