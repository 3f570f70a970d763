"""Plans as rows against lists in Python."""

import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from marquee.operators import plan_rows as PR

BASE = datetime(2026, 5, 1, tzinfo=timezone.utc)
SCHEMA = "session_id int, at long, item_id string, start_at timestamp, all_day boolean"
EDIT = "session_id int, item_id string, start_at timestamp, all_day boolean"


def plans(seed, n=12):
    rnd = random.Random(seed)
    made = {}
    for s in range(n):
        items = []
        for k in range(rnd.randrange(0, 9)):
            place = rnd.random() < 0.3
            items.append((f"i{k}", None if place else BASE + timedelta(hours=rnd.randrange(9)), None if place else rnd.random() < 0.2))
        made[s] = items
    return made, {s: (f"i{rnd.randrange(12)}", BASE + timedelta(hours=rnd.randrange(9)), rnd.random() < 0.2) for s in made}


def rows_of(spark, made):
    return spark.createDataFrame([(s, k * PR.GAP, *i) for s, items in made.items() for k, i in enumerate(items)], SCHEMA)


def lists(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["session_id"], r["at"])):
        out.setdefault(r["session_id"], []).append(r["item_id"])
    return out


def by_time(items, new):
    rest = [i for i in items if i[0] != new[0]]
    at = len(rest) if new[2] else next((k for k, i in enumerate(rest) if i[2] is False and i[1] > new[1]), len(rest))
    return rest[:at] + [new] + rest[at:]


def test_edits_equal_list_edits(spark):
    made, edits = plans(1, 40)
    rows, new = rows_of(spark, made), spark.createDataFrame([(s, *e) for s, e in edits.items()], EDIT)
    names = lambda f: {s: [i[0] for i in f(items, edits[s])] for s, items in made.items() if f(items, edits[s])}
    without = lambda items, e: [i for i in items if i[0] != e[0]]
    held = lambda items, e: any(i[0] == e[0] for i in items)
    assert lists(PR.insert_by_time(rows, new)) == names(by_time)
    assert lists(PR.append_or_move(rows, new)) == names(lambda items, e: without(items, e) + [e])
    assert lists(PR.remove(rows, new)) == names(without)
    assert lists(PR.toggle_event(rows, new)) == names(lambda items, e: without(items, e) if held(items, e) else by_time(items, e))
    assert lists(PR.toggle_place(rows, new)) == names(lambda items, e: without(items, e) if held(items, e) else items + [e])
    pairs = spark.createDataFrame([(s, "i0", "i3") for s in made], "session_id int, a string, b string")
    swapped = lambda items, _: [items[{0: 3, 3: 0}.get(k, k)] for k in range(len(items))] if len(items) > 3 else items
    assert lists(PR.swap(rows, pairs)) == names(swapped)


def test_gaps_are_made_again(spark):
    made = {1: [("a", BASE, False), ("z", BASE + timedelta(hours=9), False)], 2: [("a", BASE, False)]}
    rows = rows_of(spark, made).withColumn("at", F.when(F.col("item_id") == "z", F.lit(1)).otherwise(F.col("at")))
    new = spark.createDataFrame([(1, "m", BASE + timedelta(hours=1), False), (2, "m", BASE + timedelta(hours=1), False)], EDIT)
    done = PR.insert_by_time(rows, new)
    assert lists(done) == {1: ["a", "m", "z"], 2: ["a", "m"]}
    ats = [r["at"] for r in done.filter("session_id = 1").orderBy("at").collect()]
    assert ats == [0, PR.GAP // 2, PR.GAP]


def test_a_long_plan_spreads_over_tasks(spark):
    rows = spark.range(200_000).select(
        F.when(F.col("id") % 4 == 3, F.col("id")).otherwise(7).cast("int").alias("session_id"), F.col("id").alias("pos"), F.col("id").cast("string").alias("item_id"),
        F.lit("event").alias("kind"), (F.lit(BASE) + F.make_dt_interval(mins=F.col("id").cast("int"))).alias("start_at"), F.lit(False).alias("all_day"))
    numbered = PR.ranked(rows, "pos").filter("session_id = 7")
    assert numbered.count() == 150_001 and numbered.agg(F.max("n"), F.min("n"), F.count_distinct("n")).first()[:] == (150_000, 0, 150_001)
    options = PR.swap_options(rows).filter("session_id = 7")
    assert options.filter("can_up").count() == 0 and options.filter("can_down").count() == 0
    plan = PR.keyed(rows).select("session_id", "at", "item_id", "start_at", "all_day")
    new = spark.createDataFrame([(7, "new", BASE + timedelta(minutes=100_000, seconds=30), False)], EDIT)
    after = PR.insert_by_time(plan, new).filter("session_id = 7")
    at = after.filter("item_id = 'new'").first()["at"]
    assert 100_000 * PR.GAP < at < 100_001 * PR.GAP
