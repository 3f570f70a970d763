"""Ordered plans as rows: an order key with gaps in place of a list in one row.

A plan's item is a row (session_id, at, item_id, start_at, all_day); ``at`` grows
along the plan in steps of ``GAP``, so an item goes between two others without
touching them. Edits are updates of single rows, found by (plan, item) or by
partial aggregates over the plan; positions come from ranges of keys. No step
holds a plan in one row or one task, so one plan may hold any share of all items.

Edits come as rows too, at most one for each plan and call, with the item and its
start and all-day flag. An item that stands more than once in a plan is edited in
all its places, and inserted once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from marquee.functions.clock import local_day
from marquee.session import cut_lineage

GAP = 1 << 32
ROW = ["session_id", "at", "item_id", "start_at", "all_day"]


def keyed(rows: DataFrame, pos: str = "pos") -> DataFrame:
    """Plan rows with order keys, from their positions."""
    return rows.withColumn("at", F.col(pos).cast("long") * GAP).select(*ROW)


def ranked(rows: DataFrame, order: str = "at", name: str = "n") -> DataFrame:
    """``rows`` with ``name``: 0, 1, 2 along each plan.

    Rows are dealt by ranges of (plan, key); a window numbers a plan inside one
    range, and the ranges of a plan, as many as partitions at most, are added up.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut_lineage(rows.repartitionByRange(parts, "session_id", order).withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy("session_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("session_id", "_part").agg(F.count("*").alias("_size"))
    starts = sizes.select("session_id", "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("session_id", "_part").orderBy(order))
    return dealt.withColumn("_at", inside).join(starts, ["session_id", "_part"]).withColumn(
        name, F.col("_start") + F.col("_at") - 1).drop("_part", "_at", "_start")


def respread(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """New keys with whole gaps for the named plans."""
    named = plans.select("session_id").distinct()
    fresh = ranked(rows.join(named, "session_id", "left_semi")).withColumn("at", F.col("n") * GAP)
    return rows.join(named, "session_id", "left_anti").unionByName(fresh.select(*rows.columns))


def _held(rows: DataFrame, edits: DataFrame) -> DataFrame:
    return edits.join(rows.select("session_id", "item_id"), ["session_id", "item_id"], "left_semi")


def remove(rows: DataFrame, edits: DataFrame) -> DataFrame:
    return rows.join(edits.select("session_id", "item_id"), ["session_id", "item_id"], "left_anti").select(*ROW)


def append_or_move(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """Put each item last in its plan."""
    tops = rows.join(edits.select("session_id"), "session_id", "left_semi").groupBy("session_id").agg(F.max("at").alias("top"))
    last = edits.join(tops, "session_id", "left").withColumn("at", F.coalesce("top", F.lit(0)) + GAP)
    return remove(rows, edits).unionByName(last.select(*ROW))


def _between(kept: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits with ``at``, and ``tight`` where two keys have no whole number between them."""
    new = edits.select("session_id", F.col("start_at").alias("_start"), F.col("all_day").alias("_all_day"))
    mine = kept.join(new, "session_id")
    later = ~F.col("_all_day") & ~F.coalesce("all_day", F.lit(True)) & (F.col("start_at") > F.col("_start"))
    bounds = mine.groupBy("session_id").agg(F.min(F.when(later, F.col("at"))).alias("next"), F.max("at").alias("top"))
    under = kept.join(bounds.select("session_id", "next"), "session_id").filter(F.col("at") < F.col("next")).groupBy("session_id").agg(
        F.max("at").alias("prev"))
    at = (F.when(F.col("next").isNull(), F.coalesce("top", F.lit(0)) + GAP).when(F.col("prev").isNull(), F.col("next") - GAP)
          .otherwise(F.col("prev") + F.shiftright(F.col("next") - F.col("prev"), 1)))
    placed = edits.join(bounds, "session_id", "left").join(under, "session_id", "left")
    return placed.withColumn("at", at).withColumn("tight", F.coalesce(F.col("next") - F.col("prev") < 2, F.lit(False)))


def insert_by_time(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """Put each item before the first timed item of its plan that starts later; all-day ones go last."""
    kept = remove(rows, edits)
    placed = cut_lineage(_between(kept, edits))
    tight = placed.filter("tight")
    if not tight.isEmpty():
        kept = cut_lineage(respread(kept, tight))
        placed = _between(kept, edits)
    return kept.unionByName(placed.select(*ROW))


def toggle_event(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """Take each item out of its plan, or insert it by time."""
    held = cut_lineage(_held(rows, edits))
    return insert_by_time(remove(rows, held), edits.join(held.select("session_id"), "session_id", "left_anti"))


def toggle_place(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """Take each item out of its plan, or put it last."""
    held = cut_lineage(_held(rows, edits))
    return append_or_move(remove(rows, held), edits.join(held.select("session_id"), "session_id", "left_anti"))


def swap(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Exchange items ``a`` and ``b`` of each plan that has both."""
    item = F.struct("item_id", "start_at", "all_day")

    def of(name: str) -> DataFrame:
        wanted = pairs.select("session_id", F.col(name).alias("item_id"))
        return rows.join(wanted, ["session_id", "item_id"]).groupBy("session_id").agg(F.min_by(item, "at").alias(name))

    both = of("a").join(of("b"), "session_id")
    moves = both.select("session_id", F.inline(F.array(
        F.struct(F.col("a.item_id").alias("item_id"), F.col("b").alias("other")),
        F.struct(F.col("b.item_id").alias("item_id"), F.col("a").alias("other")))))
    joined = rows.join(moves, ["session_id", "item_id"], "left")
    return joined.select("session_id", "at", *[
        F.when(F.col("other").isNull(), F.col(c)).otherwise(F.col(f"other.{c}")).alias(c) for c in ("item_id", "start_at", "all_day")])


def _next_to(numbered: DataFrame, by: int, columns: dict[str, Column]) -> DataFrame:
    """(session_id, n, ...): for each place in a plan, ``columns`` of the row ``by`` places on."""
    return numbered.select("session_id", (F.col("n") - by).alias("n"), *[c.alias(name) for name, c in columns.items()])


def swap_options(rows: DataFrame) -> DataFrame:
    """Whether each item may move up or down past its neighbour.

    Places and all-day events move freely; timed events only towards their order.
    """
    timed = F.when((F.col("kind") == "event") & ~F.col("all_day"), F.col("start_at"))
    n = ranked(rows, "pos").withColumn("t", timed)
    up = _next_to(n, -1, {"up": F.col("t"), "has_up": F.lit(True)})
    down = _next_to(n, 1, {"down": F.col("t"), "has_down": F.lit(True)})
    out = n.join(up, ["session_id", "n"], "left").join(down, ["session_id", "n"], "left")
    may_up = F.coalesce("has_up", F.lit(False)) & F.coalesce(F.col("t") <= F.col("up"), F.lit(True))
    may_down = F.coalesce("has_down", F.lit(False)) & F.coalesce(F.col("t") >= F.col("down"), F.lit(True))
    return out.select("session_id", "pos", "item_id", may_up.alias("can_up"), may_down.alias("can_down"))


def day_headers(rows: DataFrame) -> DataFrame:
    """Events that open a new local day in list order; places are passed over."""
    events = ranked(rows.filter(F.col("kind") == "event").withColumn("day", local_day(F.col("start_at"))), "pos")
    before = _next_to(events, -1, {"before": F.col("day")})
    return events.join(before, ["session_id", "n"], "left").filter(
        F.col("before").isNull() | (F.col("before") != F.col("day"))).select("session_id", "pos", "item_id", "day")
