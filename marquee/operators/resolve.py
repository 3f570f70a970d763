"""Cross-source duplicate resolution.

Two listings are the same event when the rule in ``same_event`` holds and at
least one of them reaches the other as a candidate (``reaches``). Groups are
the connected components of that relation.

No step lists all pairs of a group. Copies with an equal title are folded into
cells (title, city, kind, half day) first; cells are linked to their nearest
neighbours in time only, which leaves the components unchanged. Different similar
titles are found by exact prefix and n-gram keys within one city and two days;
their cells are linked by bands of the rule, without listing pairs of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from marquee.dims import CITY_KEYS
from marquee.functions.clock import hours_between, is_long, local_day
from marquee.functions.text import (
    location_match, match_text, match_tokens, strip, title_similarity,
)
from marquee.operators.blocking import contained_pairs
from marquee.session import cut_lineage

SHORT_HOURS = 12
LONG_HOURS = 48
SLOT_SECONDS = SHORT_HOURS * 3600
BIN_SLOTS = LONG_HOURS // SHORT_HOURS
MIN_SIMILARITY = 0.67


@dataclass(frozen=True)
class Side:
    """Columns of one listing of a pair, found under ``prefix`` and ``suffix``."""

    prefix: str
    suffix: str = ""

    def __getattr__(self, name: str) -> Column:
        return F.col(f"{self.prefix}{name}{self.suffix}")


def match_columns(listings: DataFrame) -> DataFrame:
    """Add what the match rule needs, once per row and not once per pair."""
    return (
        listings.withColumn("title_key", match_text(F.col("title")))
        .withColumn("tokens", match_tokens(F.col("title_key")))
        .withColumn("venue_key", match_text(F.col("venue_name")))
        .withColumn("address_key", match_text(F.col("address")))
        .withColumn("long", is_long(F.col("start_at"), F.col("end_at"), F.col("all_day")))
        .withColumn("_first", local_day(F.col("start_at")))
        .withColumn("_last", local_day(F.coalesce("end_at", "start_at")))
        .withColumn("day_low", F.least("_first", "_last"))
        .withColumn("day_high", F.greatest("_first", "_last"))
        .drop("_first", "_last")
    )


def same_event(a: Side, b: Side) -> Column:
    """The pair match rule over two rows that carry ``match_columns``."""
    score = title_similarity(a.title_key, b.title_key, a.tokens, b.tokens)
    return (a.title_key != "") & (b.title_key != "") & _same_event(a, b, score, a.title_key == b.title_key)


def _same_event(a: Side, b: Side, score: Column, equal: Column) -> Column:
    """The rule for two nonempty titles of a known similarity."""
    apart = hours_between(a.start_at, b.start_at)
    by_day = a.long | b.long
    placed = location_match(a.venue_key, b.venue_key) | location_match(a.address_key, b.address_key)
    days_meet = F.greatest(a.day_low, b.day_low) <= F.least(a.day_high, b.day_high)
    by_day_rule = days_meet & (((score >= 0.67) & placed) | (score >= 0.82))
    timed_rule = (
        ((score >= 0.88) & (apart <= 6))
        | ((score >= 0.75) & (apart <= 3) & placed)
        | ((score >= 0.67) & (apart <= 2) & placed)
    )
    return (
        (apart <= F.when(by_day, LONG_HOURS).otherwise(SHORT_HOURS))
        & (equal | F.when(by_day, by_day_rule).otherwise(timed_rule))
    )


def reaches(seed: Side, other: Side) -> Column:
    """Seed finds the other row: city, then 12 hours, or 48 for long seeds and all-day rows."""
    apart = hours_between(seed.start_at, other.start_at)
    near = F.when(seed.long | other.all_day, LONG_HOURS).otherwise(SHORT_HOURS)
    return ((seed.city == "other") | (seed.city == other.city)) & (apart <= near)


# --- candidate counts ------------------------------------------------------


HOUR = 3_600_000_000
COUNT_DAYS = 8


def candidate_counts(listings: DataFrame) -> DataFrame:
    """Candidates each listing reaches, as (id, candidates).

    Counted from a histogram of start moments by prefix sums on two levels: over
    the hours of a few days (at most a few hundred rows of totals), and over the
    moments inside one hour. No window holds more than one hour of one city's
    moments, and the work is linear in the input, whatever the size of a city.
    """
    rows = listings.select(
        "id", "city", "all_day",
        is_long(F.col("start_at"), F.col("end_at"), F.col("all_day")).alias("long"),
        F.unix_micros("start_at").alias("at"),
    )
    near, far, span = SHORT_HOURS * HOUR, LONG_HOURS * HOUR, COUNT_DAYS * 24 * HOUR
    hour, bin = F.floor(F.col("at") / HOUR), F.floor(F.col("seed") / span)
    histogram = (
        rows.groupBy("city", "at").agg(F.count("*").alias("n"), F.count_if("all_day").alias("d"))
        .withColumn("scope", F.explode(F.array("city", F.lit("*"))))
        .groupBy("scope", "at").agg(F.sum("n").alias("n"), F.sum("d").alias("d")).withColumn("hour", hour))
    scope = F.when(F.col("city") == "other", F.lit("*")).otherwise(F.col("city"))
    seeds = rows.select(scope.alias("scope"), F.col("at").alias("seed")).distinct()
    # A low end counts what lies before it, a high end what lies up to it.
    marks = F.array(*[
        F.struct((F.col("seed") + offset).alias("at"), F.lit(tie).alias("tie"), F.lit(name).alias("mark"))
        for name, offset, tie in (
            ("far_low", -far, 0), ("near_low", -near, 0), ("near_high", near, 2), ("far_high", far, 2))
    ])
    probes = seeds.select("scope", "seed", F.inline(marks)).withColumn("hour", hour)
    none = {"n": F.lit(0), "d": F.lit(0)}
    key = ["scope", "hour", "at", "tie", "seed", "mark"]

    moments = Window.partitionBy("scope", "hour").orderBy("at", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    data = histogram.withColumns({"tie": F.lit(1), "seed": F.lit(None).cast("bigint"), "mark": F.lit(None).cast("string")})
    inside = (
        data.select(*key, "n", "d").unionByName(probes.withColumns(none).select(*key, "n", "d"))
        .select(*key, F.sum("n").over(moments).alias("n"), F.sum("d").over(moments).alias("d"))
        .filter(F.col("mark").isNotNull()).withColumn("bin", bin))

    hours = Window.partitionBy("scope", "bin").orderBy("hour", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = histogram.groupBy("scope", "hour").agg(F.sum("n").alias("n"), F.sum("d").alias("d")).withColumn(
        "bin", F.explode(F.array_distinct(F.array(
            F.floor((F.col("hour") * HOUR - far) / span), F.floor(((F.col("hour") + 1) * HOUR + far) / span)))))
    asked = probes.select("scope", bin.alias("bin"), "hour").distinct().withColumns(none)
    before = (  # of each hour asked for: what lies in earlier hours of its bin
        totals.withColumn("kind", F.lit(1)).unionByName(asked.withColumn("kind", F.lit(0)))
        .select("scope", "bin", "hour", "kind", F.sum("n").over(hours).alias("n0"), F.sum("d").over(hours).alias("d0"))
        .filter("kind = 0").drop("kind"))
    found = inside.join(before, ["scope", "bin", "hour"]).select(
        "scope", "seed", "mark", (F.col("n") + F.col("n0")).alias("n"), (F.col("d") + F.col("d0")).alias("d"))

    def at(mark: str, c: str) -> Column:
        return F.max(F.when(F.col("mark") == mark, F.col(c)))

    counts = found.groupBy("scope", "seed").agg(
        (at("near_high", "n") - at("near_low", "n")).alias("near_all"),
        (at("far_high", "n") - at("far_low", "n")).alias("far_all"),
        (at("far_high", "d") - at("far_low", "d") - at("near_high", "d") + at("near_low", "d")).alias("far_days"),
    )
    return (
        rows.withColumn("scope", scope).withColumn("seed", F.col("at"))
        .join(counts, ["scope", "seed"])
        .select("id", (F.when(F.col("long"), F.col("far_all"))
                       .otherwise(F.col("near_all") + F.col("far_days")) - 1).alias("candidates"))
    )


# --- cells of equal titles -------------------------------------------------

_KINDS = ["short", "multi", "allday"]


def with_cell_keys(listings: DataFrame) -> DataFrame:
    kind = F.when(F.col("all_day"), "allday").when(F.col("long"), "multi").otherwise("short")
    return (
        listings.withColumn("kind", kind)
        .withColumn("slot", F.floor(F.unix_seconds("start_at") / SLOT_SECONDS))
    )


def keyed_rows(listings: DataFrame, *more: str | None) -> DataFrame:
    """The columns resolution needs, and no others."""
    return with_cell_keys(match_columns(listings)).select(*_ROW, "kind", "slot", *filter(None, more))


CELL = ["title_key", "city", "kind", "slot"]


def title_cells(keyed: DataFrame) -> DataFrame:
    """One row per cell; its node is the smallest listing id in it.

    All listings of a cell match each other: same title and city, less than
    twelve hours apart. Partial aggregation folds hot titles before the shuffle.
    """
    return keyed.filter(F.col("title_key") != "").groupBy(*CELL).agg(
        F.min("id").alias("node"), F.min("start_at").alias("low"), F.max("start_at").alias("high"))


def merged_cells(cells: DataFrame) -> DataFrame:
    """``cells`` with one node for each run of cells of a title and city that link one after another.

    The node is the smallest of the run. Runs are chains of true links, so the groups
    stay as they are, and the graph that is left has no long chains of one title. For ids
    that do not repeat: an id of two rows would join their cells by its name.
    """
    order = Window.partitionBy("title_key", "city").orderBy("slot", "kind")
    last = {c: F.lag(c).over(order) for c in ("kind", "high", "node")}
    hours = F.when((F.col("kind") == "short") & (last["kind"] == "short"), SHORT_HOURS).otherwise(LONG_HOURS)
    near = F.unix_micros("low") - F.unix_micros(last["high"]) <= hours * HOUR
    named = F.col("city").isNotNull() & F.col("node").isNotNull() & last["node"].isNotNull()
    marked = cells.withColumn("_new", F.when(named & near, 0).otherwise(1))
    run = F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    one = Window.partitionBy("title_key", "city", "_run")
    return marked.withColumn("_run", run).withColumn("node", F.min("node").over(one)).drop("_new", "_run")


def _ids_repeat(rows: DataFrame) -> bool:
    """Whether two rows share an id, or have none."""
    return (rows.groupBy("id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0) > 1


def _blocks(df: DataFrame) -> DataFrame:
    """Each row in the block of its city; rows of ``other`` visit every block."""
    everywhere = F.array(*[F.lit(c) for c in CITY_KEYS])
    return df.withColumn(
        "block", F.explode(F.when(F.col("city") == "other", everywhere).otherwise(F.array("city")))
    ).withColumn("visitor", F.col("city") != F.col("block"))


def _limit(mine: tuple[bool, str], theirs: tuple[bool, str]) -> int | None:
    """Hours within which equal titles of two categories are duplicates."""
    (visit_a, kind_a), (visit_b, kind_b) = mine, theirs
    if visit_a and visit_b:
        return None  # linked in the block of ``other``
    if visit_a == visit_b:
        return SHORT_HOURS if kind_a == kind_b == "short" else LONG_HOURS
    seed, reached = (kind_a, kind_b) if visit_a else (kind_b, kind_a)
    return LONG_HOURS if seed != "short" or reached == "allday" else SHORT_HOURS


def equal_title_edges(cells: DataFrame) -> DataFrame:
    """Links (a, b) between cells of one title, nearest neighbours only.

    A window partition holds cells, so the calendar bounds its size and not the
    number of listings. Neighbours are looked for in other half days: those of one half
    day meet at the smallest of them, and would hide what only some of them reach.
    """
    categories = [(visit, kind) for visit in (False, True) for kind in _KINDS]
    cat = (F.when(F.col("kind") == "short", 0).when(F.col("kind") == "multi", 1).otherwise(2)
           + F.when(F.col("visitor"), 3).otherwise(0))
    placed = _blocks(cells).withColumn("cat", cat).withColumn("_back", -F.col("slot"))
    part = Window.partitionBy("title_key", "block")
    ahead = part.orderBy("slot").rangeBetween(Window.unboundedPreceding, -1)
    behind = part.orderBy("_back").rangeBetween(Window.unboundedPreceding, -1)
    residents = F.min(F.when(F.col("visitor"), F.lit(None)).otherwise(F.col("node")))
    here = F.struct("node", "low", "high")
    links = placed.withColumn("_here", residents.over(Window.partitionBy("title_key", "block", "slot")))
    found = [F.when(F.col("slot").isNotNull(), F.col("_here"))]
    for k, category in enumerate(categories):
        limit = None
        for m, mine in enumerate(categories):
            hours = _limit(mine, category)
            if hours is not None:
                limit = (F.when(F.col("cat") == m, hours) if limit is None
                         else limit.when(F.col("cat") == m, hours))
        match = F.when(F.col("cat") == k, here)
        for side, frame in (("p", ahead), ("n", behind)):
            name = f"{side}{k}"
            links = links.withColumn(name, F.last(match, ignorenulls=True).over(frame))
            gap = (F.unix_micros("low") - F.unix_micros(F.col(name)["high"])) if side == "p" else (
                F.unix_micros(F.col(name)["low"]) - F.unix_micros("high"))
            found.append(F.when(gap <= limit * 3_600_000_000, F.col(name)["node"]))
    return (
        links.select(F.col("node").alias("a"), F.explode(F.array(*found)).alias("b"))
        .filter(F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    )


# --- similar titles --------------------------------------------------------


def _grams(title_key: Column, n: int) -> Column:
    """Character n-grams inside the words of a normalized title."""

    def of_word(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(w) - (n - 1), F.lit(1)))
        return F.when(
            F.length(w) >= n, F.transform(starts, lambda i: F.substr(w, i, F.lit(n)))
        ).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.flatten(F.transform(F.split(title_key, " "), of_word)))


def _rarest(titles: DataFrame, items: Column) -> DataFrame:
    """Titles with ``ranked``: their items, rarest (over distinct titles) first."""
    exploded = titles.select("title_key", F.explode(items).alias("item"))
    counts = exploded.groupBy("item").agg(F.count("*").alias("n"))
    ranked = exploded.join(counts, "item").groupBy("title_key").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("n", "item"))), lambda s: s["item"]).alias("ranked"))
    return ranked


NEAR_SIMILARITY = 0.82  # the least that rows at different places need


def similar_titles(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Different titles that may match, each pair judged once, whatever the number of its rows, days and cities.

    First the titles that have a similar one, as title_key, tid, family, near_family:
    links of at least ``MIN_SIMILARITY`` stay inside a family, those of
    ``NEAR_SIMILARITY`` inside a near family. Second the pairs, as tid1, tid2,
    score with ``tid1 < tid2``. Exact: a Jaccard score of 0.67 needs a common token
    within both prefixes (tokens ordered by rarity), and a title inside another one
    needs its rarest n-gram there.
    """
    distinct = keyed.filter(F.size("tokens") > 0).select("title_key", "tokens").distinct()
    titles = cut_lineage(distinct.withColumn("tid", F.monotonically_increasing_id()))
    threes, twos = _grams(F.col("title_key"), 3), _grams(F.col("title_key"), 2)
    by_token = _rarest(titles, F.col("tokens")).withColumnRenamed("ranked", "by_token")
    by_gram = _rarest(titles, F.when(F.size(threes) > 0, threes).otherwise(twos)).select(
        "title_key", F.get("ranked", F.lit(0)).alias("rare"))
    # One row per distinct title, read by every side of the joins below.
    keys = cut_lineage(titles.join(by_token, "title_key").join(by_gram, "title_key"))

    size = F.size("by_token")
    prefix = keys.select(
        "tid", "title_key", size.alias("n"),
        F.explode(F.slice("by_token", F.lit(1), size - F.ceil(size * MIN_SIMILARITY).cast("int") + 1)).alias("key"))
    inner = keys.select("tid", "title_key", F.col("rare").alias("key"))
    # Of the n-grams of a containing title only those some title is looked up by.
    outer = titles.select("tid", "title_key", F.explode(F.concat(threes, twos)).alias("key")).join(
        inner.select("key").distinct(), "key", "left_semi")

    def meet(left: DataFrame, right: DataFrame, keep: Column) -> DataFrame:
        lhs = left.withColumnsRenamed({"tid": "tid1", "title_key": "t1"})
        rhs = right.withColumnsRenamed({"tid": "tid2", "title_key": "t2", "n": "m"})
        return lhs.join(rhs, "key").filter(keep).select("tid1", "t1", "tid2", "t2")

    tid1, tid2 = F.col("tid1"), F.col("tid2")
    jaccard = meet(prefix, prefix, (tid1 < tid2) & (F.least("n", "m") >= F.greatest("n", "m") * MIN_SIMILARITY))
    nested = meet(inner, outer, (tid1 != tid2) & F.contains("t2", "t1"))
    flip = tid1 > tid2
    ordered = nested.select(*[
        F.when(flip, F.col(f"{c}{m}")).otherwise(F.col(f"{c}{n}")).alias(f"{c}{n}") for n, m in ((1, 2), (2, 1)) for c in ("tid", "t")])
    score = title_similarity(F.col("t1"), F.col("t2"), match_tokens(F.col("t1")), match_tokens(F.col("t2")))
    pairs = cut_lineage(
        jaccard.unionByName(ordered).distinct().select("tid1", "tid2", score.alias("score")).filter(F.col("score") >= MIN_SIMILARITY))

    def families(some: DataFrame, name: str) -> DataFrame:
        roots = connected_components(some.select(tid1.alias("a"), tid2.alias("b")))
        return roots.select(F.col("node").alias("tid"), F.col("root").alias(name))

    near = families(pairs.filter(F.col("score") >= NEAR_SIMILARITY), "near_family")
    named = titles.select("tid", "title_key").join(families(pairs, "family"), "tid").join(near, "tid", "left")
    return cut_lineage(named), pairs


_ROW = ["id", "title_key", "tokens", "venue_key", "address_key", "long", "all_day",
        "start_at", "day_low", "day_high", "city"]


def _places(rows: DataFrame) -> DataFrame:
    """``rows`` once for each of its places, a venue or an address by its first character."""
    names = F.filter(F.array(F.concat(F.lit("v"), "venue_key"), F.concat(F.lit("a"), "address_key")), lambda x: F.length(x) > 1)
    return rows.withColumn("place", F.explode(names))


def _met(first: DataFrame, second: DataFrame, family: str, places: DataFrame | None, steps: tuple[int, ...] = (-1, 0, 1)) -> DataFrame:
    """Rows of two titles of one family and block with ``near_bin`` of the second ``steps`` from the first and, given ``places``, at equal or nested places."""
    def side(rows: DataFrame, n: str) -> DataFrame:
        shared = {"block", family}
        return rows.filter(F.col(family).isNotNull()).select(*[F.col(c).alias(c if c in shared else f"{c}{n}") for c in rows.columns])

    left = side(first, "1")
    left = left.withColumn("near_bin2", F.explode(F.array(*[F.col("near_bin1") + d for d in steps])))
    keys = [family, "block", "near_bin2"]
    if places is not None:
        left = left.withColumn("place2", F.col("place1")).unionByName(left.join(places, ["block", "place1"]))
        keys.append("place2")
    # Rows of ``other`` meet each other in their own block.
    return left.join(side(second, "2"), keys).filter("tid1 <> tid2 and not (visitor1 and visitor2)")


# Two sides of the same rows: the first is the earlier bin or, in one bin, the smaller title.
_ONCE = {"steps": (0, 1)}
_EARLIER = "near_bin1 < near_bin2 or tid1 < tid2"


def _scored(met: DataFrame, pairs: DataFrame) -> DataFrame:
    """``met`` with the similarity of the titles; others than ``pairs`` go."""
    both = pairs.unionByName(pairs.select(F.col("tid2").alias("tid1"), F.col("tid1").alias("tid2"), "score"))
    return met.join(both, ["tid1", "tid2"])


def similar_pairs(keyed: DataFrame) -> DataFrame:
    """Matching pairs of listings whose titles differ, as (a, b) with ``a < b``.

    This lists every pair, as a report; groups are formed from ``similar_edges``.
    Each pair is met once, so the list is not shuffled: by score and length it has
    one band, its times one side, and of two common places the venue counts. Only
    where ids repeat is the list made distinct.
    """
    named, pairs = similar_titles(keyed)
    lean = keyed.drop("tokens").join(named, "title_key")
    rows = cut_lineage(_blocks(lean).select(
        "id", "tid", "family", "near_family", "block", "visitor", "kind", "day_low", "day_high",
        F.unix_micros("start_at").alias("at"), "venue_key", "address_key"))
    placed = _places(rows)
    places = cut_lineage(_place_pairs(placed.select("block", "place").distinct()))
    score, apart = F.col("score"), F.abs(F.col("at1") - F.col("at2")) / HOUR

    def met(some: DataFrame, by_place: bool, hours: int, *more: str, days: bool = False) -> DataFrame:
        family = "family" if by_place else "near_family"
        own = [F.when(F.startswith("place", F.lit("a")), F.col("venue_key")).alias("venue_key"), "place"] if by_place else []
        some = some.select(family, "id", "tid", "block", "visitor", "at", *more, *own).withColumn("near_bin", F.floor(F.col("at") / (hours * HOUR)))
        nested = places if by_place else None
        both = _met(some.filter("kind <> 'short'"), some, family, nested) if days else _met(some, some, family, nested, **_ONCE).filter(_EARLIER)
        if by_place:
            both = both.filter(F.startswith("place1", F.lit("v")) | ~location_match(F.col("venue_key1"), F.col("venue_key2")))
        return both

    def timed(by_place: bool, hours: int) -> DataFrame:
        return _scored(met((placed if by_place else rows).filter("kind = 'short'"), by_place, hours).filter(apart <= hours), pairs)

    def by_day(by_place: bool) -> DataFrame:
        # The first row is a long one; two long ones meet once.
        found = met(placed if by_place else rows, by_place, LONG_HOURS, "kind", "day_low", "day_high", days=True)
        days_meet = F.greatest("day_low1", "day_low2") <= F.least("day_high1", "day_high2")
        limit = _categories_limit(F.col("visitor1"), F.col("kind1"), F.col("visitor2"), F.col("kind2"))
        return _scored(found.filter(((F.col("kind2") == "short") | (F.col("tid1") < F.col("tid2"))) & days_meet & (apart <= limit)), pairs)

    found = [
        timed(False, 6).filter(score >= 0.88), by_day(False).filter(score >= NEAR_SIMILARITY),
        timed(True, 3).filter((score < 0.88) & ((score >= 0.75) | (apart <= 2))), by_day(True).filter(score < NEAR_SIMILARITY)]
    out = [x.select(F.least("id1", "id2").alias("a"), F.greatest("id1", "id2").alias("b")) for x in found]
    out = out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])
    return out.distinct() if _ids_repeat(keyed) else out


# --- links between cells of similar titles ----------------------------------


def _place_pairs(places: DataFrame) -> DataFrame:
    """(block, place1, place2): different places of a block of which one lies inside the other.

    Places carry a prefix of one character that tells venues from addresses. Each
    is looked up by its rarest n-gram (three characters, or all of a shorter one),
    once and not for each of its blocks.
    """
    places = cut_lineage(places)
    text = cut_lineage(places.select("place").distinct().select(
        F.substring("place", 1, 1).alias("side"), F.expr("substring(place, 2)").alias("text")))
    size = F.length("text")
    found = contained_pairs(text.filter(size >= 3), text, "side", "text", 3)
    short = text.filter(size < 3)
    if not short.isEmpty():
        for n in (2, 1):
            found = found.unionByName(contained_pairs(short.filter(size == n), text, "side", "text", n))
    inside = found.filter("inner_text <> outer_text").select(
        F.concat("side", "inner_text").alias("place1"), F.concat("side", "outer_text").alias("place2"))
    inside = inside.join(places.withColumnRenamed("place", "place1"), "place1").join(
        places.withColumnRenamed("place", "place2"), ["block", "place2"]).select("block", "place1", "place2")
    return inside.unionByName(inside.select("block", F.col("place2").alias("place1"), F.col("place1").alias("place2")))


def _categories_limit(v1: Column, k1: Column, v2: Column, k2: Column) -> Column:
    """Hours within which rows of two categories (visitor, kind) reach each other, as a column."""
    limit = F.lit(None).cast("int")
    for visit_a in (False, True):
        for kind_a in _KINDS:
            for visit_b in (False, True):
                for kind_b in _KINDS:
                    hours = _limit((visit_a, kind_a), (visit_b, kind_b))
                    if hours is not None:
                        limit = F.when(
                            (v1 == visit_a) & (k1 == kind_a) & (v2 == visit_b) & (k2 == kind_b), hours).otherwise(limit)
    return limit


def similar_edges(keyed: DataFrame, cells: DataFrame) -> DataFrame:
    """Links (a, b) between the cells of similar titles that hold some matching pair of rows.

    All rows of a cell are one group, so one link for two cells is enough. Each
    band of the rule (a similarity, hours apart, with or without a common place)
    folds the rows to the first and last moment of every bin of some hours (long
    rows: of every cell and day range). Two bins hold a pair within given hours
    exactly if they are the same and no wider, or if the last moment of one and
    the first of the other are. So the rows of a title count no more than its
    bins and places, whatever their number. Titles meet within their family only,
    and at one place where the rule asks for one.
    """
    named, pairs = similar_titles(keyed)
    noded = keyed if "node" in keyed.columns else keyed.join(cells.select(*CELL, "node"), CELL)
    rows = _blocks(noded.join(named, "title_key"))
    rows = cut_lineage(rows.select(
        "tid", "family", "near_family", "block", "visitor", "kind", "slot", "day_low", "day_high", "node",
        F.unix_micros("start_at").alias("at"), "venue_key", "address_key"))
    placed = _places(rows)
    places = cut_lineage(_place_pairs(placed.select("block", "place").distinct()))

    def met(some: DataFrame, by_place: bool, near_bin: Column, *more: str, **steps: tuple[int, ...]) -> DataFrame:
        family = "family" if by_place else "near_family"
        keys = [family, "tid", "block", "visitor", "node", "bin", *more, *(["place"] if by_place else [])]
        folded = some.filter(F.col(family).isNotNull()).groupBy(*keys).agg(
            F.min("at").alias("low"), F.max("at").alias("high")).withColumn("near_bin", near_bin)
        first = folded.filter("kind <> 'short'") if "kind" in more else folded
        both = _met(first, folded, family, places if by_place else None, **steps)
        # All moments of one bin lie before all of another.
        nearest = F.greatest(F.col("low2") - F.col("high1"), F.col("low1") - F.col("high2"))
        return both.withColumn("gap", F.when(F.col("bin1") == F.col("bin2"), 0).otherwise(nearest) / HOUR)

    def timed(by_place: bool, hours: int, reach: int) -> DataFrame:
        some = (placed if by_place else rows).filter("kind = 'short'").withColumn("bin", F.floor(F.col("at") / (hours * HOUR)))
        found = met(some, by_place, F.floor(F.col("bin") / reach), **_ONCE)
        return found.filter(_EARLIER).filter(F.col("gap") <= hours * reach)

    def by_day(by_place: bool) -> DataFrame:
        some = (placed if by_place else rows).withColumn("bin", F.col("slot"))
        # The first row is a long one; two long ones meet once.
        found = met(some, by_place, F.floor(F.col("bin") / BIN_SLOTS), "kind", "day_low", "day_high")
        days_meet = F.greatest("day_low1", "day_low2") <= F.least("day_high1", "day_high2")
        limit = _categories_limit(F.col("visitor1"), F.col("kind1"), F.col("visitor2"), F.col("kind2"))
        return found.filter(((F.col("kind2") == "short") | (F.col("tid1") < F.col("tid2"))) & days_meet & (F.col("gap") <= limit))

    score, gap = F.col("score"), F.col("gap")
    found = [
        _scored(timed(False, 6, 1), pairs).filter(score >= 0.88),
        _scored(timed(True, 1, 3), pairs).filter(((score >= 0.75) & (gap <= 3)) | ((score >= 0.67) & (gap <= 2))),
        _scored(by_day(False), pairs).filter(score >= NEAR_SIMILARITY), _scored(by_day(True), pairs).filter(score >= 0.67)]
    links = found[0].select("node1", "node2")
    for more in found[1:]:
        links = links.unionByName(more.select("node1", "node2"))
    return links.filter("node1 <> node2").select(
        F.least("node1", "node2").alias("a"), F.greatest("node1", "node2").alias("b")).distinct()


# --- groups ----------------------------------------------------------------


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); the root is the smallest id.

    Alternating large-star and small-star rounds: each halves the depth of long
    chains, and a hot node only ever meets its own minimum in a join. The rounds
    end when one changes nothing; labels only ever get smaller.
    """

    def distinct_links(df: DataFrame) -> DataFrame:
        return df.filter(F.col("u") != F.col("v")).distinct()

    def signature(df: DataFrame):
        return df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()

    links = cut_lineage(distinct_links(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))))
    before = signature(links)
    while before[0]:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = distinct_links(
            both.join(low, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.inline(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")))))
        links = cut_lineage(distinct_links(small))
        after = signature(links)
        if after == before:
            break
        before = after
    roots = links.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def duplicate_groups(listings: DataFrame, prior: str | None = None) -> DataFrame:
    """(id, group_id) for every listing; the group id is its smallest member.

    ``prior`` names a column with an earlier assignment. Its members stay
    together, so groups only ever merge, and ``kept_id`` is the smallest earlier
    id of the group (null for a new one).
    """
    keyed = cut_lineage(keyed_rows(listings, prior))  # read by every branch below
    cells = title_cells(keyed)
    cells = cut_lineage(cells if _ids_repeat(keyed) else merged_cells(cells))
    noded = cut_lineage(keyed.join(cells.select(*CELL, "node"), CELL, "left"))
    nodes = noded.select("id", F.coalesce("node", "id").alias("node"), *([prior] if prior else []))
    edges = equal_title_edges(cells).unionByName(similar_edges(noded.filter("node is not null"), cells))
    if prior:
        members = nodes.filter(F.col(prior).isNotNull()).select(prior, "node").distinct()
        first = members.groupBy(prior).agg(F.min("node").alias("b"))
        edges = edges.unionByName(members.join(first, prior).select(F.col("node").alias("a"), "b"))
    roots = connected_components(edges)
    grouped = nodes.join(roots, "node", "left").withColumn("group_id", F.coalesce("root", "node"))
    if not prior:
        return grouped.select("id", "group_id")
    kept = grouped.groupBy("group_id").agg(F.min(prior).alias("kept_id"))
    return grouped.select("id", "group_id").join(kept, "group_id").select("id", "group_id", "kept_id")


def has_image(c: Column) -> Column:
    return F.coalesce(strip(c) != "", F.lit(False))


def elect_primary(members: DataFrame, group: str = "canonical_id") -> DataFrame:
    """(group, primary_id): with image first, then source rank, start, id.

    A minimum over a struct: partially aggregated, so a hot group costs no more
    than any other.
    """
    order = F.struct(
        (~has_image(F.col("image_url"))).alias("bare"), F.col("source_rank"), F.col("start_at"), F.col("id"))
    return members.groupBy(group).agg(F.min(order)["id"].alias("primary_id"))


def elect_refresh_primary(members: DataFrame, stored: str = "primary_event_id",
                          group: str = "canonical_id") -> DataFrame:
    """Primary for a refresh run: the stored one while present, else image, start, slug."""
    order = F.struct(
        F.when(F.col("id") == F.col(stored), 0).otherwise(1).alias("other"),
        (~has_image(F.col("image_url"))).alias("bare"), F.col("start_at"), F.col("source_slug"), F.col("id"))
    return members.groupBy(group).agg(F.min(order)["id"].alias("primary_id"))
