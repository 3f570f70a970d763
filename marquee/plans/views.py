"""Listing, place, plan and log tables derived from the driver's star schema.

Each view exists twice: as a DataFrame (``Tables``) and as SQL text for the
checks (``SQL_VIEWS``). Nothing is written; both are plain projections and
joins over the given tables, so work grows with them.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

NOW = datetime(1998, 6, 5, 16, 0, 0, tzinfo=timezone.utc)
NOW_SQL = "TIMESTAMP '1998-06-05 16:00:00'"

# City keys, in the order used by the numeric mapping.
CITY_KEYS = [
    "tampa",
    "st_petersburg",
    "clearwater",
    "brandon",
    "bradenton",
    "safety_harbor",
    "dunedin",
    "other",
]

ROWS_PER_TASK = 50_000
FIRST_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def ts(value: datetime) -> Column:
    return F.lit(value)


def city_of(number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in CITY_KEYS]), (number % 8 + 1).cast("int"))


def hours(n: Column) -> Column:
    return F.make_interval(hours=n.cast("int"))


# Which base table each listing column needs beyond ``orders``.
_LISTING_NEEDS = {
    "title": {"part"},
    "description": {"part", "customer"},
    "categories": {"part", "customer"},
    "content_hash": {"part"},
    "venue_name": {"supplier"},
    "city": {"customer"},
}


class Tables:
    """The given tables and the views derived from them, for one directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir
        self._counts: dict[str, int] = {}

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def spread(self, name: str) -> DataFrame:
        """A base table on at least as many partitions as there are cores, and none of too many rows.

        A file too small to be split would otherwise keep one core busy with all
        the row work after it. The number grows with the rows: they are a few bytes
        on disk, and texts of thousands are built and read from each.
        """
        df = self.raw(name)
        wanted = max(self.spark.sparkContext.defaultParallelism, self.shares(name))
        return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df

    def shares(self, name: str) -> int:
        """Tasks that the rows of a base table are worth; shuffles start from as many.

        Spark joins small partitions after a shuffle and splits none that is grouped,
        so a fixed number of them would let each sort grow with the input.
        """
        wanted = -(-self.count(name) // ROWS_PER_TASK)
        first = int(self.spark.conf.get(FIRST_PARTITIONS, None) or self.spark.conf.get("spark.sql.shuffle.partitions"))
        if wanted > first:
            self.spark.conf.set(FIRST_PARTITIONS, str(wanted))
        return wanted

    def count(self, name: str) -> int:
        """Row count of a base table, read from the file footers once."""
        if name not in self._counts:
            self._counts[name] = self.raw(name).count()
        return self._counts[name]

    def sources(self) -> DataFrame:
        key = F.col("s_suppkey")
        return self.raw("supplier").select(
            key.alias("source_id"),
            F.concat(F.lit("src_"), key).alias("source_slug"),
            F.col("s_name").alias("source_label"),
            (F.col("s_acctbal") > 0).alias("enabled"),
            F.when(key < 15, key).otherwise(115).cast("int").alias("source_rank"),
        )

    def listings(self, *columns: str, start: tuple[datetime, datetime] | None = None) -> DataFrame:
        """One row per order. Only the joins behind ``columns`` are made.

        ``start`` keeps rows starting in the range. Start is at most 23 hours
        after the order date, so a bound on the stored column reaches the scan.
        """
        needs = set().union(*[_LISTING_NEEDS.get(c, set()) for c in columns]) if columns else {
            "part", "customer", "supplier"}
        df = self.raw("orders") if start is not None else self.spread("orders")
        if start is not None:
            self.shares("orders")
            low, high = (v.astimezone(timezone.utc).replace(tzinfo=None) for v in start)
            df = df.filter(F.col("o_orderdate").between(
                F.lit(low).cast("timestamp_ntz") - F.expr("INTERVAL 24 HOURS"),
                F.lit(high).cast("timestamp_ntz")))
        key = F.col("o_orderkey")
        df = df.withColumn("source_id", key % self.count("supplier"))
        if "customer" in needs:
            df = df.join(self.raw("customer").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey")
        if "part" in needs:
            df = df.withColumn("p_partkey", key % self.count("part")).join(self.raw("part"), "p_partkey")
        if "supplier" in needs:
            df = df.join(self.raw("supplier").withColumnRenamed("s_suppkey", "source_id"), "source_id")
        start_at = F.col("o_orderdate").cast("timestamp") + hours(key % 24)
        out = {
            "id": key,
            "source_event_id": F.concat(F.lit("evt-"), key),
            "source_id": F.col("source_id"),
            "canonical_id": F.when(key % 4 != 0, F.col("o_custkey")),
            "start_at": start_at,
            "end_at": F.when(key % 5 == 0, F.lit(None).cast("timestamp"))
            .when(key % 50 == 1, start_at + F.expr("INTERVAL 30 HOURS"))
            .otherwise(start_at + hours(key % 4 + 1)),
            "all_day": F.col("o_orderpriority") == "5-LOW",
            "is_free": key % 10 == 0,
            "price_min": F.when(key % 7 != 0, (F.floor(F.col("o_totalprice") / 100) / 100).cast("decimal(10,2)")),
            "price_max": F.when(key % 7 != 0, (F.floor(F.col("o_totalprice") / 100) / 50).cast("decimal(10,2)")),
            "image_url": F.when(key % 3 == 1, F.lit(None).cast("string"))
            .when(key % 11 == 0, F.lit(" "))
            .otherwise(F.concat(F.lit("https://img.example.com/"), key, F.lit(".jpg"))),
            "address": F.lit(None).cast("string"),
            "last_seen_at": F.col("o_orderdate").cast("timestamp"),
        }
        if "part" in needs:
            title = F.when(
                key % 3 == 0, F.concat("p_name", F.lit(" presented by "), "p_brand")
            ).otherwise(F.col("p_name"))
            out["title"] = title
            out["content_hash"] = F.sha2(
                F.concat(title, F.lit("|"), F.date_format("o_orderdate", "yyyy-MM-dd")), 256)
        if {"part", "customer"} <= needs:
            out["description"] = F.when(key % 6 != 0, F.concat("p_type", F.lit(" & "), "c_mktsegment"))
            out["categories"] = F.array(
                F.concat("p_type", F.lit("/x")), F.col("c_mktsegment"), F.lit("Arts & Theatre"))
        if "supplier" in needs:
            out["venue_name"] = F.col("s_name")
        if "customer" in needs:
            out["city"] = city_of(F.col("c_nationkey"))
        picked = list(columns) if columns else list(out)
        df = df.select(*[out[c].alias(c) for c in dict.fromkeys(picked + (["start_at"] if start else []))])
        if start is not None:
            df = df.filter(F.col("start_at").between(ts(start[0]), ts(start[1])))
        return df

    def canonicals(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.raw("customer").select(
            key.alias("canonical_id"),
            F.when(key % 3 == 0, F.col("c_name")).alias("deduped_title"),
            F.when(key % 4 == 0, F.concat("c_mktsegment", F.lit(" picks"))).alias("summary"),
            F.when(key % 2 == 0, F.array(F.lower("c_mktsegment")))
            .otherwise(F.array().cast("array<string>")).alias("tags"),
            F.when(key % 3 == 1, F.array(F.lit("cultural")))
            .otherwise(F.array().cast("array<string>")).alias("vibes"),
            F.when(F.col("c_acctbal") > 0, F.col("c_acctbal") / 10000).alias("editorial_score"),
            F.when(key % 13 != 0, ts(NOW) - hours(key % 96)).alias("editorial_updated_at"),
            F.when(key % 2 == 0, F.lit(None).cast("string")).when(key % 7 == 0, F.lit(""))
            .otherwise(F.lit("x")).alias("why_its_cool"),
            F.when(key % 5 == 1, "kids").when(key % 5 != 0, "all_ages").alias("audience"),
            F.when(key % 4 == 0, "indoor").when(key % 4 != 3, "outdoor").alias("indoor_outdoor"),
            F.when(key % 5 != 0, key * 4 + 1).alias("primary_event_id"),
        )

    def places(self) -> DataFrame:
        key = F.col("c_custkey")
        none = F.lit(None).cast("string")
        # Market segment to place category.
        category = F.create_map(*[F.lit(v) for v in (
            "BUILDING", "venue", "AUTOMOBILE", "shop", "MACHINERY", "attraction",
            "HOUSEHOLD", "cafe", "FURNITURE", "gallery")])
        return self.spread("customer").select(
            key.alias("id"),
            F.col("c_name").alias("name"),
            F.concat(F.lit("place-"), key).alias("slug"),
            F.when(key % 3 != 2, F.concat("c_mktsegment", F.lit(" spot"))).alias("description"),
            F.coalesce(F.element_at(category, F.col("c_mktsegment")), F.lit("other")).alias("category"),
            city_of(F.col("c_nationkey")).alias("city"),
            F.when(key % 5 != 0, F.concat(key.cast("string"), F.lit(" Bay St"))).alias("address"),
            (F.lit(26.5) + (key % 250) / 100).alias("lat"),
            (F.lit(-83.5) + (key % 199) / 100).alias("lng"),
            F.when(key % 4 == 0, none).when(key % 4 == 1, F.lit("https://img.example.com/logo.svg"))
            .otherwise(F.concat(F.lit("https://img.example.com/p/"), key, F.lit(".jpg"))).alias("image_url"),
            F.when(key % 6 != 0, F.concat(F.lit("https://place"), key, F.lit(".example.com/"))).alias("website_url"),
            F.when(key % 3 == 0, F.concat(F.lit("813"), F.lpad(key.cast("string"), 7, "0")))
            .when(key % 3 == 1, F.concat(F.lit("1813"), F.lpad(key.cast("string"), 7, "0")))
            .otherwise(F.lpad((key % 100000).cast("string"), 5, "0")).alias("phone_number"),
            F.when(key % 8 == 0, F.lit(None).cast("array<string>"))
            .when(key % 8 == 1, F.array(F.lit("Monday-Friday: 11:00 AM - 10:00 PM"), F.lit("Closed")))
            .otherwise(F.array(F.lit("Sat 10:00am-11:00pm"))).alias("hours"),
            F.when(key % 3 == 0, F.array(F.lit("waterfront")))
            .when(key % 3 == 1, F.array(F.lit("brunch"), F.lit("romantic")))
            .otherwise(F.array().cast("array<string>")).alias("vibes"),
            F.array(F.lower("c_mktsegment")).alias("tags"),
            ((key % 50) / 10).alias("web_rating"),
            (key % 400).cast("int").alias("web_review_count"),
            F.when(key % 4 == 0, F.concat("c_mktsegment", F.lit(" place"))).alias("summary"),
            F.when(key % 9 == 0, F.lit("x")).alias("why_its_cool"),
            F.when(F.col("c_acctbal") > 0, F.col("c_acctbal") / 10000).alias("editorial_score"),
            (ts(NOW) - F.make_interval(days=(key % 180).cast("int"))).alias("last_seen_at"),
        )

    def metrics(self) -> DataFrame:
        # Event type to user action ("error" stays invalid).
        actions = F.create_map(*[F.lit(v) for v in (
            "view", "view_event", "click", "open_ticket_link", "purchase", "add_to_plan",
            "signup", "save_event")])
        kind = F.col("event_type")
        return self.raw("events").select(
            F.col("event_id").alias("metric_id"),
            F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(F.col("user_id").cast("string"), 12, "0")).alias("session_id"),
            F.coalesce(F.try_element_at(actions, kind), kind).alias("action"),
            F.col("event_id").alias("event_id"),
            F.col("props").alias("payload"),
            F.col("ts").cast("timestamp").alias("created_at"),
        )

    def usage(self) -> DataFrame:
        key = F.col("event_id")
        # Feature names and model names (the last one has no rate).
        features = ["extract_event", "extract_place", "extract_listings", "editorial_event",
                    "editorial_place", "search_rerank"]
        models = ["gpt-4.1-mini", "gpt-4.1", "gpt-4o", "unlisted"]
        return self.raw("events").select(
            key.alias("usage_id"),
            F.element_at(F.array(*map(F.lit, features)), (key % 6 + 1).cast("int")).alias("feature"),
            F.element_at(F.array(*map(F.lit, models)), (key % 4 + 1).cast("int")).alias("model"),
            F.floor(F.col("value") * 100).alias("prompt_tokens"),
            F.when(key % 9 != 0, key % 500).alias("completion_tokens"),
            F.lit(None).cast("bigint").alias("total_tokens"),
            (key % 1000).alias("latency_ms"),
            (F.col("event_type") != "error").alias("success"),
            F.col("ts").cast("timestamp").alias("created_at"),
        )

    def plan_items(self) -> DataFrame:
        """Plans of sixty consecutive orders each; some items are places."""
        key = F.col("o_orderkey")
        return self.raw("orders").select(
            F.floor(key / 60).alias("session_id"),
            (key % 60).cast("int").alias("pos"),
            F.when(key % 7 == 3, F.concat(F.lit("p"), "o_custkey"))
            .otherwise(F.concat(F.lit("e"), key)).alias("item_id"),
        )

    def incoming(self) -> DataFrame:
        """A second batch: unchanged, retitled, moved and new rows."""
        base = self.listings().filter(F.col("id") % 2 == 0)
        third = F.col("id") % 6
        changed = (
            base.withColumn("title", F.when(third == 2, F.concat("title", F.lit(" updated"))).otherwise(F.col("title")))
            .withColumn("start_at", F.when(third == 4, F.col("start_at") + F.expr("INTERVAL 1 HOUR"))
                        .otherwise(F.col("start_at")))
            .withColumn("content_hash", F.when(third == 0, F.col("content_hash"))
                        .otherwise(F.sha2(F.concat("content_hash", F.lit("*")), 256)))
        )
        added = (
            self.listings().filter(F.col("id") % 100 == 0)
            .withColumn("id", F.col("id") + 1000000000)
            .withColumn("source_event_id", F.concat(F.lit("evt-"), "id"))
        )
        return changed.unionByName(added)


def ny(expr: str) -> str:
    """SQL: UTC timestamp to New York wall clock."""
    return f"(({expr}) AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York')"


def local_instant(expr: str) -> str:
    """SQL: New York wall clock to UTC; in the hour that the autumn change repeats the earlier instant."""
    u = f"(({expr}) AT TIME ZONE 'America/New_York' AT TIME ZONE 'UTC')"
    before = f"({u} - INTERVAL 1 HOUR)"
    return f"(CASE WHEN {ny(before)} = ({expr}) THEN {before} ELSE {u} END)"


_CITY_SQL = "[" + ", ".join(f"'{c}'" for c in CITY_KEYS) + "][CAST({} % 8 AS INTEGER) + 1]"

SQL_VIEWS: dict[str, str] = {
    "v_sources": """
SELECT s_suppkey AS source_id, 'src_' || s_suppkey AS source_slug, s_name AS source_label,
       s_acctbal > 0 AS enabled, CASE WHEN s_suppkey < 15 THEN s_suppkey ELSE 115 END AS source_rank
FROM supplier""",
    "v_listings": f"""
SELECT o_orderkey AS id, 'evt-' || o_orderkey AS source_event_id, s_suppkey AS source_id,
  CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey END AS canonical_id,
  CASE WHEN o_orderkey % 3 = 0 THEN p_name || ' presented by ' || p_brand ELSE p_name END AS title,
  CASE WHEN o_orderkey % 6 <> 0 THEN p_type || ' & ' || c_mktsegment END AS description,
  o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS start_at,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL
       WHEN o_orderkey % 50 = 1 THEN o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) + INTERVAL 30 HOUR
       ELSE o_orderdate + to_hours(CAST(o_orderkey % 24 + 1 + o_orderkey % 4 AS INTEGER)) END AS end_at,
  o_orderpriority = '5-LOW' AS all_day, s_name AS venue_name, CAST(NULL AS VARCHAR) AS address,
  {_CITY_SQL.format('c_nationkey')} AS city, o_orderkey % 10 = 0 AS is_free,
  CASE WHEN o_orderkey % 7 <> 0 THEN floor(o_totalprice / 100) / 100 END AS price_min,
  CASE WHEN o_orderkey % 7 <> 0 THEN floor(o_totalprice / 100) / 50 END AS price_max,
  [p_type || '/x', c_mktsegment, 'Arts & Theatre'] AS categories,
  CASE WHEN o_orderkey % 3 = 1 THEN NULL WHEN o_orderkey % 11 = 0 THEN ' '
       ELSE 'https://img.example.com/' || o_orderkey || '.jpg' END AS image_url,
  o_orderdate AS last_seen_at,
  sha256((CASE WHEN o_orderkey % 3 = 0 THEN p_name || ' presented by ' || p_brand ELSE p_name END)
         || '|' || strftime(o_orderdate, '%Y-%m-%d')) AS content_hash
FROM orders JOIN customer ON c_custkey = o_custkey
JOIN part ON p_partkey = o_orderkey % (SELECT count(*) FROM part)
JOIN supplier ON s_suppkey = o_orderkey % (SELECT count(*) FROM supplier)""",
    "v_canonical": f"""
SELECT c_custkey AS canonical_id, CASE WHEN c_custkey % 3 = 0 THEN c_name END AS deduped_title,
  CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment || ' picks' END AS summary,
  CASE WHEN c_custkey % 2 = 0 THEN [lower(c_mktsegment)] ELSE [] END AS tags,
  CASE WHEN c_custkey % 3 = 1 THEN ['cultural'] ELSE [] END AS vibes,
  CASE WHEN c_acctbal > 0 THEN c_acctbal / 10000 END AS editorial_score,
  CASE WHEN c_custkey % 13 <> 0 THEN {NOW_SQL} - to_hours(CAST(c_custkey % 96 AS INTEGER)) END AS editorial_updated_at,
  CASE WHEN c_custkey % 2 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN '' ELSE 'x' END AS why_its_cool,
  CASE WHEN c_custkey % 5 = 1 THEN 'kids' WHEN c_custkey % 5 <> 0 THEN 'all_ages' END AS audience,
  CASE WHEN c_custkey % 4 = 0 THEN 'indoor' WHEN c_custkey % 4 <> 3 THEN 'outdoor' END AS indoor_outdoor,
  CASE WHEN c_custkey % 5 <> 0 THEN c_custkey * 4 + 1 END AS primary_event_id
FROM customer""",
    "v_places": f"""
SELECT c_custkey AS id, c_name AS name, 'place-' || c_custkey AS slug,
  CASE WHEN c_custkey % 3 <> 2 THEN c_mktsegment || ' spot' END AS description,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'venue' WHEN 'AUTOMOBILE' THEN 'shop' WHEN 'MACHINERY' THEN 'attraction'
    WHEN 'HOUSEHOLD' THEN 'cafe' WHEN 'FURNITURE' THEN 'gallery' ELSE 'other' END AS category,
  {_CITY_SQL.format('c_nationkey')} AS city,
  CASE WHEN c_custkey % 5 <> 0 THEN c_custkey || ' Bay St' END AS address,
  CAST(26.5 AS DOUBLE) + (c_custkey % 250) / 100 AS lat, CAST(-83.5 AS DOUBLE) + (c_custkey % 199) / 100 AS lng,
  CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 4 = 1 THEN 'https://img.example.com/logo.svg'
    ELSE 'https://img.example.com/p/' || c_custkey || '.jpg' END AS image_url,
  CASE WHEN c_custkey % 6 <> 0 THEN 'https://place' || c_custkey || '.example.com/' END AS website_url,
  CASE WHEN c_custkey % 3 = 0 THEN '813' || lpad(CAST(c_custkey AS VARCHAR), 7, '0')
    WHEN c_custkey % 3 = 1 THEN '1813' || lpad(CAST(c_custkey AS VARCHAR), 7, '0')
    ELSE lpad(CAST(c_custkey % 100000 AS VARCHAR), 5, '0') END AS phone_number,
  CASE WHEN c_custkey % 8 = 0 THEN NULL
    WHEN c_custkey % 8 = 1 THEN ['Monday-Friday: 11:00 AM - 10:00 PM', 'Closed']
    ELSE ['Sat 10:00am-11:00pm'] END AS hours,
  CASE WHEN c_custkey % 3 = 0 THEN ['waterfront'] WHEN c_custkey % 3 = 1 THEN ['brunch', 'romantic'] ELSE [] END AS vibes,
  [lower(c_mktsegment)] AS tags, (c_custkey % 50) / 10 AS web_rating,
  CAST(c_custkey % 400 AS INTEGER) AS web_review_count,
  CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment || ' place' END AS summary,
  CASE WHEN c_custkey % 9 = 0 THEN 'x' END AS why_its_cool,
  CASE WHEN c_acctbal > 0 THEN c_acctbal / 10000 END AS editorial_score,
  {NOW_SQL} - to_days(CAST(c_custkey % 180 AS INTEGER)) AS last_seen_at
FROM customer""",
    "v_metrics": """
SELECT event_id AS metric_id, '00000000-0000-4000-8000-' || lpad(CAST(user_id AS VARCHAR), 12, '0') AS session_id,
  CASE event_type WHEN 'view' THEN 'view_event' WHEN 'click' THEN 'open_ticket_link' WHEN 'purchase' THEN 'add_to_plan'
    WHEN 'signup' THEN 'save_event' ELSE event_type END AS action,
  event_id, props AS payload, ts AS created_at
FROM events""",
    "v_usage": """
SELECT event_id AS usage_id,
  ['extract_event', 'extract_place', 'extract_listings', 'editorial_event', 'editorial_place', 'search_rerank'][CAST(event_id % 6 AS INTEGER) + 1] AS feature,
  ['gpt-4.1-mini', 'gpt-4.1', 'gpt-4o', 'unlisted'][CAST(event_id % 4 AS INTEGER) + 1] AS model,
  CAST(floor(value * 100) AS BIGINT) AS prompt_tokens,
  CASE WHEN event_id % 9 <> 0 THEN event_id % 500 END AS completion_tokens,
  CAST(NULL AS BIGINT) AS total_tokens, event_id % 1000 AS latency_ms,
  event_type <> 'error' AS success, ts AS created_at
FROM events""",
    "v_plan_items": """
SELECT o_orderkey // 60 AS session_id, CAST(o_orderkey % 60 AS INTEGER) AS pos,
  CASE WHEN o_orderkey % 7 = 3 THEN 'p' || o_custkey ELSE 'e' || o_orderkey END AS item_id
FROM orders""",
    "v_incoming": """
SELECT * REPLACE (
  CASE WHEN id % 6 = 2 THEN title || ' updated' ELSE title END AS title,
  CASE WHEN id % 6 = 4 THEN start_at + INTERVAL 1 HOUR ELSE start_at END AS start_at,
  CASE WHEN id % 6 = 0 THEN content_hash ELSE sha256(content_hash || '*') END AS content_hash)
FROM v_listings WHERE id % 2 = 0
UNION ALL BY NAME
SELECT * REPLACE (id + 1000000000 AS id, 'evt-' || (id + 1000000000) AS source_event_id)
FROM v_listings WHERE id % 100 = 0""",
}
