"""Continuous ingest and action counts on Structured Streaming.

Both reuse the batch operators, so a stream ends where the batch would.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import DateType, IntegerType, LongType, StringType, StructType, TimestampType

from marquee.operators.logs import accepted_metrics
from marquee.operators.upsert import applied, plan_upsert
from marquee.session import cut_lineage

HASHED_ALIKE = (LongType(), IntegerType(), StringType(), DateType(), TimestampType())  # where equal keys have equal hashes
MAP_BITS, MOST_BITS = 1 << 15, 1 << 28  # of one bitmap (Spark's bitmaps have as many), of all


def file_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    """A stream of Parquet files as they arrive."""
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    )


def _period(start: str, pattern: str) -> Column:
    return F.coalesce(F.date_format(start, pattern), F.lit("none"))


def _manifest(spark: SparkSession, root: str, version: int | None = None) -> list:
    """(period, version) of every live partition: of one version, or of the last one; bounded by the calendar."""
    found = spark.read.schema("period string, version long, of long").parquet(f"{root}/manifest")
    if version is None:
        version = found.agg(F.max("of")).first()[0]
    return found.filter(F.col("of") == version).select("period", "version").collect()


def _write_manifest(spark: SparkSession, root: str, version: int, live: dict[str, int]) -> None:
    rows = spark.createDataFrame(list(live.items()), "period string, version long")
    rows.coalesce(1).write.mode("overwrite").parquet(f"{root}/manifest/of={version}")


def _write_rows(df: DataFrame, root: str, version: int, start: str, pattern: str, as_they_lie: DataFrame | None = None) -> set[str]:
    """Write the partitions of a version; a second attempt replaces them. Returns their periods.

    Rows of ``as_they_lie`` come from files of one period each and are not shuffled.
    """
    seen = Observation()

    def placed(rows: DataFrame) -> DataFrame:
        return rows.withColumns({"period": _period(start, pattern), "version": F.lit(version)})

    rows = placed(df).hint("rebalance", "period")
    if as_they_lie is not None:
        rows = rows.unionByName(placed(as_they_lie))
    (rows.observe(seen, F.collect_set("period").alias("periods"))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("period", "version").parquet(f"{root}/rows"))
    return set(seen.get["periods"])


def _may_meet(batch: DataFrame, keys: list[str], rows: int, schema: StructType) -> Callable[[DataFrame], DataFrame]:
    """A function that adds ``_met`` to stored rows: false where no key of ``batch`` can be theirs.

    The batch's keys are marked by hash, two bits each, in bitmaps of sixteen to
    thirty-two bits a key, 32 MB at most, that every task gets. A few rows are
    met by chance; a join decides them.
    """
    if any(schema[k].dataType not in HASHED_ALIKE or schema[k].dataType != batch.schema[k].dataType for k in keys):
        return lambda stored: stored.withColumn("_met", F.lit(True))
    hashed = F.xxhash64(*keys)
    maps = max(1, min(1 << (16 * rows - 1).bit_length(), MOST_BITS) // MAP_BITS)
    bucket = hashed.bitwiseAND(F.lit(maps - 1))
    places = [F.shiftrightunsigned(hashed, by).bitwiseAND(F.lit(MAP_BITS - 1)) for by in (30, 49)]
    marks = cut_lineage(
        batch.select(bucket.alias("_bucket"), F.explode(F.array(*places)).alias("_place"))
        .groupBy("_bucket").agg(F.bitmap_construct_agg("_place").alias("_marks")))

    def met(stored: DataFrame) -> DataFrame:
        joined = stored.withColumn("_bucket", bucket).join(F.broadcast(marks), "_bucket", "left")
        found = F.col("_marks").isNotNull()
        for at in places:
            byte = F.conv(F.hex(F.substr(F.col("_marks"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
            found = found & (F.getbit(byte, at % 8) == 1)
        return joined.withColumn("_met", found).drop("_bucket", "_marks")

    return met


def _rows(spark: SparkSession, root: str, schema: StructType, live: list) -> DataFrame:
    """The rows of these partitions; files of others are not even listed."""
    if not live:
        return spark.createDataFrame([], schema)
    paths = [f"{root}/rows/period={p}/version={v}" for p, v in live]
    return spark.read.schema(schema).parquet(*paths)


def start_table(df: DataFrame, root: str, start: str = "start_at", pattern: str = "yyyy-MM-dd") -> None:
    """Write ``df`` as version 0 of a table under ``root``, split by the UTC day (or ``pattern``) of ``start``."""
    found = _write_rows(df, root, 0, start, pattern)
    _write_manifest(df.sparkSession, root, 0, {p: 0 for p in found})


def read_table(spark: SparkSession, root: str, schema: StructType, version: int | None = None) -> DataFrame:
    """The table as it is after the last batch, or after batch ``version``."""
    return _rows(spark, root, schema, _manifest(spark, root, version))


def upsert_batch(
    spark: SparkSession,
    batch: DataFrame,
    root: str,
    version: int,
    schema: StructType,
    keys: list[str],
    arrival: str,
    now: datetime,
    identity: tuple[str, ...] = ("id",),
    gate=None,
    start: str = "start_at",
    pattern: str = "yyyy-MM-dd",
) -> None:
    """Version ``version`` of the table, from the one before it.

    Only the periods that the batch touches are read whole and written: those of
    its rows, and those where its keys are stored now (found by the key columns
    alone). Stored rows that the batch cannot name are copied without a shuffle.
    The batch is written once and read from there. The manifest of the version names the partition that is live for each
    period. Nothing that an earlier version names is changed, so a batch that is
    run again reads the same input and replaces its own output.
    """
    live = {r["period"]: r["version"] for r in _manifest(spark, root, version - 1)}
    batch = cut_lineage(batch)
    to = {r[0]: r[1] for r in batch.groupBy(_period(start, pattern)).count().collect()}
    met = _may_meet(batch, keys, sum(to.values()), schema)
    named = met(_rows(spark, root, schema, list(live.items())).select(*dict.fromkeys([*keys, start]))).filter("_met")
    at = [r[0] for r in named.join(batch.select(*keys), keys, "left_semi").select(_period(start, pattern)).distinct().collect()]
    touched = [(p, live[p]) for p in {*at, *to} if p in live]
    stored = met(_rows(spark, root, schema, touched))
    plan = plan_upsert(stored.filter("_met").drop("_met"), batch, keys, now, gate, identity, arrival=arrival, whole=True)
    written = _write_rows(applied(plan), root, version, start, pattern, stored.filter("NOT _met").drop("_met"))
    kept = {p: v for p, v in live.items() if p not in dict(touched)}
    _write_manifest(spark, root, version, {**kept, **{p: version for p in written}})


def start_upserts(
    incoming: DataFrame,
    root: str,
    checkpoint: str,
    schema: StructType,
    keys: list[str],
    arrival: str,
    now: Callable[[], datetime],
    identity: tuple[str, ...] = ("id",),
    gate=None,
    start: str = "start_at",
    pattern: str = "yyyy-MM-dd",
) -> StreamingQuery:
    """Apply each micro-batch to the table under ``root`` (see ``start_table``): batch ``n`` makes version ``n + 1``."""
    def apply(batch: DataFrame, batch_id: int) -> None:
        upsert_batch(
            batch.sparkSession, batch, root, batch_id + 1, schema, keys, arrival, now(), identity, gate, start, pattern)

    return (
        incoming.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def action_windows(metrics: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Valid actions per time window; late rows beyond the watermark drop."""
    return (
        accepted_metrics(metrics).withWatermark("created_at", late)
        .groupBy(F.window("created_at", width), "action").agg(F.count("*").alias("n"))
        .select(F.col("window.start").alias("start"), "action", "n")
    )


def start_action_counts(metrics: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append closed windows to ``path``."""
    return (
        action_windows(metrics).writeStream.format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    )
