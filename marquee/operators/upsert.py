"""Keyed upsert with a content-hash gate.

A batch is first reduced to one row per key and written, so that it is worked
out once and Spark knows its size. It then stands on the right of both joins
with the stored table: a small batch is broadcast by Spark's own size check and
the stored rows are not shuffled; a large batch falls back to shuffled joins.
Nothing is overwritten in place: the result is a new table for the caller to
write to a new path.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from marquee.functions.clock import overlaps
from marquee.session import cut_lineage


def last_per_key(batch: DataFrame, keys: list[str], arrival: str | None = None) -> DataFrame:
    """Last row per key of a batch, as one-by-one processing would leave it.

    Rows that arrived together (or all rows, without ``arrival``) are decided by
    their content. The limit on ``row_number`` is applied before the shuffle as
    well, so a hot key sends one row for each task.
    """
    came = [F.col(arrival).desc_nulls_last()] if arrival else []
    order = Window.partitionBy(*keys).orderBy(*came, F.xxhash64(*batch.columns))
    return batch.withColumn("_at", F.row_number().over(order)).filter("_at = 1").drop("_at")


def derived_id(keys: list[str], kind: T.DataType) -> Column:
    """The id of a new row, from its key: the same row gets the same id on every attempt."""
    if isinstance(kind, T.LongType):
        return F.xxhash64(*keys)
    if isinstance(kind, T.StringType):
        return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]), 256)
    raise ValueError(f"no id can be derived for the type {kind.simpleString()}; give the batch an id column")


def first_per_source(batch: DataFrame, limit: int, source: str = "source_id", order: str = "id") -> DataFrame:
    """At most ``limit`` rows per source in list order, for callers that want a report of that length."""
    at = F.row_number().over(Window.partitionBy(source).orderBy(order))
    return batch.withColumn("pos", at).filter(F.col("pos") <= limit)


def plan_upsert(
    stored: DataFrame,
    batch: DataFrame,
    keys: list[str],
    now: datetime,
    gate: Column | None = None,
    identity: tuple[str, ...] = ("id",),
    reject: str | None = None,
    arrival: str | None = None,
    whole: bool = False,
) -> DataFrame:
    """Stored and new rows with ``outcome`` and ``reason``.

    Equal hash: only ``last_seen_at`` moves (``skipped``, ``hash_match``). A row
    with ``reject`` set is ``normalize_failed``; one outside ``gate`` is
    ``out_of_window``; others are ``updated`` or ``inserted``. Key and
    ``identity`` columns of a stored row never change. Rows the batch does not
    name have a null outcome. Of several batch rows with one key the last by
    ``arrival`` counts. A new row without an ``id`` gets one derived from its key.

    ``whole`` says that about as many rows are stored as come: both sides are
    shuffled once, for one full join, and the batch is not written.
    """
    batch = last_per_key(batch, keys, arrival)
    payload = [c for c in stored.columns if c not in keys]
    fresh = [c for c in payload if c in batch.columns and c not in identity and c != "last_seen_at"]
    failed = F.col(reject).isNotNull() if reject else F.lit(False)
    inside = F.lit(True) if gate is None else F.coalesce(gate, F.lit(False))
    checked = batch.withColumn("_failed", failed).withColumn("_inside", inside)
    stored_row = F.lit(True) if not whole else F.coalesce("_old", F.lit(False))
    if whole:
        names = {c: f"_n_{c}" for c in batch.columns if c not in keys}
        joined = stored.withColumn("_old", F.lit(True)).join(
            checked.withColumnsRenamed(names).withColumn("_hit", F.lit(True)), keys, "full_outer")
    else:
        checked = cut_lineage(checked)
        hot = checked.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in fresh], "_failed", "_inside", F.lit(True).alias("_hit"))
        joined = stored.join(hot, keys, "left")
    same = stored_row & (F.col("content_hash") == F.col("_n_content_hash"))
    refused = F.when(F.col("_failed"), "normalize_failed").when(~F.col("_inside"), "out_of_window")
    joined = joined.withColumn("reason", F.when(F.col("_hit").isNull(), None).when(same, "hash_match").otherwise(refused))
    joined = joined.withColumn(
        "outcome", F.when(F.col("_hit").isNull(), None).when(F.col("reason").isNotNull(), "skipped")
        .when(stored_row, "updated").otherwise("inserted"))
    updated = F.coalesce(F.col("outcome") == "updated", F.lit(False))
    seen = updated | F.coalesce(F.col("reason") == "hash_match", F.lit(False))
    kept = {
        c: F.when(seen, F.lit(now)).otherwise(F.col(c)) if c == "last_seen_at"
        else F.when(updated, F.col(f"_n_{c}")).otherwise(F.col(c)) if c in fresh
        else F.col(c)
        for c in payload}

    def new(c: str, of: str) -> Column:
        """A column of a new row; those of the batch begin with ``of``."""
        if c == "last_seen_at":
            return F.lit(now)
        if c == "id":
            return _new_id(batch, stored, keys, of)
        return F.col(of + c) if c in batch.columns else F.lit(None).cast(stored.schema[c].dataType)

    if whole:
        return joined.select(
            *keys, *[F.when(stored_row, kept[c]).otherwise(new(c, "_n_")).alias(c) for c in payload],
            "outcome", "reason", (~stored_row).alias("is_new"))
    known_rows = joined.select(*keys, *[kept[c].alias(c) for c in payload], "outcome", "reason", F.lit(False).alias("is_new"))
    # Stored keys are cut down to those of the batch first: an anti join could only broadcast the stored side.
    known = stored.select(*keys).join(checked.select(*keys), keys, "left_semi")
    unknown = checked.join(known, keys, "left_anti")
    added = unknown.select(
        *keys, *[new(c, "").alias(c) for c in payload],
        F.when(refused.isNotNull(), "skipped").otherwise("inserted").alias("outcome"), refused.alias("reason"),
        F.lit(True).alias("is_new"))
    return known_rows.unionByName(added)


def _new_id(batch: DataFrame, stored: DataFrame, keys: list[str], of: str = "") -> Column:
    kind = stored.schema["id"].dataType
    if "id" not in batch.columns:
        return derived_id(keys, kind)
    if isinstance(kind, (T.LongType, T.StringType)):
        return F.coalesce(F.col(f"{of}id").cast(kind), derived_id(keys, kind))
    return F.col(f"{of}id")


def applied(plan: DataFrame) -> DataFrame:
    """The new table: stored rows and inserted ones; rejected new rows are left out."""
    rejected = F.col("is_new") & (F.col("outcome") == "skipped")
    return plan.filter(~F.coalesce(rejected, F.lit(False))).drop("outcome", "reason", "is_new")


def window_gate(low: datetime, high: datetime) -> Column:
    return overlaps(F.col("start_at"), F.col("end_at"), F.lit(low), F.lit(high))


def run_stats(plan: DataFrame, source: str = "source_id", paths: DataFrame | None = None) -> DataFrame:
    """Outcome counters per source, plus the total (null source).

    ``paths`` (source and the path each item took) adds ``structured_hits``.
    """
    touched = plan.filter(F.col("outcome").isNotNull())
    stats = touched.rollup(source).agg(
        F.count("*").alias("seen"),
        *[F.count_if(F.col("outcome") == o).alias(o) for o in ("inserted", "updated", "skipped")])
    if paths is None:
        return stats
    hits = paths.rollup(F.col(source).alias("_source")).agg(F.count_if(F.col("path") == "structured").alias("structured_hits"))
    return stats.join(hits, F.col(source).eqNullSafe(F.col("_source")), "left").drop("_source").fillna(0, ["structured_hits"])


def run_log(plan: DataFrame, started: datetime, finished: datetime, errors: DataFrame | None = None) -> DataFrame:
    """Run rows to append: counters, error text and source status."""
    stats = run_stats(plan).filter(F.col("source_id").isNotNull())
    if errors is not None:
        stats = stats.join(errors.select("source_id", "error"), "source_id", "left")
    else:
        stats = stats.withColumn("error", F.lit(None).cast("string"))
    status = F.when(F.col("error").isNull(), "ok").otherwise(F.concat(F.lit("error: "), "error"))
    return stats.withColumns({
        "started_at": F.lit(started), "finished_at": F.lit(finished), "status": status})


def source_status(sources: DataFrame, runs: DataFrame) -> DataFrame:
    """Sources with the time, status and error of their last run; those without a run keep what they have."""
    old = {c: F.col(c) if c in sources.columns else F.lit(None).cast(kind) for c, kind in (
        ("last_run_at", "timestamp"), ("last_status", "string"), ("last_error", "string"))}
    last = runs.groupBy("source_id").agg(F.max(F.struct("finished_at", "status", "error")).alias("_run"))
    ran = F.col("_run").isNotNull()
    return sources.withColumns(old).join(last, "source_id", "left").withColumns({
        "last_run_at": F.coalesce("_run.finished_at", "last_run_at"), "last_status": F.coalesce("_run.status", "last_status"),
        "last_error": F.when(ran, F.col("_run.error")).otherwise(F.col("last_error"))}).drop("_run")


def upsert_sources(stored: DataFrame, adapters: DataFrame) -> DataFrame:
    """Sources by slug: label and base URL refreshed, ids kept, new ones enabled.

    A new source's id is the first 60 bits of a digest of its slug.
    """
    new_id = F.conv(F.substring(F.md5("source_slug"), 1, 15), 16, 10).cast(stored.schema["source_id"].dataType)
    fresh = adapters.select("source_slug", F.col("source_label").alias("_label"), F.col("base_url").alias("_url"))
    both = stored.join(fresh, "source_slug", "full_outer")
    return both.select(
        "source_slug", F.coalesce("source_id", new_id).alias("source_id"), F.coalesce("_label", "source_label").alias("source_label"),
        F.coalesce("_url", "base_url").alias("base_url"), F.coalesce("enabled", F.lit(True)).alias("enabled"))


def touch(rows: DataFrame, source_id, now: datetime) -> DataFrame:
    """Move ``last_seen_at`` of one source."""
    return rows.withColumn("last_seen_at", F.when(
        F.col("source_id") == source_id, F.lit(now)).otherwise(F.col("last_seen_at")))


def write_table(df: DataFrame, path: str, by_day: str | None = None) -> None:
    """Write to a new path, split by UTC day of ``by_day`` when given.

    The rebalance hint lets adaptive execution split a hot day and join small ones.
    """
    if by_day is None:
        df.write.parquet(path)
        return
    day = df.withColumn("day", F.to_date(by_day))
    day.hint("rebalance", "day").write.partitionBy("day").parquet(path)
