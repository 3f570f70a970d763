"""Size-balanced shards by sampled splitters.

Records are ordered by a key (the hash of the text, then a hash of the id, then
the id), so equal texts lie next to each other while a hot text still spreads
over many key ranges. A size-weighted sample of keys gives the quantile
boundaries of many small ranges; ranges that turn out overfull are cut again
with samples of their own. Every range's rows and bytes are then counted over
all records, running sums over the ranges give each range its place in the
total, and a window inside a range gives each record its place. The law is
``bytes``: a record goes to the shard in whose span of bytes its middle lies.

A group of equal texts stays in one shard unless it is larger than
``KEEP_TOGETHER`` of a shard; it then moves as a whole to the shard of its
middle. Larger groups are cut like any other records.

Defined results: a null text has no bytes, checksum 0 and the size 16; an empty
table gives no rows; rows that are equal in every column get slots next to each
other; a null id is a key like any other (ordered first). Only id and text are
read, so further columns cannot clash.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from marquee.session import cut_lineage

OVERHEAD = 16  # bytes each record counts besides its text
SAMPLES_PER_RANGE = 12
RANGES_PER_SHARD = 16  # at least
ROWS_PER_RANGE = 1_000_000  # at most, on average
KEEP_TOGETHER = 1 / 64
MAX_ROUNDS = 4  # of cutting overfull ranges; a range of one key cannot be cut further


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, checksum and the two key parts of every record; no text is kept."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.xxhash64(F.col(text_col)).alias("k1"),
        F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(7)).alias("k2"),
    )


def _sampled(rows: DataFrame, step: float) -> DataFrame:
    """Keys drawn in proportion to size: one for about every ``step`` bytes.

    The draw is a hash of the key, so a lost task draws the same again.
    """
    u = F.pmod(F.xxhash64("k1", "k2", F.lit(99)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    step = F.lit(float(step))
    return rows.filter(u < F.col("size") / step).select("k1", "k2", F.greatest("size", step).alias("weight"))


def splitters(rows: DataFrame, ranges: int, total: float) -> list[tuple[int, int]]:
    """Boundaries of about ``ranges`` key ranges of equal size, from a sample whose
    expected length is ``ranges * SAMPLES_PER_RANGE`` and no more than that per byte read."""
    if not total:
        return []
    sample = _sampled(rows, total / (ranges * SAMPLES_PER_RANGE)).select("k1", "k2", "weight").toPandas()
    sample = sample.sort_values(["k1", "k2"])
    return _quantiles(sample, ranges)


def _quantiles(sample: pd.DataFrame, ranges: int) -> list[tuple[int, int]]:
    if not len(sample) or ranges < 2:
        return []
    at = np.cumsum(sample["weight"].to_numpy())
    want = at[-1] * np.arange(1, ranges) / ranges
    rows = sample.iloc[np.unique(np.searchsorted(at, want))]
    return sorted({(int(a), int(b)) for a, b in zip(rows["k1"], rows["k2"])})


def in_ranges(rows: DataFrame, bounds: list[tuple[int, int]]) -> DataFrame:
    """Adds ``range``, the number of boundaries that are not above the key."""
    first = np.array([a for a, _ in bounds], dtype=np.int64)
    fields = T.StructType([*rows.schema.fields, T.StructField("range", T.IntegerType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1 = batch["k1"].to_numpy()
            low, high = np.searchsorted(first, k1, "left"), np.searchsorted(first, k1, "right")
            tied = np.flatnonzero(high > low)
            if len(tied):  # a hot text: the second key part decides
                k2 = batch["k2"].to_numpy()
                low[tied] = [bisect.bisect_right(bounds, (int(k1[i]), int(k2[i]))) for i in tied]
            yield batch.append_column("range", pa.array(low.astype(np.int32)))

    return rows.mapInArrow(place, fields)


def assign(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every record.

    Held by the driver: the sample, the boundaries and one row of sums for each
    range, a few dozen numbers for every million records.
    """
    rows = cut_lineage(keyed(docs, id_col, text_col))
    count, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = shards * max(RANGES_PER_SHARD, -(-count // (shards * ROWS_PER_RANGE)))
    bounds = splitters(rows, ranges, total)
    limit = 2 * total / ranges
    for _ in range(MAX_ROUNDS):
        sums = _sums(in_ranges(rows, bounds))
        over = sums[(sums["bytes"] > limit) & (sums["first"] != sums["last"])]
        if not len(over):
            break
        # Every overfull range is sampled again, at a rate that suits the range.
        finer = in_ranges(rows, bounds).filter(F.col("range").isin([int(r) for r in over["range"]]))
        sample = _sampled(finer, limit / (4 * SAMPLES_PER_RANGE)).toPandas().sort_values(["k1", "k2"])
        known = set(bounds)
        at = np.array([bisect.bisect_right(bounds, (int(a), int(b))) for a, b in zip(sample["k1"], sample["k2"])], dtype=int)
        for r, size in zip(over["range"], over["bytes"]):
            known.update(_quantiles(sample[at == r], int(np.ceil(2 * size / limit))))
        if len(known) == len(bounds):
            break
        bounds = sorted(known)
    placed = cut_lineage(in_ranges(rows, bounds))
    return _positions(placed, _sums(placed), total, shards)


def _sums(placed: DataFrame) -> pd.DataFrame:
    key = F.struct("k1", "k2")
    sums = placed.groupBy("range").agg(
        F.sum("size").alias("bytes"), F.count("*").alias("rows"), F.min(key).alias("first"), F.max(key).alias("last"))
    return sums.toPandas().sort_values("range")


def _positions(placed: DataFrame, sums: pd.DataFrame, total: int, shards: int) -> DataFrame:
    spark = placed.sparkSession
    starts = spark.createDataFrame(
        [(int(r), int(b), int(n)) for r, b, n in zip(
            sums["range"], sums["bytes"].cumsum() - sums["bytes"], sums["rows"].cumsum() - sums["rows"])],
        "range int, bytes_before long, rows_before long")
    inside = Window.partitionBy("range").orderBy("k1", "k2", "doc_id")
    at = placed.join(F.broadcast(starts), "range").select(
        "doc_id", "size", "text_crc32", "k1", "k2",
        (F.col("rows_before") + F.row_number().over(inside) - 1).alias("row"),
        (F.col("bytes_before") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))).alias("end"))
    at = cut_lineage(at)
    target = total / shards if total else 1.0
    # Small groups of equal texts move as a whole: only those that lie across a boundary are looked up.
    shard_at = lambda c: F.least(F.floor(c / F.lit(target)), F.lit(shards - 1)).cast("int")
    groups = at.groupBy("k1").agg(F.min(F.col("end") - F.col("size")).alias("low"), F.max("end").alias("high")).filter(
        (F.col("high") - F.col("low") <= target * KEEP_TOGETHER) & (shard_at(F.col("low")) != shard_at(F.col("high") - 1)))
    groups = groups.select("k1", shard_at((F.col("low") + F.col("high")) / 2).alias("kept"))
    middle = F.col("end") - F.col("size") / 2
    # At most one group lies across each boundary, so this side has fewer rows than there are shards.
    sharded = at.join(F.broadcast(groups), "k1", "left").withColumn("shard", F.coalesce("kept", shard_at(middle)))
    first = sharded.groupBy("shard").agg(F.min("row").alias("first_row"))
    return sharded.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("first_row")).alias("slot"))


def write_shards(docs: DataFrame, placed: DataFrame, path: str, shards: int = 40) -> None:
    """Write the records into one folder per shard, each shard by several tasks, in slot order inside a file."""
    with_place = docs.join(placed.select("doc_id", "shard", "slot"), "doc_id")
    spread = F.pmod(F.floor(F.col("slot") / 65536), F.lit(64))
    with_place.repartition(shards * 4, "shard", spread).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
