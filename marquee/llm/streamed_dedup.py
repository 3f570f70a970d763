"""Exact duplicates by a stateful stream.

Files of documents are read as a stream. Its state, kept on disk by RocksDB and
in the checkpoint, and never expired, holds for each digest of a normalised text
(SHA-256 of the text with A-Z lowered) the stable identifier of the row that
stays, that row's content locator (file and row number) and the number of rows
seen. Rows of one digest are first combined in each task, so copies of one text
are a row a task in the shuffle and one row in the state; texts never enter the
state. A stream that goes on from its checkpoint reads only files that are new.

Equal digests are a hit, not a verdict. For every hit the full bytes are checked:
the text of the row that the locator names is set against each other text with
that digest (one shuffle of texts by digest, whose hot digests adaptive execution
splits). Digests that hold different texts are grouped again by their bytes.

Of equal texts the row with the largest id stays; of rows that share that id, the
one with the largest locator. A null text is empty, and empty texts are copies of
each other; a null id is smaller than all others; an empty table gives an empty
result; columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from marquee.session import cut_lineage, shared_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FILES = 1000  # of a micro-batch
STORE = "spark.sql.streaming.stateStore."
STORE_CONF = {
    STORE + "providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    STORE + "rocksdb.changelogCheckpointing.enabled": "true",
    STORE + "rocksdb.allowFAllocate": "false",  # a store holds no more disk than its rows need
    STORE + "rocksdb.boundedMemoryUsage": "true",
    STORE + "rocksdb.maxMemoryUsageMB": "256",
}
PARTITIONS = "spark.sql.shuffle.partitions"
STORES = 4  # shuffle partitions for one store: digests are a small part of what the other shuffles carry


def normal(text: str = "text") -> Column:
    return F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _rows(found: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    place = found.metadataColumn("_metadata")
    locator = F.struct(place["file_path"].alias("file"), place["row_index"].alias("row"))
    rows = found.select("doc_id", normal().alias("text"), locator.alias("locator"))
    return rows.select("*", digest(F.col("text")).alias("digest"))


def _as_glob(path: str) -> str:
    """The same path as a pattern: a stream takes a single file only so."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]"


def absorb(spark: SparkSession, path: str, checkpoint: str, digest: Callable[[Column], Column] = sha256, files: int = FILES) -> None:
    """Take all files below ``path`` that the stream with this checkpoint has not read yet into its state."""
    session = spark.newSession()  # the store's settings are this stream's own
    stores = max(1, int(spark.conf.get(PARTITIONS)) // STORES)  # fixed by the first run of a checkpoint
    for key, value in {**STORE_CONF, PARTITIONS: str(stores)}.items():
        session.conf.set(key, value)
    schema = session.read.parquet(path).schema
    stream = session.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(_as_glob(path))
    state = _rows(stream, digest).groupBy("digest").agg(
        F.max(F.struct("doc_id", "locator")).alias("keep"), F.count("*").alias("n"))
    query = state.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """What the stream holds: ``digest``, ``keep`` (id and locator of the row that stays), ``n``."""
    found = spark.read.format("statestore").load(checkpoint)
    names = [f"{c}.`{f}`" for c in ("key", "value") for f in found.schema[c].dataType.names]
    return found.select(*[F.col(old).alias(new) for old, new in zip(names, ("digest", "keep", "n"))])


def decided(rows: DataFrame, held: DataFrame) -> DataFrame:
    """``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256`` of each row, hits checked by their bytes."""
    stays = F.col("locator") == F.col("keep.locator")
    joined = cut_lineage(rows.join(held, "digest").select(
        "doc_id", "digest", F.sha2("text", 256).alias("text_sha256"), "locator", F.col("keep.doc_id").alias("keep_id"), "n",
        stays.alias("kept"), F.when(F.col("n") > 1, F.col("text")).alias("text")))
    hits = joined.filter("n > 1").select("digest", "kept", "text")
    of = hits.filter("kept").select("digest", F.col("text").alias("kept_text"))
    # Written before it is made distinct: an aggregate on top would keep Spark from splitting a hot digest.
    differing = cut_lineage(hits.filter("not kept").join(of, "digest").filter("text <> kept_text").select("digest")).distinct()
    result = ["doc_id", "keep_id", F.col("n").alias("group_size"), "kept", "text_sha256"]
    if differing.isEmpty():
        return joined.select(*result)
    # Different texts under one digest: their bytes decide.
    apart = joined.join(differing, "digest", "left_semi")
    groups = apart.groupBy("digest", "text").agg(F.max(F.struct("doc_id", "locator")).alias("keep"), F.count("*").alias("n"))
    again = apart.select("doc_id", "digest", "text", "text_sha256", "locator").join(groups, ["digest", "text"]).select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("n").alias("group_size"), stays.alias("kept"), "text_sha256")
    return joined.join(differing, "digest", "left_anti").select(*result).unionByName(again)


def deduplicated(spark: SparkSession, path: str, checkpoint: str | None = None, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Bring the stream up to date with ``path`` and decide every row below it.

    An earlier row loses its place when a later file brings its text under a larger id.
    """
    checkpoint = checkpoint or f"{shared_folder(spark)}/marquee-state-{uuid.uuid4().hex}"
    absorb(spark, path, checkpoint, digest)
    return decided(_rows(spark.read.parquet(path), digest), cut_lineage(state(spark, checkpoint)))
