"""Session settings every operator relies on, and reliable lineage cuts."""

from __future__ import annotations

import functools
import re
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

# Runtime settings; all can be changed on a live session.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Rows are short when shuffled and carry long texts after: a task's share stays small as inputs grow.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Applies to rebalanced outputs; hot join keys fall under the setting above.
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Of a name that a JSON object holds twice the last value counts, as to other JSON parsers.
    "spark.sql.variant.allowDuplicateKeys": "true",
}

CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings (UTC session clock, adaptive execution).

    The package's own functions travel to the workers by value, so executors
    need not have the package on their path.
    """
    cloudpickle.register_pickle_by_value(sys.modules["marquee"])
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cores: str = "8", app: str = "marquee", memory: str = "16g") -> SparkSession:
    """A single-machine session for tests and the bench."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="marquee-")


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a folder of this process where
    the setting is missing and the driver is the only executor."""
    key = "spark.checkpoint.dir"
    folder = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key, None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError(f"set {key} to a shared folder")
        folder = _own_folder()
    return folder.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder named by ``spark.checkpoint.dir``, read it back.

    The files outlive lost executors, and unlike a checkpointed RDD the table
    keeps column pruning and size statistics. A temporary folder is used only
    where the setting is missing and the driver is the only executor.
    """
    return df.sparkSession.read.schema(df.schema).parquet(write_table(df))


def write_table(df: DataFrame) -> str:
    """Write ``df`` to a folder of its own in the shared folder; returns its path.

    The shuffle files behind it go with the write: nothing reads them afterwards, and
    otherwise they stay on disk until the driver happens to collect its garbage.
    """
    path = f"{shared_folder(df.sparkSession)}/marquee-{uuid.uuid4().hex}"
    conf = df.sparkSession.conf
    before = conf.get(CLEAN_SHUFFLES, None)
    conf.set(CLEAN_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(CLEAN_SHUFFLES) if before is None else conf.set(CLEAN_SHUFFLES, before)
    return path
