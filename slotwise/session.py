"""Session settings the library expects, and where durable scratch data goes."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings that matter at scale: AQE re-plans joins from real shuffle sizes,
# splits skewed join partitions and coalesces tiny ones. No operator hints a
# broadcast; every broadcast is a size check by Spark itself: at runtime on
# the MEASURED size of a shuffled side (adaptive threshold), and at planning
# time only for sides whose estimate is small even after scaling compressed
# file sizes by 3 (static threshold 10 MB, fileCompressionFactor 3).
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # shuffle partitions coalesce towards 8 MB: keys shrink so well that sorts and hash maps of these rows take 25 to 100
    # times as much memory in a task; a partition 5x the median and over 256 MB counts as skewed
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8MB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "256MB",
    # scan splits of 256 MB of parquet: a few hundred MB of rows per task, well inside executor memory
    "spark.sql.files.maxPartitionBytes": "256MB",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
    "spark.sql.autoBroadcastJoinThreshold": "10MB",
    "spark.sql.sources.fileCompressionFactor": "3.0",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # checkpoint files are removed once the checkpointed frames are no longer referenced
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, partitions: int | None = None, app: str = "slotwise") -> SparkSession:
    """A session with ``SCALE_CONF``.

    Under spark-submit (no ``master``) the cluster's own shuffle partitions and
    memory settings are kept; local runs get ``partitions`` (default 8) and a
    driver memory setting.
    """
    builder = SparkSession.builder.appName(app)
    local = bool(master) and master.startswith("local")
    if master:
        builder = builder.master(master)
    if partitions or local:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions or 8))
    if local:
        builder = builder.config("spark.driver.memory", os.environ.get("SLOTWISE_DRIVER_MEMORY", "8g"))
    for key, value in SCALE_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def small_partitions(spark: SparkSession) -> None:
    """The shuffle partition size of ``SCALE_CONF``, for sessions that were built elsewhere too: it bounds what a task holds.

    Without it partitions are coalesced to the number of cores, and a task's memory grows with the tables.
    """
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(size, SCALE_CONF[size])


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Read from the session; only when the session has none (local tests) is
    ``fallback`` installed as the SparkContext checkpoint folder. A Spark
    Connect session has no SparkContext here; its server-side setting is used.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: no driver-side SparkContext
        if current or fallback:
            return current or fallback
        raise RuntimeError("spark.checkpoint.dir is not set") from None
    current = current or sc.getCheckpointDir()
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if fallback is None:
        raise RuntimeError("spark.checkpoint.dir is not set; pass a shared fallback folder")
    sc.setCheckpointDir(fallback)
    return fallback


def shared_dir(spark: SparkSession) -> str:
    """``checkpoint_dir``; a session that names no folder gets a scratch one only on a local master (tests), else an error."""
    try:
        return checkpoint_dir(spark)
    except RuntimeError:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise
        return checkpoint_dir(spark, fallback=tempfile.mkdtemp(prefix="slotwise-ckpt-"))
