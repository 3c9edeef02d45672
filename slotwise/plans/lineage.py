"""Cutting lineage with reliable checkpoints (never local ones)."""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from slotwise.session import shared_dir

FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared ``spark.checkpoint.dir`` and truncate its plan.

    The frame is persisted while the checkpoint is written, so the plan runs
    once instead of once for the count and again for the write.
    """
    shared_dir(df.sparkSession)
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return held.checkpoint(eager=True)
    finally:
        held.unpersist()


def cut_even(df: DataFrame) -> DataFrame:
    """``cut`` into as many partitions as the size of ``df`` needs, however many its plan has.

    Nothing is persisted, as a persisted plan keeps its number of partitions: the count and the write both read the rebalanced shuffle.
    """
    shared_dir(df.sparkSession)
    return df.hint("rebalance").checkpoint(eager=True)


def cut_stored(df: DataFrame) -> DataFrame:
    """``df`` written once as parquet to the shared folder and read back, for frames too large for ``cut``.

    A checkpoint holds rows as they are in memory, and shuffle files stay until the driver collects garbage. Here the
    columns are compressed, nothing is persisted, and the shuffles that led to ``df`` are removed once it is written.
    The files stay in the shared folder, as what reads them may run at any time.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(FREE_SHUFFLES) if before is None else spark.conf.set(FREE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)
