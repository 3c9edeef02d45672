"""Tables stored in partitions, changed by rewriting only the partitions that hold a changed row.

Beside the rows (partitioned by one column, as bookings by booking_date) stands a directory from key to partition,
itself partitioned by blocks of keys. A batch of changes looks its keys up in the blocks they fall in, which names the
partitions to read; their new contents are written to a folder beside the rows first and then replace those
partitions by a dynamic partition overwrite. All other partitions are neither read nor shuffled nor written.

The change jobs need no change for this: given ``touched(keys)`` as their bookings they return the new contents of those
partitions, which ``overwrite`` puts in place.
"""

from __future__ import annotations

import dataclasses
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotwise.operators.changes import merge_updates
from slotwise.sources.published import _hadoop
from slotwise.sources.tables import write_table

BLOCK = 1_000_000
#: More blocks than this are not listed one by one: the whole directory is joined then.
LISTED_BLOCKS = 10_000


@dataclasses.dataclass(frozen=True)
class StoredTable:
    spark: SparkSession
    path: str
    schema: T.StructType
    key: str = "id"
    partition: str = "booking_date"
    block: int = BLOCK

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/rows").select(*self.schema.fieldNames())

    def _block(self) -> Column:
        return F.floor(F.col(self.key) / F.lit(self.block)).cast("bigint")

    def _entries(self, df: DataFrame) -> DataFrame:
        return df.select(self.key, F.col(self.partition).alias("_at"), self._block().alias("_block"))

    def directory(self) -> DataFrame:
        entry = T.StructType([T.StructField(self.key, self.schema[self.key].dataType),
                              T.StructField("_at", self.schema[self.partition].dataType), T.StructField("_block", T.LongType())])
        return self.spark.read.schema(entry).parquet(f"{self.path}/directory")

    def partitions_of(self, keys: DataFrame) -> list:
        """The partition values that hold any of ``keys(key)``: at most one for each partition of the table."""
        asked = keys.select(F.col(self.key)).filter(F.col(self.key).isNotNull()).distinct()
        blocks = [r[0] for r in asked.select(self._block().alias("b")).distinct().limit(LISTED_BLOCKS + 1).collect()]
        entries = self.directory()
        if len(blocks) <= LISTED_BLOCKS:
            entries = entries.filter(F.col("_block").isin(blocks))
        return [r[0] for r in entries.join(asked, self.key, "left_semi").select("_at").distinct().collect()]

    def touched(self, keys: DataFrame) -> DataFrame:
        """All rows of the partitions that hold any of ``keys(key)``; the scan lists those partitions only."""
        values = self.partitions_of(keys)
        held = F.col(self.partition).isin([v for v in values if v is not None])
        if None in values:
            held = held | F.col(self.partition).isNull()
        return self.rows().filter(held)

    def overwrite(self, df: DataFrame) -> None:
        """Replace the partitions that ``df`` holds rows of by those rows, which must be all that belong there."""
        aside = f"{self.path}/aside-{uuid.uuid4().hex}"  # safe there before anything is removed
        write_table(df.select(*self.schema.fieldNames()), aside, partition_by=[self.partition])
        kept = self.spark.read.schema(self.schema).parquet(aside).select(*self.schema.fieldNames())
        # its files hold one partition each, so they are brought together without a shuffle
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.partition).parquet(f"{self.path}/rows")
        fs, folder = _hadoop(self.spark, aside)
        fs.delete(folder, True)

    def update(self, changes: DataFrame, columns: list[str], order: str | None = None) -> None:
        """``merge_updates`` of ``changes(key, columns...)`` in the partitions that hold the keys; unknown keys change nothing."""
        if self.partition in columns or self.key in columns:
            raise ValueError("the key and the partition column place a row; they cannot be updated in place")
        self.overwrite(merge_updates(self.touched(changes.select(self.key)), changes, self.key, columns, order))

    def insert(self, df: DataFrame) -> None:
        """Append rows with new keys; they go to the directory first, where an entry without a row does no harm."""
        write_table(self._entries(df), f"{self.path}/directory", mode="append", partition_by=["_block"])
        write_table(df.select(*self.schema.fieldNames()), f"{self.path}/rows", mode="append", partition_by=[self.partition])


def create(df: DataFrame, path: str, key: str = "id", partition: str = "booking_date", block: int = BLOCK) -> StoredTable:
    """Store ``df`` at ``path`` with its directory, which is made from the stored rows: ``df`` is evaluated once."""
    table = StoredTable(df.sparkSession, path, df.schema, key, partition, block)
    write_table(df, f"{path}/rows", mode="append", partition_by=[partition])
    write_table(table._entries(table.rows()), f"{path}/directory", mode="append", partition_by=["_block"])
    return table
