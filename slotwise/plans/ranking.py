"""Row numbers within groups that stay balanced when one group holds a third of the rows.

``Window.partitionBy(g)`` sends every row of a group to one task. For full
rankings we instead:

1. range-partition by (g, order…) — sampling puts the cut points inside a hot
   group, so its rows spread over several partitions — and sort within
   partitions;
2. number rows locally within each (partition, g) piece from a per-partition
   running id — no second shuffle;
3. count rows per piece — a tiny table (≤ groups + partitions rows) — and
   turn it into per-piece offsets with a window over g ordered by partition
   (at most one row per partition per group);
4. position = local number + offset, and the group size comes along.

Range split points come from sampling, and two evaluations of the same plan
sample independently, so the locally numbered pieces are materialised once
with a reliable checkpoint (``plans.lineage.cut``) before counting — the same
two-pass scheme as ``zipWithIndex``, and it also cuts lineage for recovery.

For bounded top-k (k ≤ ``spark.sql.optimizer.windowGroupLimitThreshold``)
``row_number() <= k`` is enough: Spark inserts a partial WindowGroupLimit
before the shuffle, so each task forwards at most k rows per group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotwise.plans.lineage import cut


def _cols(names: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in names]


def positions(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "position",
              size_name: str | None = None, partitions: int | None = None) -> DataFrame:
    """Add 1-based ``name`` = row number of each row within its ``by`` group under ``order``.

    ``order`` must be a total order inside a group (end it with a unique key);
    ``by=[]`` numbers the whole frame (like ``zipWithIndex``). ``size_name``
    (optional) adds the group's row count.

    Range-partition by (by, order) and sort within partitions — one shuffle.
    Inside a partition ``monotonically_increasing_id`` counts rows
    consecutively, so a row's local number is its id minus the first id of its
    (partition, group) piece. The piece table (count and first id per piece)
    has at most groups + partitions rows; a window over it gives each piece
    the rows of its group in earlier partitions. Without groups it has at
    most ``partitions`` rows — a proven bound — and is broadcast.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [*_cols(by), *order]
    keyed = cut(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
                .withColumn("_piece", F.spark_partition_id()).withColumn("_idx", F.monotonically_increasing_id()))
    pieces = keyed.groupBy("_piece", *by).agg(F.count(F.lit(1)).alias("_n"), F.min("_idx").alias("_first"))
    before = Window.partitionBy(*by).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    if size_name:
        pieces = pieces.withColumn(size_name, F.sum("_n").over(Window.partitionBy(*by)))
    extra = [size_name] if size_name else []
    # renamed copy: both sides descend from `keyed`, so avoid ambiguous self-join references
    p = pieces.select(F.col("_piece").alias("_p_piece"), *[F.col(c).alias(f"_p_by{i}") for i, c in enumerate(by)],
                      "_first", "_offset", *extra)
    if not by:
        p = F.broadcast(p)
    # null-safe equality so a NULL group is a group, like PARTITION BY
    cond = [F.col("_piece") == F.col("_p_piece")] + [F.col(c).eqNullSafe(F.col(f"_p_by{i}"))
                                                      for i, c in enumerate(by)]
    out = keyed.join(p, on=cond).drop("_p_piece", *[f"_p_by{i}" for i in range(len(by))])
    return out.withColumn(name, F.col("_idx") - F.col("_first") + 1 + F.col("_offset")).drop(
        "_piece", "_idx", "_first", "_offset")


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, name: str = "rn",
          skip: int = 0) -> DataFrame:
    """Rows ranked ``skip+1 … k`` within each group (row numbers in ``name``)."""
    w = Window.partitionBy(*by).orderBy(*order)
    out = df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)
    return out.filter(F.col(name) > skip) if skip else out
