"""New surrogate ids for inserted rows: max(existing id) + position in request order.

The position comes from ``ranking.positions`` with no group, i.e. a range
partitioned global numbering (like zipWithIndex) — never a window over one
partition. The max is a scalar subquery (computed once, no join).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.plans.ranking import positions


def assign_ids(rows: DataFrame, existing: DataFrame, order: list[Column], name: str = "id",
               key: str = "id") -> DataFrame:
    base = existing.agg(F.coalesce(F.max(key), F.lit(0)).cast("bigint")).scalar()
    numbered = positions(rows, [], order, name="_pos")
    return numbered.withColumn(name, base + F.col("_pos")).drop("_pos")
