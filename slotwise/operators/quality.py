"""Audits of the declared constraints (unique, not null, check, foreign keys).

SQLite enforces these on insert; over a lake of parquet files nothing does,
so each is a set-based audit job over whole tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.sources.schema import CHECKS, FOREIGN_KEYS, NOT_NULL, UNIQUE
from slotwise.sources.tables import Tables


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def audit_unique(t: Tables) -> DataFrame:
    """Values of UNIQUE columns held by more than one row (NULLs never clash)."""
    frames = []
    for table, col in UNIQUE:
        df = getattr(t, table)
        frames.append(df.filter(F.col(col).isNotNull()).groupBy(F.col(col).cast("string").alias("value"))
                      .agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
                      .select(F.lit(table).alias("table"), F.lit(col).alias("column"), "value", "n"))
    return _union(frames)


def audit_not_null(t: Tables) -> DataFrame:
    """(table, column, nulls) for NOT NULL columns holding NULLs — one aggregate pass per table.

    A declared column missing from the frame counts as NULL in every row.
    """
    frames = []
    for table, cols in NOT_NULL.items():
        df = getattr(t, table)
        aggs = [(F.count_if(F.col(c).isNull()) if c in df.columns else F.count(F.lit(1))).alias(c) for c in cols]
        counts = df.agg(*aggs)
        frames.append(counts.unpivot([], list(cols), "column", "nulls")
                      .select(F.lit(table).alias("table"), "column", F.col("nulls").cast("bigint").alias("nulls")))
    return _union(frames).filter(F.col("nulls") > 0)


def audit_check(t: Tables) -> DataFrame:
    """Rows breaking a CHECK rule: (table, rule, id). A NULL outcome passes, as in SQL."""
    frames = []
    for table, rule, cond in CHECKS:
        df = getattr(t, table)
        frames.append(df.filter(F.expr(f"NOT ({cond})")).select(F.lit(table).alias("table"),
                                                                F.lit(rule).alias("rule"), F.col("id")))
    return _union(frames)


def audit_foreign_keys(t: Tables) -> DataFrame:
    """Orphans: (child, column, id, missing_key) where a non-NULL key has no parent row.

    The keys of all parents and of all references to them are tagged, unioned and aggregated once: a (parent, key) group
    without a parent row is an orphan key. Partial aggregation makes a key that a third of all rows refer to one row per task.
    Only the orphan keys, none in sound tables, meet the references again to name their rows.
    """
    refs = []
    for child, col, parent in FOREIGN_KEYS:
        c = getattr(t, child)
        if col in c.columns:
            refs.append(c.filter(F.col(col).isNotNull()).select(
                F.lit(parent).alias("parent"), F.lit(child).alias("child"), F.lit(col).alias("column"), F.col("id"),
                F.col(col).cast("bigint").alias("missing_key")))
    used = _union(refs)
    parents = sorted({parent for _, _, parent in FOREIGN_KEYS})
    held = _union([getattr(t, p).select(F.lit(p).alias("parent"), F.col("id").cast("bigint").alias("missing_key"), F.lit(1).alias("row"))
                   for p in parents])
    keys = held.unionByName(used.select("parent", "missing_key", F.lit(0).alias("row")))
    orphans = keys.groupBy("parent", "missing_key").agg(F.max("row").alias("row")).filter(F.col("row") == 0).select("parent", "missing_key")
    return used.join(orphans, ["parent", "missing_key"]).select("child", "column", "id", "missing_key")
