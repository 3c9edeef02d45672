"""Exact "first one wins" over several unique keys, as sequential inserts decide it.

A row is kept iff no EARLIER KEPT row shares any key with it. That is a greedy
pass in row order; we evaluate it in set-based rounds over the undecided rows:

* an undecided row whose order is the minimum of every key group it belongs
  to (among undecided rows) is certainly kept — nothing before it can block it;
* undecided rows sharing a key with a row kept this round are ignored;
* repeat until every row is decided. The global minimum is always kept, so every round makes progress.

Only the order and the keys go through the rounds; the other columns are joined to the decisions once at the end. Each
round is grouped aggregates (partial aggregation, so a hot key never lands whole in one task) and joins over the
still-undecided rows only; each round's decisions are checkpointed once, so neither the plan nor the written volume
grows with the number of rounds beyond the shrinking undecided set. A chain of rows in which each shares a key with the
next needs a number of rounds in proportion to its length: the rule itself is sequential there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.plans.lineage import cut

ORDER, STATUS = "_greedy_order", "_greedy_status"


def first_wins(batch: DataFrame, keys: Sequence[Sequence[str]], order: str) -> tuple[DataFrame, DataFrame]:
    """Split ``batch`` into (kept, ignored) rows; ``order`` must be unique per row.

    NULL key values never clash (SQL UNIQUE semantics).
    """
    rows = batch.withColumn(ORDER, F.col(order))
    if len(keys) == 1:
        key = list(keys[0])
        first = rows.groupBy(*key).agg(F.min(ORDER).alias("_first"))
        flagged = rows.join(first, on=key, how="left")
        keep = F.col("_first").isNull() | (F.col(ORDER) == F.col("_first"))
        return (flagged.filter(keep).drop("_first", ORDER),
                flagged.filter(~keep).drop("_first", ORDER))
    undecided = cut(rows.select(ORDER, *sorted({c for key in keys for c in key})))
    decided = None
    while not undecided.isEmpty():
        flagged = undecided
        safe = F.lit(True)
        for i, key in enumerate(keys):
            key = list(key)
            mins = undecided.groupBy(*key).agg(F.min(ORDER).alias(f"_min{i}"))
            flagged = flagged.join(mins, on=key, how="left")
            safe = safe & (F.col(f"_min{i}").isNull() | (F.col(f"_min{i}") == F.col(ORDER)))
        flagged = flagged.withColumn("_safe", safe).drop(*[f"_min{i}" for i in range(len(keys))])
        kept_now = flagged.filter("_safe")
        state = flagged
        hit = F.lit(False)
        for i, key in enumerate(keys):
            key = list(key)
            # a kept row is the only one of its keys that is kept: at most one match
            state = state.join(kept_now.select(*key, F.lit(True).alias(f"_hit{i}")).dropna(), on=key, how="left")
            hit = hit | F.coalesce(F.col(f"_hit{i}"), F.lit(False))
        state = cut(state.withColumn(STATUS, F.when(F.col("_safe"), 1).when(hit, 2).otherwise(0))
                    .drop("_safe", *[f"_hit{i}" for i in range(len(keys))]))
        now = state.filter(F.col(STATUS) > 0).select(ORDER, STATUS)
        decided = now if decided is None else decided.unionByName(now)
        undecided = state.filter(F.col(STATUS) == 0).drop(STATUS)
    if decided is None:
        return batch, batch.limit(0)
    kept = rows.join(decided.filter(F.col(STATUS) == 1), ORDER).drop(STATUS, ORDER)
    ignored = rows.join(decided.filter(F.col(STATUS) == 2), ORDER).drop(STATUS, ORDER)
    return kept.select(*batch.columns), ignored.select(*batch.columns)
