"""Owner-level roll-ups that aggregate bookings per court BEFORE joining courts.

Spark does not push aggregates below joins, so a report written as
``bookings ⋈ courts GROUP BY owner`` would shuffle every booking row. Here
bookings are first reduced per (court_id, keys…) with map-side partial
aggregation — a hot court collapses inside each task — and only those partial
rows meet ``courts`` (a table the size of the court list) before the final
group by owner.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.sources.tables import Tables


def share_of(amount: Column, share: float) -> Column:
    """amount * share in exact decimal arithmetic (no binary-float drift in sums)."""
    return amount * F.lit(Decimal(str(share)))


def court_owner(t: Tables) -> DataFrame:
    return t.courts.select(F.col("id").alias("court_id"), "owner_id").filter(F.col("owner_id").isNotNull())


def per_court(bookings: DataFrame, keys: dict[str, Column] | None = None) -> DataFrame:
    """(court_id, keys…) -> amount = SUM(total_amount), n = COUNT(*).

    A row of a stored aggregate (``operators.daily``) stands for ``_weight`` bookings.
    """
    keys = keys or {}
    number = F.sum("_weight") if "_weight" in bookings.columns else F.count(F.lit(1))
    return (bookings.groupBy("court_id", *[e.alias(k) for k, e in keys.items()])
            .agg(F.sum("total_amount").alias("amount"), number.alias("n")))


def per_owner(t: Tables, where: Column | None = None, keys: dict[str, Column] | None = None) -> DataFrame:
    """(owner_id, keys…) -> amount, n over bookings JOIN courts, filtered by ``where``."""
    keys = keys or {}
    b = t.bookings if where is None else t.bookings.filter(where)
    pc = per_court(b, keys).join(court_owner(t), "court_id")
    return (pc.groupBy("owner_id", *keys)
            .agg(F.sum("amount").alias("amount"), F.sum("n").alias("n")))
