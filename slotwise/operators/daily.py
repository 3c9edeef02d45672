"""A stored daily aggregate of confirmed bookings, from which the owner reports are made.

One row per (court, created day, weekday of the booking date) holds the amount and the number of confirmed bookings; it is stored by
created day. Later changes (new, late, cancelled bookings) concern few created days: ``refresh`` reads the bookings created on
those days only, through bounds that reach the scan, and replaces their partitions.

``as_bookings`` gives the aggregate the shape of bookings, with ``_weight`` for the number that a row stands for. Every
report that sums and counts confirmed bookings by created day, court or weekday takes it in place of the bookings:
``reports.owner_monthly_earnings(t.replace(bookings=as_bookings(...)))`` equals the report on the bookings, with a scan of courts x
days rows. A report that cuts a day at a time of day (``owner_weekday_trend``) needs that day's own bookings: name it in ``whole_days``.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.operators.reports import CONFIRMED
from slotwise.plans.lineage import cut
from slotwise.sources.tables import Tables, write_table

SCHEMA = "court_id long, weekday int, amount decimal(22,2), n long, created_day date"
#: Any Sunday: a row's booking date is the date of this week with its weekday.
_SUNDAY = dt.date(2000, 1, 2)


def aggregate(bookings: DataFrame) -> DataFrame:
    rows = bookings.filter(F.col("booking_status") == CONFIRMED)
    keys = [F.col("court_id"), (F.dayofweek("booking_date") - 1).alias("weekday"), F.to_date("created_at").alias("created_day")]
    return rows.groupBy(*keys).agg(F.sum("total_amount").cast("decimal(22,2)").alias("amount"), F.count(F.lit(1)).alias("n")).select(
        "court_id", "weekday", "amount", "n", "created_day")


def build(t: Tables, path: str) -> None:
    """Store the aggregate of all bookings."""
    write_table(aggregate(t.bookings), path, partition_by=["created_day"])


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path).filter(F.col("n") > 0)


def changed_days(bookings: DataFrame, ids: DataFrame) -> DataFrame:
    """``(created_day)`` of the bookings ``ids(id)``."""
    return bookings.join(ids.select("id").distinct(), "id", "left_semi").select(F.to_date("created_at").alias("created_day")).distinct()


def refresh(t: Tables, path: str, days: DataFrame) -> None:
    """Make the aggregate of ``days(created_day)`` anew from the bookings; all other days stay as they are stored.

    A day on which nothing confirmed is left keeps one row with n = 0, which ``read`` leaves out.
    """
    days = days.select(F.col("created_day").cast("date").alias("created_day")).distinct()
    listed = [r[0] for r in days.collect()]  # at most one for each calendar day
    known = [d for d in listed if d is not None]
    created = F.col("created_at")
    of_days = created.isNull() if None in listed else F.lit(False)
    if known:
        first, end = min(known), max(known) + dt.timedelta(days=1)
        of_days = of_days | ((created >= F.lit(first).cast("timestamp_ntz")) & (created < F.lit(end).cast("timestamp_ntz"))
                             & F.to_date(created).isin(known))
    none = days.select(F.lit(None).cast("long").alias("court_id"), F.lit(None).cast("int").alias("weekday"),
                       F.lit(0).cast("decimal(22,2)").alias("amount"), F.lit(0).cast("long").alias("n"), "created_day")
    fresh = cut(aggregate(t.bookings.filter(of_days)).unionByName(none))
    fresh.hint("rebalance", "created_day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "created_day").parquet(path)


def as_bookings(daily: DataFrame, t: Tables, whole_days: Iterable[dt.date] = ()) -> DataFrame:
    """The aggregate in the shape of confirmed bookings; of ``whole_days`` the bookings themselves."""
    days = list(whole_days)
    columns = ["court_id", "booking_date", "booking_status", "total_amount", "created_at", "_weight"]
    rows = daily.filter(~F.col("created_day").isin(days) | F.col("created_day").isNull()) if days else daily
    rows = rows.select(
        "court_id", F.date_add(F.lit(_SUNDAY), F.col("weekday")).alias("booking_date"), F.lit(CONFIRMED).alias("booking_status"),
        F.col("amount").alias("total_amount"), F.col("created_day").cast("timestamp_ntz").alias("created_at"), F.col("n").alias("_weight"))
    for day in days:
        start = F.lit(day).cast("timestamp_ntz")
        own = t.bookings.filter((F.col("booking_status") == CONFIRMED) & (F.col("created_at") >= start)
                                & (F.col("created_at") < F.lit(day + dt.timedelta(days=1)).cast("timestamp_ntz")))
        rows = rows.unionByName(own.withColumn("_weight", F.lit(1).cast("long")).select(*columns))
    return rows.select(*columns)


def with_daily(t: Tables, path: str, whole_days: Iterable[dt.date] = ()) -> Tables:
    """``t`` with the stored aggregate in place of its bookings, for the owner reports."""
    return t.replace(bookings=as_bookings(read(t.bookings.sparkSession, path), t, whole_days))
