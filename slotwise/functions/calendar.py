"""Calendar helpers mirroring the reference's text date functions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_of_ts(as_of) -> Column:
    """An explicit point in time (never the wall clock) as a TIMESTAMP_NTZ literal."""
    if isinstance(as_of, Column):
        return as_of
    if as_of is None:
        return F.lit(None).cast("timestamp_ntz")
    if isinstance(as_of, str):
        as_of = dt.datetime.fromisoformat(as_of)
    if isinstance(as_of, dt.date) and not isinstance(as_of, dt.datetime):
        as_of = dt.datetime(as_of.year, as_of.month, as_of.day)
    return F.lit(as_of.isoformat(sep=" ")).cast("timestamp_ntz")


def as_of_date(as_of) -> Column:
    return F.to_date(as_of_ts(as_of))


def in_period(col: str | Column, as_of, unit: str) -> Column:
    """``col`` lies in as_of's 'year' or 'month': two bounds on the stored column, which reach the scan."""
    start = F.trunc(as_of_date(as_of), unit)
    end = F.add_months(start, 12 if unit == "year" else 1)
    c = F.col(col) if isinstance(col, str) else col
    return (c >= start.cast("timestamp_ntz")) & (c < end.cast("timestamp_ntz"))


def month(col: str | Column) -> Column:
    """'YYYY-MM' of a timestamp (strftime('%Y-%m'))."""
    return F.date_format(col, "yyyy-MM")


def year_text(col: str | Column) -> Column:
    return F.date_format(col, "yyyy")


def month_num(col: str | Column) -> Column:
    """'MM' (strftime('%m'))."""
    return F.date_format(col, "MM")


def day_text(col: str | Column) -> Column:
    """'DD' (strftime('%d'))."""
    return F.date_format(col, "dd")


def weekday_text(col: str | Column) -> Column:
    """'0' = Sunday … '6' = Saturday (strftime('%w'))."""
    return (F.dayofweek(col) - 1).cast("string")
