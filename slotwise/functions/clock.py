"""Times of day stored as zero-padded 'HH:MM' text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hour_of(col: str | Column) -> Column:
    """Integer hour of an 'HH:MM' text (parseInt of the part before ':'); NULL if unparsable."""
    c = F.col(col) if isinstance(col, str) else col
    return F.split_part(c, F.lit(":"), F.lit(1)).try_cast("int")


def hhmm(hour: str | Column, minute: str = "00") -> Column:
    """Hour number -> 'HH:MM' text (padStart(2, '0'))."""
    h = F.col(hour) if isinstance(hour, str) else hour
    return F.concat(F.lpad(h.cast("string"), 2, "0"), F.lit(":" + minute))


def slot_ts(date_col: str | Column, time_col: str | Column) -> Column:
    """booking_date + 'HH:MM' -> TIMESTAMP_NTZ, built from its parts (independent of the session
    time zone); NULL when the time is not a valid 'HH:MM'."""
    d = F.col(date_col) if isinstance(date_col, str) else date_col
    t = F.col(time_col) if isinstance(time_col, str) else time_col
    hh = F.split_part(t, F.lit(":"), F.lit(1)).try_cast("int")
    mm = F.split_part(t, F.lit(":"), F.lit(2)).try_cast("int")
    ok = (F.length(t) == 5) & hh.between(0, 23) & mm.between(0, 59)
    return F.when(ok, F.try_make_timestamp_ntz(F.year(d), F.month(d), F.dayofmonth(d), hh, mm, F.lit(0)))
