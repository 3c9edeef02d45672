"""The minutes of a court-day as bits, and the first interval that covers a minute.

Times are zero-padded 'HH:MM'; a booking from s to e covers the minutes s, s + 1, ..., e - 1 (none when e <= s).

``occupancy`` keeps 1440 bits per court-day, 60 in each of 24 longs, built by ``bit_or`` with partial aggregation: a court-day
with a third of all bookings is one row per map task. Asking whether a booking covers a minute is a bit test on the joined row, so
no interval is ever expanded and no pair of intervals compared.

``first_covers`` also says which interval is the first (least id). An interval is laid out in whole hours, whole
quarters and single minutes, at most 14 + 3 + 22 + 3 + 14 of them; the least id of each is a partial min aggregate, and a
court-day's table of them has at most 24 + 96 + 1440 entries whatever the number of bookings. A minute lies in one hour, one quarter
and one minute, so its first interval is the least of three look-ups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY = ("court_id", "booking_date")
HOURS = 24
_QUARTER, _HOUR, _START = 2000, 3000, 10_000  # where the numbers of quarters, of hours and of starts begin


def minute_of(time: str | Column) -> Column:
    """Minute of the day of an 'HH:MM' text from 00:00 to 24:00; NULL for any other text."""
    t = F.col(time) if isinstance(time, str) else time
    hh, mm = F.substring(t, 1, 2).try_cast("int"), F.substring(t, 4, 2).try_cast("int")
    valid = (F.length(t) == 5) & (F.substring(t, 3, 1) == ":") & hh.between(0, 24) & mm.between(0, 59) & (60 * hh + mm <= 1440)
    return F.when(valid, 60 * hh + mm)


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int"))


def _mask(start: Column, end: Column, hour: Column | int) -> Column:
    """The bits of ``hour`` from minute ``start`` to before ``end`` of the day; NULL when there is none."""
    first = F.lit(hour) * 60 if isinstance(hour, int) else hour * 60
    lo, hi = F.greatest(start - first, F.lit(0)), F.least(end - first, F.lit(60))
    return F.when(lo < hi, _bit(hi) - _bit(lo))


def occupancy(bookings: DataFrame, by: tuple[str, ...] = DAY, name: str = "hours") -> DataFrame:
    """``(by..., name)``: per group an array of 24 longs; bit m of entry h is set when a booking covers minute 60 h + m."""
    rows = bookings.select(*by, minute_of("start_time").alias("_s"), minute_of("end_time").alias("_e")).filter("_s < _e")
    masks = [F.bit_or(_mask(F.col("_s"), F.col("_e"), h)).alias(f"_h{h}") for h in range(HOURS)]
    packed = F.array(*[F.coalesce(F.col(f"_h{h}"), F.lit(0).cast("long")) for h in range(HOURS)])
    return rows.groupBy(*by).agg(*masks).select(*by, packed.alias(name))


def covered(hours: Column, minute: Column) -> Column:
    """Does a booking of ``hours`` cover ``minute``? False without bookings, and for minutes outside the day."""
    bit = F.call_function("shiftright", F.get(hours, F.floor(minute / 60).cast("int")), F.pmod(minute, F.lit(60)).cast("int"))
    return F.coalesce(bit.bitwiseAND(F.lit(1).cast("long")) == 1, F.lit(False))


def any_covered(hours: Column, start: Column, end: Column) -> Column:
    """Does a booking of ``hours`` cover any minute from ``start`` to before ``end``?"""
    touched = F.sequence(F.floor(start / 60).cast("int"), F.floor((end - 1) / 60).cast("int"))
    hit = F.exists(touched, lambda h: F.coalesce(F.get(hours, h).bitwiseAND(_mask(start, end, h)), F.lit(0).cast("long")) != 0)
    return F.coalesce(F.when((start < end) & hours.isNotNull(), hit), F.lit(False))


def _range(lo: Column, hi: Column, base: int) -> Column:
    none = F.array().cast("array<int>")
    return F.when(lo < hi, F.transform(F.sequence(lo, hi - 1), lambda x: x + base)).otherwise(none)


def _cover(start: Column, end: Column) -> Column:
    """The hours, quarters and minutes that make up the minutes from ``start`` to before ``end``."""
    up = lambda x, n: F.ceil(x / n).cast("int")
    down = lambda x, n: F.floor(x / n).cast("int")
    q1, q2 = up(start, 15), down(end, 15)
    h1, h2 = up(start, 60), down(end, 60)
    quarters = F.when(h1 <= h2, F.concat(_range(q1, 4 * h1, _QUARTER), _range(h1, h2, _HOUR), _range(4 * h2, q2, _QUARTER))).otherwise(
        _range(q1, q2, _QUARTER))
    return F.when(q1 <= q2, F.concat(_range(start, 15 * q1, 0), quarters, _range(15 * q2, end, 0))).otherwise(_range(start, end, 0))


def _holders(minute: Column) -> list[Column]:
    return [minute, F.floor(minute / 15).cast("int") + _QUARTER, F.floor(minute / 60).cast("int") + _HOUR]


def first_covers(rows: DataFrame, id_col: str, starts: bool = False, name: str = "firsts") -> DataFrame:
    """``(court_id, booking_date, name)``: a map from each hour, quarter and minute to the least id whose interval is laid out in it.

    With ``starts`` it also holds the least id among the intervals that start in each.
    """
    s, e = F.col("_s"), F.col("_e")
    own = rows.select(*DAY, F.col(id_col).alias("_id"), minute_of("start_time").alias("_s"), minute_of("end_time").alias("_e")).filter("_s < _e")
    laid = _cover(s, e)
    if starts:
        laid = F.concat(laid, F.array(*[x + _START for x in _holders(s)]))
    least = own.select(*DAY, "_id", F.explode(laid).alias("_node")).groupBy(*DAY, "_node").agg(F.min("_id").alias("_id"))
    return least.groupBy(*DAY).agg(F.map_from_entries(F.collect_list(F.struct("_node", "_id"))).alias(name))


def first_at(firsts: Column, minute: Column) -> Column:
    """The least id whose interval covers ``minute``; NULL if none does."""
    return F.least(*[F.try_element_at(firsts, x) for x in _holders(minute)])


def first_start(firsts: Column, start: Column, end: Column) -> Column:
    """The least id whose interval starts from ``start`` to before ``end``; needs ``starts``."""
    return F.array_min(F.transform(_cover(start, end), lambda x: F.try_element_at(firsts, x + _START)))
