"""Interval work on 'HH:MM' times: free hourly slots and booking conflicts.

The reference asks whether an existing booking covers the first minute of a
request, or its last one (``strict``: any of its minutes). Both are answered
from the minutes of a court-day (``plans.minutes``): bits built by ``bit_or``
say whether a minute is taken, a table of least ids says by which booking
first. No interval is expanded to rows of its own and no pairs are compared,
so a busy court-day costs no more per booking than a quiet one.

Intervals that end where or before they start cover no minute. Under the
reference's test they block nothing; under the strict test they overlap what
lies around them, so for them alone ``blocked_rows`` looks at candidates of the
same hours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.functions.calendar import as_of_date
from slotwise.functions.clock import hhmm, hour_of
from slotwise.plans import minutes as M
from slotwise.sources.tables import Tables

CONFIRMED = "confirmed"


def _hours(lo: Column, hi: Column) -> Column:
    """sequence(lo, hi) guarded against lo > hi (Spark would count downwards)."""
    return F.when(lo <= hi, F.sequence(lo, hi))


def _opening(t: Tables, court_id=None) -> DataFrame:
    c = t.courts if court_id is None else t.courts.filter(F.col("id") == F.lit(court_id))
    return c.select(F.col("id").alias("court_id"), _hours(hour_of("open_time"), hour_of("close_time") - 1).alias("_slots"))


def _as_slots(hours: DataFrame) -> DataFrame:
    return hours.select("court_id", "hour", hhmm("hour").alias("start_time"), hhmm(F.col("hour") + 1).alias("end_time"))


def court_hour_slots(t: Tables, court_id=None) -> DataFrame:
    """Every court's hourly slots from its opening hour to the hour before closing.

    Minutes of open/close are dropped (07:30 opens at 07:00), and inactive
    courts are included, as in the reference.
    """
    return _as_slots(_opening(t, court_id).select("court_id", F.explode("_slots").alias("hour")))


def available_slots(t: Tables, date, court_id=None) -> DataFrame:
    """Free hourly slots of every court on ``date``: slots whose first minute no confirmed booking covers.

    A court meets one row with the bits of its day; see ``court_hour_slots`` for the slots.
    """
    day = as_of_date(date)
    b = t.bookings.filter((F.col("booking_date") == day) & (F.col("booking_status") == CONFIRMED))
    if court_id is not None:
        b = b.filter(F.col("court_id") == F.lit(court_id))
    free = F.filter("_slots", lambda h: ~M.covered(F.col("hours"), h * 60))
    met = _opening(t, court_id).join(M.occupancy(b, ("court_id",)), "court_id", "left")
    return _as_slots(met.select("court_id", F.explode(free).alias("hour"))).drop("hour").withColumn("available", F.lit(True))


def taken(hours: Column, strict: bool) -> Column:
    """Do the bookings whose bits are ``hours`` block the row's interval? Strict: of proper intervals only."""
    s, e = M.minute_of("start_time"), M.minute_of("end_time")
    return M.any_covered(hours, s, e) if strict else M.covered(hours, s) | M.covered(hours, e - 1)


def first_blocker(firsts: Column, strict: bool) -> Column:
    """The least id among the proper intervals of ``firsts`` that block the row's interval. Strict: of proper intervals only."""
    s, e = M.minute_of("start_time"), M.minute_of("end_time")
    if strict:
        return F.when(s < e, F.least(M.first_at(firsts, s), M.first_start(firsts, s + 1, e)))
    return F.least(M.first_at(firsts, s), M.first_at(firsts, e - 1))


def proper() -> Column:
    return F.col("start_time") < F.col("end_time")


def spans(bookings: DataFrame, prefix: str, id_col: str = "id") -> DataFrame:
    """One row per hour bucket touched by each booking's [min(start,end), max(start,end)] span."""
    lo = hour_of(F.least("start_time", "end_time"))
    hi = hour_of(F.greatest("start_time", "end_time"))
    return bookings.select(
        "court_id", "booking_date",
        F.col(id_col).alias(f"{prefix}id"), F.col("start_time").alias(f"{prefix}s"),
        F.col("end_time").alias(f"{prefix}e"), lo.alias(f"{prefix}lo"),
        F.explode(_hours(lo, hi)).alias("bucket"))


def conflict_test(e_s: Column, e_e: Column, n_s: Column, n_e: Column, strict: bool) -> Column:
    """Does existing booking e block new booking n?

    Faithful (default): the reference's test — e contains n's start, or e
    contains n's end — which misses an e lying strictly inside n.
    ``strict``: full interval overlap.
    """
    if strict:
        return (e_s < n_e) & (e_e > n_s)
    return ((e_s <= n_s) & (e_e > n_s)) | ((e_s < n_e) & (e_e >= n_e))


def blocked_rows(later: DataFrame, earlier: DataFrame, strict: bool = False, ordered: bool = False,
                 later_id: str = "id", earlier_id: str = "id") -> DataFrame:
    """Ids of ``later`` rows that some row of ``earlier`` blocks — an existence test.

    A conditional LEFT SEMI join on (court, date, hour bucket): for each later
    row the join stops at the first blocking match, so no pair list is ever
    built, even when one court-hour is very busy.
    """
    b = spans(later, "b_", later_id)
    a = spans(earlier, "a_", earlier_id).withColumnRenamed("bucket", "a_bucket") \
        .withColumnRenamed("court_id", "a_court").withColumnRenamed("booking_date", "a_date")
    cond = [b["court_id"] == a["a_court"], b["booking_date"] == a["a_date"], b["bucket"] == a["a_bucket"],
            conflict_test(a["a_s"], a["a_e"], b["b_s"], b["b_e"], strict)]
    if ordered:
        cond.append(a["a_id"] < b["b_id"])
    return b.join(a, cond, "left_semi").select(F.col("b_id").alias(later_id)).distinct()


def booking_conflicts(t: Tables, strict: bool = False) -> DataFrame:
    """(court_id, booking_date, first_id, later_id): each confirmed booking that an earlier confirmed one of its court
    and date blocks (under the reference's test, or overlaps when ``strict``), with the first such booking."""
    conf = t.bookings.filter(F.col("booking_status") == CONFIRMED).select(*M.DAY, "start_time", "end_time", "id")
    met = conf.join(M.first_covers(conf, "id", starts=strict), list(M.DAY))
    found = met.select(*M.DAY, first_blocker(F.col("firsts"), strict).alias("first_id"), F.col("id").alias("later_id"))
    if strict:
        found = found.unionByName(_odd_conflicts(conf)).groupBy(*M.DAY, "later_id").agg(F.min("first_id").alias("first_id"))
    return found.filter(F.col("first_id") < F.col("later_id")).select(*M.DAY, "first_id", "later_id")


def _odd_conflicts(conf: DataFrame) -> DataFrame:
    """The first overlaps, under the strict test, of pairs of which one interval at least is not proper.

    Both sides are reduced to distinct intervals with their least id, a number bounded by the 'HH:MM' grid.
    """
    interval = [*M.DAY, "start_time", "end_time"]
    distinct = conf.groupBy(*interval).agg(F.min("id").alias("id"))
    out = []
    for first, later in ((~proper(), F.lit(True)), (proper(), ~proper())):
        a, b = spans(distinct.filter(first), "a_"), spans(distinct.filter(later), "b_").withColumnsRenamed({"b_s": "start_time", "b_e": "end_time"})
        met = a.join(b, [*M.DAY, "bucket"]).filter(conflict_test(F.col("a_s"), F.col("a_e"), F.col("start_time"), F.col("end_time"), True))
        out.append(met.groupBy(*interval).agg(F.min("a_id").alias("first_id")))
    return conf.join(out[0].unionByName(out[1]), interval).select(*M.DAY, "first_id", F.col("id").alias("later_id"))
