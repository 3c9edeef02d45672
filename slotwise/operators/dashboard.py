"""The owner sales dashboard: every report of the page from ONE pass over bookings.

The reference's page runs seven queries one after another, each rescanning
bookings ⋈ courts. Here confirmed bookings are reduced once to a per-court
daily aggregate — (court, created date, booking weekday, inside the trend
window) → amount, count — which is tiny next to bookings (courts × days × 7).
Monthly, yearly, daily, today's and weekday reports, court demand and the
demand bands are all roll-ups of it; only the recent-bookings list reads rows.
That shared frame is cached because several reports read it in the same job
(the one place caching pays off); on executor loss it is recomputed from
lineage like any other stage.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.functions.calendar import as_of_date, as_of_ts, day_text, month, weekday_text, year_text
from slotwise.operators.reports import CONFIRMED, OWNER_SHARE, TREND_DAYS, chart_arrays, demand_split, \
    owner_recent_bookings
from slotwise.plans.rollup import court_owner, share_of
from slotwise.sources.tables import Tables


class Dashboard(NamedTuple):
    monthly: DataFrame        # owner_id, month, earnings, bookings
    today: DataFrame          # owner_id, today_sales
    yearly: DataFrame         # owner_id, month_num, month, sales
    daily: DataFrame          # owner_id, day, sales
    weekday: DataFrame        # owner_id, day_of_week, bookings
    demand: DataFrame         # court_demand
    demand_bands: DataFrame | None   # demand_split; None unless asked for
    recent: DataFrame         # owner_recent_bookings(confirmed_only=True)
    chart_yearly: DataFrame   # sales_chart_series(period='yearly')
    chart_monthly: DataFrame  # sales_chart_series(period='monthly')
    shared: DataFrame         # the daily aggregate that the parts read; unpersist() it when cached


def _dbl(c):
    return c.cast("double")


def sales_dashboard(t: Tables, as_of, share: float = OWNER_SHARE, days: int = TREND_DAYS,
                    cache: bool = True, bands: bool = True) -> Dashboard:
    """All parts over one daily aggregate. Every part is lazy, except ``demand_bands``, whose ranking runs a job when
    it is built: pass ``bands=False`` to leave it out. With ``cache`` the aggregate is kept until ``shared.unpersist()``."""
    since = as_of_ts(as_of) - F.expr(f"INTERVAL {int(days)} DAYS")
    daily = (t.bookings.filter(F.col("booking_status") == CONFIRMED)
             .groupBy("court_id", F.to_date("created_at").alias("_day"), weekday_text("booking_date").alias("_dow"),
                      (F.col("created_at") >= since).alias("_recent"))
             .agg(F.sum("total_amount").alias("_amt"), F.count(F.lit(1)).alias("_n"))
             .join(court_owner(t), "court_id"))
    if cache:
        daily = daily.cache()
    amount = lambda: _dbl(F.coalesce(share_of(F.sum("_amt"), share), F.lit(0)))

    monthly = daily.groupBy("owner_id", month("_day").alias("month")).agg(
        amount().alias("earnings"), F.sum("_n").alias("bookings"))
    owners = t.court_owners.select(F.col("id").alias("owner_id"))
    today = owners.join(daily.filter(F.col("_day") == as_of_date(as_of)).groupBy("owner_id").agg(
        amount().alias("today_sales")), "owner_id", "left").select(
        "owner_id", F.coalesce("today_sales", F.lit(0.0)).alias("today_sales"))
    yearly = (daily.filter(year_text("_day") == year_text(as_of_ts(as_of)))
              .groupBy("owner_id", month("_day").alias("month")).agg(amount().alias("sales"))
              .select("owner_id", F.substring("month", 6, 2).alias("month_num"), "month", "sales"))
    per_day = (daily.filter(month("_day") == month(as_of_ts(as_of)))
               .groupBy("owner_id", day_text("_day").alias("day")).agg(amount().alias("sales")))
    weekday = (daily.filter(F.col("_recent")).groupBy("owner_id", F.col("_dow").alias("day_of_week"))
               .agg(F.sum("_n").alias("bookings")))
    per_court = daily.groupBy("court_id").agg(F.sum("_n").alias("_cn"), F.sum("_amt").alias("_ca"))
    owned = t.courts.filter(F.col("owner_id").isNotNull()).select("owner_id", F.col("id").alias("court_id"), "name")
    demand = owned.join(per_court, "court_id", "left").select(
        "owner_id", "court_id", "name", F.coalesce("_cn", F.lit(0)).cast("bigint").alias("bookings"),
        _dbl(F.coalesce(share_of(F.col("_ca"), share), F.lit(0))).alias("revenue"))
    charts = [chart_arrays(yearly.select("owner_id", F.col("month").alias("label"), "sales")),
              chart_arrays(per_day.select("owner_id", F.col("day").alias("label"), "sales"))]
    return Dashboard(monthly, today, yearly, per_day, weekday, demand,
                     demand_split(t, demand=demand) if bands else None,
                     owner_recent_bookings(t, confirmed_only=True), *charts, daily)
