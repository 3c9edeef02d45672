"""Owner reports from the stored daily aggregate equal those from the bookings, also after a refresh of the changed days."""

import datetime as dt
import random
import re

import pytest

from slotwise.operators import daily as DY
from slotwise.operators import reports as R
from tests import hand as H

AS_OF = "2001-06-15 12:30:00"
BOUNDARY = dt.date(2001, 5, 16)  # 30 days before as_of: bookings of that morning are out, those of the afternoon in

REPORTS = {
    "monthly": lambda t: R.owner_monthly_earnings(t),
    "yearly": lambda t: R.owner_yearly_sales(t, AS_OF),
    "daily": lambda t: R.owner_daily_sales(t, AS_OF),
    "today": lambda t: R.owner_today_sales(t, AS_OF),
    "weekday": lambda t: R.owner_weekday_trend(t, AS_OF),
    "headline": lambda t: R.owner_sales_headline(t, AS_OF),
    "headline of the calendar": lambda t: R.owner_sales_headline(t, AS_OF, calendar=True),
    "charts": lambda t: R.sales_chart_series(t, AS_OF),
    "demand": lambda t: R.court_demand(t),
    "bands": lambda t: R.demand_split(t),
}


def booking(rng, i, **kw):
    created = dt.datetime(2001, 4, 1) + dt.timedelta(days=rng.randrange(80), hours=rng.randrange(24), minutes=rng.randrange(60))
    if i % 5 == 0:
        created = dt.datetime(2001, 5, 16, rng.choice([9, 12, 15]), rng.choice([0, 30, 45]))
    return H.booking(i, **{"court_id": rng.choice([1, 1, 1, 2, 3, 9]), "date": f"2001-07-{rng.randint(1, 28):02d}", "created_at": created,
                           "total_amount": H.m(rng.randint(0, 9999) / 100), "booking_status": rng.choice(["confirmed", "confirmed", "cancelled"])} | kw)


def tables(spark, rows):
    return H.tables(spark, bookings=rows, courts=[H.court(1), H.court(2, owner_id=2), H.court(3, owner_id=2), H.court(4), H.court(9, owner_id=None)],
                    court_owners=[H.owner(1, 1), H.owner(2, 2), H.owner(3, 3)])


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    return [booking(rng, i) for i in range(400)] + [booking(rng, 1000, created_at=None), booking(rng, 1001, created_at=H.ts("2001-06-15"))]


def equal(t, summed):
    for name, report in REPORTS.items():
        assert sorted(map(str, report(summed).collect())) == sorted(map(str, report(t).collect())), name


def test_reports_equal_those_of_the_bookings(spark, rows, tmp_path):
    t = tables(spark, rows)
    DY.build(t, str(tmp_path / "d"))
    equal(t, DY.with_daily(t, str(tmp_path / "d"), whole_days=[BOUNDARY]))


def test_refresh_equals_a_full_build(spark, rows, tmp_path):
    """Late bookings, cancelled ones, one without a created time, and a day on which nothing is left."""
    path, rng = str(tmp_path / "d"), random.Random(9)
    DY.build(tables(spark, rows), path)
    before = {str(f) + str(f.stat().st_mtime_ns) for f in (tmp_path / "d").rglob("*.parquet")}
    empty = dt.date(2001, 5, 16)
    changed = [r | {"booking_status": "cancelled"} if r["id"] % 40 == 1 or r["id"] == 1000 or (r["created_at"] and r["created_at"].date() == empty) else r
               for r in rows]
    late = [booking(rng, 2000 + 7 * i + 1, created_at=H.ts("2001-04-%02d" % (1 + i))) for i in range(6)]
    t = tables(spark, changed + late)
    touched = [r["id"] for r, s in zip(changed, rows) if r != s] + [r["id"] for r in late]
    DY.refresh(t, path, DY.changed_days(t.bookings, spark.createDataFrame([(i,) for i in touched], "id long")))
    DY.build(t, str(tmp_path / "whole"))
    assert sorted(map(str, DY.read(spark, path).collect())) == sorted(map(str, DY.read(spark, str(tmp_path / "whole")).collect()))
    after = {str(f) + str(f.stat().st_mtime_ns) for f in (tmp_path / "d").rglob("*.parquet")}
    assert before & after and before - after  # other days keep their files
    equal(t, DY.with_daily(t, path, whole_days=[BOUNDARY]))
    DY.refresh(t, path, spark.createDataFrame([], "created_day date"))
    assert sorted(map(str, DY.read(spark, path).collect())) == sorted(map(str, DY.read(spark, str(tmp_path / "whole")).collect()))


def test_refresh_bounds_reach_the_scan(spark, rows, tmp_path):
    t = tables(spark, rows)
    DY.build(t, str(tmp_path / "d"))
    t.bookings.write.parquet(str(tmp_path / "b"))
    stored = spark.read.parquet(str(tmp_path / "b"))
    seen, real = [], DY.cut
    try:
        DY.cut = lambda df: seen.append(df._jdf.queryExecution().executedPlan().toString()) or real(df)
        DY.refresh(t.replace(bookings=stored), str(tmp_path / "d"), spark.createDataFrame([(dt.date(2001, 4, 3),)], "created_day date"))
    finally:
        DY.cut = real
    pushed = re.search(r"PushedFilters: \[([^\]]*)", seen[0])[1]
    assert "GreaterThanOrEqual(created_at" in pushed, pushed
