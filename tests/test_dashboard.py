"""The dashboard page (one cached shared aggregate) equals the stand-alone reports, part by part."""

from slotwise.catalog import AS_OF, T
from slotwise.operators import reports as R
from slotwise.operators.dashboard import sales_dashboard
from tools.compare import compare


def test_cached_page_equals_reports(spark, small_dir):
    t = T(spark, small_dir)
    page = sales_dashboard(t, AS_OF, cache=True)
    pairs = [(page.monthly, R.owner_monthly_earnings(t)), (page.today, R.owner_today_sales(t, AS_OF)),
             (page.yearly, R.owner_yearly_sales(t, AS_OF)), (page.daily, R.owner_daily_sales(t, AS_OF)),
             (page.weekday, R.owner_weekday_trend(t, AS_OF)), (page.demand, R.court_demand(t)),
             (page.demand_bands, R.demand_split(t)), (page.recent, R.owner_recent_bookings(t, confirmed_only=True)),
             (page.chart_yearly, R.sales_chart_series(t, AS_OF)),
             (page.chart_monthly, R.sales_chart_series(t, AS_OF, period="monthly"))]
    try:
        for got, want in pairs:
            assert compare(got.toArrow(), want.toArrow()) is None
    finally:
        spark.catalog.clearCache()
