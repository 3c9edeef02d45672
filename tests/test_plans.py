"""Plan shape: what Catalyst must do for these operators to hold at scale."""

import contextlib
import io
import re
import tempfile

import pytest

from slotwise.catalog import QUERIES, T
from slotwise.operators import intervals as I
from slotwise.operators import reports as R
from slotwise.sources import fixtures as FX

# queries whose plan builds a checkpoint eagerly (they run jobs while planning); checked separately
NAMES = sorted(QUERIES)


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


@pytest.fixture(scope="module")
def stored(spark, small_dir):
    out = tempfile.mkdtemp(prefix="slotwise-plan-")
    FX.materialize(spark, small_dir, out, names=tuple(FX.VIEWS))
    return out


@pytest.mark.parametrize("name", NAMES)
def test_no_cartesian_or_nested_loop_join(spark, stored, name):
    text = plan(QUERIES[name](spark, stored))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


def test_filters_and_columns_reach_the_scan(spark, stored):
    text = plan(R.monthly_revenue(T(spark, stored)))
    assert "PushedFilters: [IsNotNull(payment_status), EqualTo(payment_status,paid)]" in text
    scan = [ln for ln in text.splitlines() if ln.startswith("ReadSchema")]
    assert scan and all("user_id" not in ln and "start_time" not in ln for ln in scan)


def test_slots_prune_booking_partitions(spark, stored):
    text = plan(I.available_slots(T(spark, stored), "2001-06-15"))
    assert "PartitionFilters: [isnotnull(booking_date" in text and "2001-06-15" in text


def test_top_k_is_limited_before_the_shuffle(spark, stored):
    text = plan(R.owner_recent_bookings(T(spark, stored)))
    assert "WindowGroupLimit" in text


def test_owner_reports_aggregate_before_joining_courts(spark, stored):
    text = plan(R.owner_monthly_earnings(T(spark, stored)))
    # formatted plans number operators from the scans upwards: the partial sum comes before any join
    details = text[text.index("partial_sum"):]
    partial = min(int(n) for n, kind in re.findall(r"\((\d+)\) (HashAggregate|ObjectHashAggregate)", text))
    joins = [int(n) for n, kind in re.findall(r"\((\d+)\) (\w*Join)\b", text)]
    assert details and joins and partial < min(joins)


def test_period_reports_push_both_bounds(spark, stored):
    for df in (R.owner_yearly_sales(T(spark, stored), "2001-06-15 12:00:00"), R.owner_daily_sales(T(spark, stored), "2001-06-15 12:00:00")):
        text = plan(df)
        assert "GreaterThanOrEqual(created_at," in text and "LessThan(created_at," in text


def test_sales_headline_scans_bookings_once(spark, stored):
    text = plan(R.owner_sales_headline(T(spark, stored), "2001-06-15 12:00:00"))
    assert len(re.findall(r"Location: InMemoryFileIndex \[[^]]*/bookings", text)) == 1
