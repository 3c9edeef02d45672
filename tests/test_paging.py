"""Order of listings and reports, pages by cursor, the page directory and the widening top-n."""

import re

import pytest

from slotwise.operators import listings as L
from slotwise.operators import quality as Q
from slotwise.operators import reports as R
from slotwise.operators import search as S
from tests import hand as H
from tests.test_plans import plan, stored  # noqa: F401  the fixture of tables stored by date

AS_OF = "2001-06-15 12:00:00"


@pytest.fixture(scope="module")
def t(spark):
    """Courts, users and bookings with equal and missing times, idle courts and bookings without court or user."""
    times = [H.ts("2001-01-0%d" % (1 + i % 4)) if i % 7 else None for i in range(40)]
    courts = [H.court(i, owner_id=1 + i % 2, created_at=times[i], is_active=int(i % 5 > 0)) for i in range(12)]
    users = [H.user(i, created_at=times[i]) for i in range(1, 10)]
    rows = [H.booking(i, court_id=i % 14, user_id=i % 11, date="2001-06-%02d" % (1 + i % 9), start="%02d:00" % (8 + i % 5),
                      end="%02d:00" % (9 + i % 5), created_at=H.ts("2001-06-%02d" % (1 + i % 13)),
                      booking_status="confirmed" if i % 4 else "cancelled") for i in range(300)]
    return H.tables(spark, courts=courts, users=users, bookings=rows, court_owners=[H.owner(1, 1), H.owner(2, 2)],
                    payouts=[H.row("payouts", id=i, owner_id=1 + i % 2, amount=H.m(i), created_at=times[i]) for i in range(20)],
                    promotions=[H.row("promotions", id=i, code=f"C{i}", created_at=times[i]) for i in range(15)],
                    reviews=[H.row("reviews", id=1, court_id=3, rating=4)])


LISTINGS = {
    "court_search": (lambda t, **k: S.court_search(t, **k), ["created_at"]),
    "owner_court_search": (lambda t, **k: S.owner_court_search(t, **k), ["created_at"]),
    "admin_courts": (lambda t, **k: L.admin_courts(t, **k), ["created_at"]),
    "admin_bookings": (lambda t, **k: L.admin_bookings(t, **k), ["created_at"]),
    "payout_list": (lambda t, **k: L.payout_list(t, **k), ["created_at"]),
    "promotion_list": (lambda t, **k: L.promotion_list(t, **k), ["created_at"]),
    "users_with_booking_count": (lambda t, **k: R.users_with_booking_count(t, **k), ["created_at"]),
    "owner_court_rollup": (lambda t, **k: R.owner_court_rollup(t, **k), ["created_at"]),
    "user_bookings": (lambda t, **k: L.user_bookings(t, **k), ["booking_date", "start_time"]),
    "owner_bookings": (lambda t, **k: L.owner_bookings(t, **k), ["booking_date", "start_time"]),
}


@pytest.mark.parametrize("name", LISTINGS)
def test_newest_first_and_pages_by_cursor(t, name):
    run, keys = LISTINGS[name]
    rows = run(t).collect()
    place = lambda r: [*[r[k] for k in keys], r["id"]]
    newest = sorted(rows, key=lambda r: r["id"], reverse=True)
    for k in reversed(keys):  # newest first, nulls last
        newest.sort(key=lambda r: (r[k] is not None, r[k] or H.ts("1900-01-01") if k == "created_at" else r[k]), reverse=True)
    assert len(rows) > 8 and [r["id"] for r in rows] == [r["id"] for r in newest]
    pages, after = [], None
    size = max(3, len(rows) // 3)
    while page := run(t, after=after, limit=size).collect():
        pages += page
        after = place(page[-1])
    assert [r["id"] for r in pages] == [r["id"] for r in rows]
    with pytest.raises(ValueError, match="cursor"):
        run(t, after=[1])


def test_a_page_is_a_top_n_with_the_cursor_at_the_scan(spark, stored):  # noqa: F811
    from slotwise.catalog import T

    text = plan(L.admin_bookings(T(spark, stored), after=(H.ts("2001-06-01"), 10), limit=10))
    assert "TakeOrderedAndProject" in text and "rangepartitioning" not in text
    assert "LessThan(created_at,2001-06-01" in text


def test_reports_are_in_order(t):
    months = [(r.owner_id, r.month) for r in R.owner_monthly_earnings(t).collect()]
    assert months == sorted(months, key=lambda x: (x[0], [-ord(c) for c in x[1]]))
    for rows, key in ((R.owner_yearly_sales(t, AS_OF), "month_num"), (R.owner_daily_sales(t, AS_OF), "day"), (R.owner_weekday_trend(t, AS_OF), "day_of_week")):
        got = [(r["owner_id"], r[key]) for r in rows.collect()]
        assert got and got == sorted(got)
    demand = [(r.owner_id, -r.bookings, r.court_id) for r in R.court_demand(t).collect()]
    assert demand == sorted(demand)


def history(t, newest=True):
    courts, users = {r.id: r.owner_id for r in t.courts.collect()}, {r.id for r in t.users.collect()}
    out = {}
    for r in t.bookings.collect():
        if courts.get(r.court_id) and r.user_id in users:
            out.setdefault(courts[r.court_id], []).append((r.booking_date, r.start_time, r.id))
    return {o: [x[2] for x in sorted(rows, reverse=newest)] for o, rows in out.items()}


@pytest.mark.parametrize("page, size", [(1, 10), (2, 10), (3, 7), (101, 1), (40, 10)])
def test_any_page_equals_the_slice_of_the_history(t, page, size):
    for sort in ("newest", "oldest"):
        got = {}
        for r in R.booking_history_page(t, page, sort, size).collect():
            got.setdefault(r.owner_id, set()).add(r.id)
        want = {o: set(ids[(page - 1) * size:page * size]) for o, ids in history(t, sort == "newest").items()}
        assert got == {o: ids for o, ids in want.items() if ids}


def test_every_page_has_the_same_lazy_plan(spark, stored):  # noqa: F811
    from slotwise.catalog import T

    def shape(n):
        lines = R.booking_history_page(T(spark, stored), n)._jdf.queryExecution().optimizedPlan().toString().splitlines()
        return [re.match(r"[ :+-]*(\w+)", ln)[1] for ln in lines]

    assert shape(1) == shape(101)
    assert "dynamicpruning" in plan(R.booking_history_page(T(spark, stored), 101))


def test_recent_bookings_of_an_owner_are_ranked_narrow(spark, stored):  # noqa: F811
    from slotwise.catalog import T

    text = R.owner_recent_bookings(T(spark, stored))._jdf.queryExecution().optimizedPlan().toString()
    window = text[text.index("Window ["):]
    window = window[:window.index("\n")] + text[text.index("Window ["):][len(window[:window.index("\n")]):].split("Join", 1)[0]
    assert "notes" not in window and "total_amount" not in window and "start_time" not in window


@pytest.mark.parametrize("orphans", [0, 5, 500])
def test_recent_bookings_widen_past_orphans(spark, orphans):
    rows = [H.booking(i, created_at=H.ts("2001-01-01"), user_id=1) for i in range(25)]
    rows += [H.booking(1000 + i, created_at=H.ts("2002-01-01"), user_id=77) for i in range(orphans)]
    t = H.tables(spark, bookings=rows, users=[H.user(1)], courts=[H.court(1)])
    assert [r.id for r in L.recent_bookings(t, 10).collect()] == list(range(24, 14, -1))
    assert [r.id for r in L.recent_bookings(t.replace(users=t.users.limit(0)), 10).collect()] == []
    assert [r.id for r in L.recent_bookings(t, 40).collect()] == list(range(24, -1, -1))


def test_foreign_keys_are_audited_in_few_shuffles(spark, stored):  # noqa: F811
    from slotwise.catalog import T

    df = Q.audit_foreign_keys(T(spark, stored))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan_text = Q.audit_foreign_keys(T(spark, stored))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")
    assert plan_text.count("Exchange hashpartitioning") <= 3 and df.count() == 0
