"""admit_bookings against a plain sequential loop (the reference's one-POST-at-a-time behaviour)."""

from collections import defaultdict

import pytest

from slotwise.operators import changes as CH
from slotwise.sources.fixtures import Fixture
from tests import hand as H


def blocks(es, ee, ns, ne, strict):
    if strict:
        return es < ne and ee > ns
    return (es <= ns and ee > ns) or (es < ne and ee >= ne)


def sequential(bookings, courts, requests, strict):
    visible = {c["id"] for c in courts if c["is_active"] == 1 and c["is_approved"] == 1}
    taken = defaultdict(list)
    for b in bookings:
        if b["booking_status"] == "confirmed":
            taken[(b["court_id"], b["booking_date"])].append((b["start_time"], b["end_time"]))
    out = {}
    for r in sorted(requests, key=lambda r: r["request_id"]):
        fields = [r["court_id"], r["booking_date"], r["start_time"], r["end_time"], r["total_hours"]]
        if any(f is None or f == "" or f == 0 for f in fields):
            out[r["request_id"]] = "Missing required fields"
            continue
        if r["court_id"] not in visible:
            out[r["request_id"]] = "Court not found or not available"
            continue
        key = (r["court_id"], r["booking_date"])
        if any(blocks(es, ee, r["start_time"], r["end_time"], strict) for es, ee in taken[key]):
            out[r["request_id"]] = "Time slot is already booked"
            continue
        taken[key].append((r["start_time"], r["end_time"]))
        out[r["request_id"]] = None
    return out


def run(spark, t, requests, strict):
    res = CH.admit_bookings(t, requests, strict=strict)
    got = {r["request_id"]: r["reason"] for r in res.rejected.collect()}
    n_acc = res.bookings.count()
    return got, n_acc


@pytest.mark.parametrize("strict", [False, True])
def test_matches_sequential_loop_on_fixture(spark, small_dir, strict):
    fx = Fixture(spark, small_dir)
    t = fx.tables()
    req = fx.view("booking_requests")
    want = sequential([r.asDict() for r in t.bookings.collect()], [r.asDict() for r in t.courts.collect()],
                      [r.asDict() for r in req.collect()], strict)
    got, n_acc = run(spark, t, req, strict)
    assert got == {k: v for k, v in want.items() if v is not None}
    assert n_acc == sum(v is None for v in want.values())


def test_hand_cases_nested_twins_inverted(spark):
    t = H.tables(spark, courts=[H.court(1), H.court(2, is_approved=0)],
                 bookings=[H.booking(1, start="10:00", end="11:00")])
    rows = [
        (1, 1, "09:00", "12:00"),   # contains the existing booking: faithful test misses it
        (2, 1, "09:00", "12:00"),   # twin of 1
        (3, 1, "12:00", "13:00"),   # free
        (4, 1, "12:30", "12:45"),   # inside 3
        (5, 1, "14:00", "14:00"),   # empty interval
        (6, 1, "15:00", "14:00"),   # inverted
        (7, 2, "10:00", "11:00"),   # court not approved
        (8, 1, "14:00", "15:00"),   # after the empty one
    ]
    req = spark.createDataFrame(
        [(i, c, H.d("2001-06-15"), s, e, 1, 7) for i, c, s, e in rows],
        "request_id long, court_id long, booking_date date, start_time string, end_time string, "
        "total_hours int, user_id long")
    for strict in (False, True):
        want = sequential([r.asDict() for r in t.bookings.collect()], [r.asDict() for r in t.courts.collect()],
                          [r.asDict() for r in req.collect()], strict)
        got, _ = run(spark, t, req, strict)
        assert got == {k: v for k, v in want.items() if v is not None}, strict
    got, _ = run(spark, t, req, False)
    assert 1 not in got and got[2] == "Time slot is already booked"


def test_new_rows_are_priced_and_numbered(spark):
    t = H.tables(spark, courts=[H.court(1, hourly_rate=H.m(20))], bookings=[H.booking(41, start="08:00", end="09:00")])
    req = spark.createDataFrame(
        [(1, 1, H.d("2001-06-15"), "10:00", "12:00", 2, 7, "V1", H.m(5), "x" * 300)],
        "request_id long, court_id long, booking_date date, start_time string, end_time string, total_hours int, "
        "user_id long, voucher_code string, discount_amount decimal(12,2), notes string")
    res = CH.admit_bookings(t, req)
    row = res.bookings.collect()[0]
    assert row["id"] == 42 and float(row["total_amount"]) == 35.0 and len(row["notes"]) == 255
    assert row["booking_status"] == "confirmed" and row["payment_status"] == "pending"
    assert res.usage.count() == 1


def test_slot_selection_flows_into_admission(spark, small_dir):
    """Lifecycle C: chosen slots → booking requests → admission, against the sequential rule."""
    from pyspark.sql import functions as F

    fx = Fixture(spark, small_dir)
    t = fx.tables()
    collapsed = CH.slots_to_booking(fx.view("slot_requests"), t.courts)
    req = collapsed.select("request_id", "court_id", "booking_date", "start_time", "end_time", "total_hours",
                           F.lit(7).cast("long").alias("user_id"))
    want = sequential([r.asDict() for r in t.bookings.collect()], [r.asDict() for r in t.courts.collect()],
                      [r.asDict() for r in req.collect()], False)
    got, n_acc = run(spark, t, req, False)
    assert got == {k: v for k, v in want.items() if v is not None}
    assert n_acc == sum(v is None for v in want.values()) > 0
