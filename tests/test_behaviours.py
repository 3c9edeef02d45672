"""Hand tables for the behaviour register: each quirk kept by default, corrected behind a flag."""

from pyspark.sql import functions as F

from slotwise.operators import changes as CH
from slotwise.operators import intervals as I
from slotwise.operators import reports as R
from slotwise.operators import search as S
from slotwise.operators import vouchers as VO
from tests import hand as H

AS_OF = "2001-06-15 12:00:00"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_q1_popular_courts_fan_out(spark):
    t = H.tables(spark, courts=[H.court(1), H.court(2)], court_owners=[H.owner(1, 10)],
                 bookings=[H.booking(1), H.booking(2, start="12:00", end="13:00"), H.booking(3, court_id=2)],
                 reviews=[H.row("reviews", id=i, court_id=1, user_id=1, booking_id=1, rating=r) for i, r in
                          ((1, 5), (2, 4), (3, 3))])
    assert rows(R.popular_courts(t), "court_id", "booking_count") == [(1, 6), (2, 1)]
    assert rows(R.popular_courts(t, distinct=True), "court_id", "booking_count") == [(1, 2), (2, 1)]
    assert rows(R.popular_courts(t), "court_id", "avg_rating")[0] == (1, 4.0)


def test_q2_nested_booking_missed_by_faithful_test(spark):
    t = H.tables(spark, bookings=[H.booking(1, start="10:00", end="11:00"), H.booking(2, start="09:00", end="12:00"),
                                  H.booking(3, start="10:30", end="11:30")])
    assert rows(I.booking_conflicts(t), "first_id", "later_id") == [(1, 3)]
    assert rows(I.booking_conflicts(t, strict=True), "first_id", "later_id") == [(1, 2), (1, 3)]


def test_q3_slots_test_only_the_start_and_drop_minutes(spark):
    t = H.tables(spark, courts=[H.court(1, open_time="06:30", close_time="09:00", is_active=0)],
                 bookings=[H.booking(1, start="06:30", end="07:30"),
                           H.booking(2, start="08:00", end="09:00", booking_status="cancelled")])
    got = rows(I.available_slots(t, "2001-06-15"), "start_time", "end_time")
    assert got == [("06:00", "07:00"), ("08:00", "09:00")]


def test_q4_demand_split_double_arithmetic(spark):
    courts = [H.court(i) for i in range(1, 11)]
    bookings = [H.booking(100 + i, court_id=i, start=f"{6 + j:02d}:00", end=f"{7 + j:02d}:00")
                for i in range(1, 11) for j in range(i)]
    t = H.tables(spark, courts=courts, bookings=bookings)
    out = R.demand_split(t)
    high = rows(out.filter("band = 'high'"), "position", "court_id")
    low = rows(out.filter("band = 'low'"), "position", "court_id")
    assert len(high) == 3 and high[0] == (1, 10)          # top ceil(10 * 0.3)
    assert len(low) == 7 and low[0] == (1, 1)             # bottom ceil(10 * 0.7), listed from the bottom
    assert {c for _, c in high} & {c for _, c in low} == set()


def test_q5_voucher_end_date(spark):
    t = H.tables(spark, promotions=[H.row("promotions", id=1, code="END", title="t", discount_type="fixed",
                                          discount_value=H.m(5), start_date=H.d("2001-01-01"),
                                          end_date=H.d("2001-06-15"), is_active=1, usage_limit=-1, used_count=0,
                                          target_type="all")])
    req = spark.createDataFrame([(1, 7, "end", H.m(100), H.ts("2001-06-15 00:00:00")),
                                 (2, 7, "end", H.m(100), H.ts("2001-06-15 12:00:00"))],
                                "request_id long, user_id long, code string, booking_amount decimal(12,2), "
                                "requested_at timestamp_ntz")
    assert rows(VO.validate_vouchers(t, req), "request_id", "reason") == [(1, None), (2, "Voucher is not active")]
    assert VO.available_vouchers(t, "2001-06-15", user_id=7).count() == 1


def test_discount_caps_and_no_floor(spark):
    promos = [H.row("promotions", id=i, code=f"P{i}", title="t", discount_type=tp, discount_value=H.m(v),
                    max_discount_amount=None if cap is None else H.m(cap), start_date=H.d("2001-01-01"),
                    end_date=H.d("2002-01-01"), is_active=1, usage_limit=-1, used_count=0, target_type="all")
              for i, tp, v, cap in ((1, "percentage", 50, 20), (2, "percentage", 50, 0), (3, "percentage", 50, None),
                                    (4, "fixed", 150, None))]
    t = H.tables(spark, promotions=promos, courts=[H.court(1, hourly_rate=H.m(10))])
    req = spark.createDataFrame([(i, 7, f"p{i}", H.m(100), H.ts("2001-06-01")) for i in range(1, 5)],
                                "request_id long, user_id long, code string, booking_amount decimal(12,2), "
                                "requested_at timestamp_ntz")
    got = rows(VO.validate_vouchers(t, req), "request_id", "discount_amount", "final_amount")
    assert got == [(1, 20.0, 80.0), (2, 50.0, 50.0), (3, 50.0, 50.0), (4, 150.0, 0.0)]
    price = spark.createDataFrame([(1, 1, 1, "P4", H.m(15))], "request_id long, court_id long, total_hours int, "
                                                              "voucher_code string, discount_amount decimal(12,2)")
    assert rows(VO.price_bookings(t, price), "total_amount") == [(-5.0,)]


def test_q6_left_join_repeats_all_promotions(spark):
    p = H.row("promotions", id=1, code="A", title="t", discount_type="fixed", discount_value=H.m(5),
              start_date=H.d("2001-01-01"), end_date=H.d("2002-01-01"), is_active=1, target_type="all")
    targets = [H.row("promotion_targets", id=i, promotion_id=1, user_id=i) for i in (1, 2)]
    t = H.tables(spark, promotions=[p], promotion_targets=targets)
    assert VO.available_vouchers(t, "2001-06-01", user_id=9).count() == 2
    assert VO.available_vouchers(t, "2001-06-01", user_id=9, distinct=True).count() == 1


def test_q13_payout_of_any_status_and_hold(spark):
    t = H.tables(spark, courts=[H.court(1)], court_owners=[H.owner(1, 10)],
                 bookings=[H.booking(1, date="2001-06-01", created_at=H.ts("2001-05-01")),
                           H.booking(2, date="2001-06-02", created_at=H.ts("2001-05-20")),
                           H.booking(3, date="2001-06-10", created_at=H.ts("2001-05-21"))],
                 payouts=[H.row("payouts", id=1, owner_id=1, amount=H.m(1), status="failed",
                                created_at=H.ts("2001-05-10"))])
    got = R.pending_payouts(t, AS_OF).collect()
    assert len(got) == 1 and got[0]["pending_amount"] == 8.0     # booking 2 only (1 precedes payout, 3 on hold)


def test_q15_headline_sums_all_years_and_calendar_flag(spark):
    t = H.tables(spark, courts=[H.court(1)], court_owners=[H.owner(1, 10)],
                 bookings=[H.booking(1, created_at=H.ts("2000-03-01"), total_amount=H.m(100)),
                           H.booking(2, created_at=H.ts("2001-05-01"), total_amount=H.m(50),
                                     start="12:00", end="13:00")])
    plain = R.owner_sales_headline(t, AS_OF).collect()[0]
    assert (plain["annual_sales"], plain["current_month_sales"]) == (120.0, 40.0)
    cal = R.owner_sales_headline(t, AS_OF, calendar=True).collect()[0]
    assert (cal["annual_sales"], cal["current_month_sales"]) == (40.0, 0.0)


def test_q16_slots_with_gaps(spark):
    courts = H.tables(spark, courts=[H.court(1, hourly_rate=H.m(15))]).courts
    slots = spark.createDataFrame([(1, 1, H.d("2001-06-15"), "08:00"), (1, 1, H.d("2001-06-15"), "10:00")],
                                  "request_id long, court_id long, booking_date date, slot string")
    r = CH.slots_to_booking(slots, courts).collect()[0]
    assert (r["start_time"], r["end_time"], r["total_hours"], r["amount"]) == ("08:00", "11:00", 2, 30.0)


def test_search_filters_and_profile_completeness(spark):
    t = H.tables(spark, courts=[H.court(1, address="Jalan Ampang", has_ac=1), H.court(2, is_approved=0),
                                H.court(3, address="Bangsar")],
                 court_owners=[H.owner(1, 10, business_address="Kuala Lumpur", business_phone="1",
                                       business_email="", bank_name="b")])
    assert rows(S.court_search(t, location="AMPANG"), "id") == [(1,)]
    assert rows(S.court_search(t, location="lumpur"), "id") == [(1,), (3,)]
    assert rows(S.court_search(t, has_ac=True), "id") == [(1,)]
    prof = S.owner_profile_complete(t).collect()[0]
    assert not prof["complete"] and prof["missing"][:2] == ["business_email", "bank_account_number"]


def test_cancel_lead_time_and_ownership(spark):
    t = H.tables(spark, bookings=[H.booking(1, user_id=5, date="2001-06-15", start="13:30"),
                                  H.booking(2, user_id=5, date="2001-06-15", start="14:00")])
    req = spark.createDataFrame([(1, 1, 5), (2, 2, 5), (3, 2, 6)], "request_id long, booking_id long, user_id long")
    out = CH.cancel_bookings(t, req, AS_OF)
    assert rows(out.rejected, "request_id", "reason") == [
        (1, "Cannot cancel booking within 2 hours of start time"), (3, "Booking not found")]
    assert rows(out.table, "id", "booking_status") == [(1, "confirmed"), (2, "cancelled")]


def test_merge_updates_can_write_null_and_last_wins(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    ch = spark.createDataFrame([(1, None, 1), (2, "x", 1), (2, "y", 2)], "id long, v string, o long")
    assert rows(CH.merge_updates(df, ch, "id", ["v"], order="o"), "id", "v") == [(1, None), (2, "y")]


def test_insert_or_ignore_keeps_first_in_batch(spark):
    from slotwise.sources.tables import insert_or_ignore
    base = spark.createDataFrame([(1, "a")], "id long, username string")
    new = spark.createDataFrame([(3, "b"), (2, "b"), (4, "a")], "id long, username string")
    assert rows(insert_or_ignore(base, new, [["username"]]), "id") == [(1,), (2,)]


def test_audits_find_violations(spark):
    from slotwise.operators import quality as Q
    t = H.tables(spark, users=[H.user(1), H.user(2, username="u1")],
                 reviews=[H.row("reviews", id=1, court_id=9, user_id=1, booking_id=None, rating=7)])
    assert rows(Q.audit_unique(t), "column", "value", "n") == [("username", "u1", 2)]
    assert rows(Q.audit_check(t), "rule", "id") == [("rating_between_1_and_5", 1)]
    assert rows(Q.audit_foreign_keys(t), "child", "column", "missing_key") == [("reviews", "court_id", 9)]
    assert F is not None


def test_eligible_vouchers_multiplicity_and_minimum(spark):
    base = dict(title="t", discount_type="fixed", discount_value=H.m(5), start_date=H.d("2001-01-01"),
                end_date=H.d("2001-12-31"), is_active=1, usage_limit=-1, used_count=0)
    promos = [H.row("promotions", id=1, code="ALL", target_type="all", **base),
              H.row("promotions", id=2, code="SPEC", target_type="specific", **base),
              H.row("promotions", id=3, code="MIN", target_type="all", min_booking_amount=H.m(500), **base)]
    targets = [H.row("promotion_targets", id=i, promotion_id=p, user_id=u) for i, p, u in
               ((1, 1, 8), (2, 1, 9), (3, 2, 7))]
    t = H.tables(spark, promotions=promos, promotion_targets=targets)
    req = spark.createDataFrame([(1, 7, H.d("2001-06-01"), H.m(100)), (2, 8, H.d("2002-06-01"), H.m(900)),
                                 (3, 9, H.d("2001-02-01"), H.m(600))],
                                "request_id long, user_id long, booking_date date, booking_amount decimal(12,2)")
    out = VO.eligible_vouchers(t, req)
    assert rows(out.filter("request_id IS NULL"), "day", "id", "copies") == [
        (H.d("2001-02-01"), 1, 2), (H.d("2001-02-01"), 3, 1), (H.d("2001-06-01"), 1, 2), (H.d("2001-06-01"), 3, 1)]
    assert rows(out.filter("request_id IS NOT NULL"), "request_id", "user_id", "id", "copies") == [(1, 7, 2, 1)]


def test_court_form_flags_follow_js_truthiness(spark):
    t = H.tables(spark, courts=[H.court(1)], court_owners=[H.owner(1, 10)], users=[H.user(10, role="owner")])
    req = spark.createDataFrame(
        [(1, None, 10, "A", "addr", H.m(20), "on", "0", "", None)],
        "request_id long, id long, user_id long, name string, address string, hourly_rate decimal(12,2), "
        "has_ac string, has_food string, has_parking string, court_type string")
    out = CH.upsert_courts(t, req)
    row = out.courts.filter("name = 'A'").collect()[0]
    assert (row["has_ac"], row["has_food"], row["has_parking"]) == (1, 1, 0)
    assert (row["court_type"], row["indoor_outdoor"], row["open_time"], row["close_time"]) == \
        ("synthetic", "indoor", "06:00", "22:00")
    assert (row["is_active"], row["is_approved"], row["owner_id"], row["id"]) == (1, 0, 1, 2)
