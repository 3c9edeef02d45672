"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Each query builds the domain tables from the test parquet (``sources.fixtures``)
— or reads them back when that folder was written by ``fixtures.materialize`` —
and runs one operator over the WHOLE tables. ``oracles.oracle_sql()`` holds the
equivalent DuckDB SQL under the same name.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.operators import changes as CH
from slotwise.operators import daily as DY
from slotwise.operators import dashboard as DB
from slotwise.operators import intervals as I
from slotwise.operators import listings as L
from slotwise.operators import quality as Q
from slotwise.operators import reports as R
from slotwise.operators import search as S
from slotwise.operators import stored as ST
from slotwise.operators import vouchers as VO
from slotwise.plans.lineage import cut_stored
from slotwise.session import shared_dir
from slotwise.sources import fixtures as FX
from slotwise.sources import published as PB
from slotwise.sources import tables as TB
from slotwise.sources.fixtures import fixture

# The reference points used by the registered queries.
AS_OF = "2001-06-15 12:00:00"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def T(spark: SparkSession, sf_dir: str):
    return fixture(spark, sf_dir).tables()


def V(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return fixture(spark, sf_dir).view(name)


# ---- reports -------------------------------------------------------------
QUERIES.update({
    "monthly_revenue": lambda s, d: R.monthly_revenue(T(s, d)),
    "platform_stats": lambda s, d: R.platform_stats(T(s, d)),
    "users_with_booking_count": lambda s, d: R.users_with_booking_count(T(s, d)),
    "court_rating_summary": lambda s, d: R.court_rating_summary(T(s, d)),
    "owner_court_rollup": lambda s, d: R.owner_court_rollup(T(s, d)),
    "popular_courts": lambda s, d: R.popular_courts(T(s, d)),
    "popular_courts_distinct": lambda s, d: R.popular_courts(T(s, d), distinct=True),
    "registration_trends": lambda s, d: R.registration_trends(T(s, d)),
    "unpaid_bookings_since_payout": lambda s, d: R.unpaid_bookings_since_payout(T(s, d)),
    "pending_payouts": lambda s, d: R.pending_payouts(T(s, d), AS_OF),
    "owner_earnings_summary": lambda s, d: R.owner_earnings_summary(T(s, d)),
    "owner_monthly_earnings": lambda s, d: R.owner_monthly_earnings(T(s, d)),
    "owner_today_sales": lambda s, d: R.owner_today_sales(T(s, d), AS_OF),
    "owner_yearly_sales": lambda s, d: R.owner_yearly_sales(T(s, d), AS_OF),
    "owner_daily_sales": lambda s, d: R.owner_daily_sales(T(s, d), AS_OF),
    "owner_weekday_trend": lambda s, d: R.owner_weekday_trend(T(s, d), AS_OF),
    "owner_sales_headline": lambda s, d: R.owner_sales_headline(T(s, d), AS_OF),
    "owner_sales_headline_calendar": lambda s, d: R.owner_sales_headline(T(s, d), AS_OF, calendar=True),
    "sales_chart_series": lambda s, d: R.sales_chart_series(T(s, d), AS_OF),
    "sales_chart_series_monthly": lambda s, d: R.sales_chart_series(T(s, d), AS_OF, period="monthly"),
    "owner_history_counts": lambda s, d: R.owner_history_counts(T(s, d)),
    "deletable_courts": lambda s, d: R.deletable_courts(T(s, d)),
    "court_demand": lambda s, d: R.court_demand(T(s, d)),
    "demand_split": lambda s, d: R.demand_split(T(s, d)),
    "booking_history_page": lambda s, d: R.booking_history_page(T(s, d), page=2),
    "booking_history_page_oldest": lambda s, d: R.booking_history_page(T(s, d), page=1, sort="oldest"),
    "owner_recent_bookings": lambda s, d: R.owner_recent_bookings(T(s, d)),
    "owner_recent_bookings_confirmed": lambda s, d: R.owner_recent_bookings(T(s, d), confirmed_only=True),
    "primary_image": lambda s, d: R.primary_image(T(s, d)),
})

# ---- listings, search, intervals ------------------------------------------

SLOT_DAY = "2001-06-15"

QUERIES.update({
    "recent_bookings": lambda s, d: L.recent_bookings(T(s, d)),
    "recent_bookings_fk_checked": lambda s, d: L.recent_bookings(T(s, d), fk_checked=True),
    "pending_courts": lambda s, d: L.pending_courts(T(s, d)),
    "admin_courts": lambda s, d: L.admin_courts(T(s, d)),
    "admin_bookings": lambda s, d: L.admin_bookings(T(s, d)),
    "payout_list": lambda s, d: L.payout_list(T(s, d)),
    "user_bookings": lambda s, d: L.user_bookings(T(s, d)),
    "user_bookings_detail": lambda s, d: L.user_bookings(T(s, d), detail=True),
    "owner_bookings": lambda s, d: L.owner_bookings(T(s, d)),
    "owned_courts": lambda s, d: L.owned_courts(T(s, d)),
    "promotion_list": lambda s, d: L.promotion_list(T(s, d)),
    "promotion_target_users": lambda s, d: L.promotion_target_users(T(s, d)),
    "court_reviews_latest": lambda s, d: L.court_reviews_latest(T(s, d)),
    "court_images_nested": lambda s, d: L.court_images_nested(T(s, d)),
    "court_images_parts": lambda s, d: L.court_images_parts(T(s, d), most=2),
    "court_search": lambda s, d: S.court_search(T(s, d)),
    "court_search_filtered": lambda s, d: S.court_search(T(s, d), location="asia", has_ac=True,
                                                         indoor_outdoor="indoor"),
    "court_search_type": lambda s, d: S.court_search(T(s, d), location="Brand#1", court_type="cement",
                                                     has_food=True),
    "owner_court_search": lambda s, d: S.owner_court_search(T(s, d)),
    "owner_court_search_filtered": lambda s, d: S.owner_court_search(T(s, d), location="GEAR", court_type="synthetic",
                                                                     has_ac=True),
    "visible_courts": lambda s, d: S.visible_courts(T(s, d)),
    "visible_courts_active": lambda s, d: S.visible_courts(T(s, d), require_approved=False),
    "users_by_role": lambda s, d: S.users_by_role(T(s, d)),
    "users_by_role_owner": lambda s, d: S.users_by_role(T(s, d), role="owner"),
    "owner_profile_complete": lambda s, d: S.owner_profile_complete(T(s, d)),
    "available_slots": lambda s, d: I.available_slots(T(s, d), SLOT_DAY),
    "booking_conflicts": lambda s, d: I.booking_conflicts(T(s, d)),
    "booking_conflicts_strict": lambda s, d: I.booking_conflicts(T(s, d), strict=True),
})

# ---- vouchers -------------------------------------------------------------

VOUCHER_DAY = "1998-06-01"


def _voucher_rollup(s, d):
    t = T(s, d)
    req = V(s, d, "voucher_requests")
    return VO.voucher_usage_rollup(t, VO.usage_from_validations(VO.validate_vouchers(t, req), req))


def _discount(s, d):
    """Discount and final amount for every request whose code names a promotion."""
    t = T(s, d)
    req = V(s, d, "voucher_requests").withColumn("_code", F.upper("code"))
    promos = t.promotions.select(F.col("code").alias("_code"), "discount_type", "discount_value",
                                 "max_discount_amount")
    return VO.voucher_discount(req.join(promos, "_code"))


QUERIES.update({
    "voucher_discount": _discount,
    "validate_vouchers": lambda s, d: VO.validate_vouchers(T(s, d), V(s, d, "voucher_requests")),
    "available_vouchers": lambda s, d: VO.available_vouchers(T(s, d), VOUCHER_DAY),
    "available_vouchers_distinct": lambda s, d: VO.available_vouchers(T(s, d), VOUCHER_DAY, distinct=True),
    "available_vouchers_user": lambda s, d: VO.available_vouchers(T(s, d), VOUCHER_DAY, user_id=7),
    "eligible_vouchers": lambda s, d: VO.eligible_vouchers(
        T(s, d), V(s, d, "voucher_requests").withColumn("booking_date", F.to_date("requested_at"))),
    "price_bookings": lambda s, d: VO.price_bookings(T(s, d), V(s, d, "booking_requests")),
    "voucher_usage_rollup": _voucher_rollup,
})

# ---- change jobs ------------------------------------------------------------


def _promo_upsert(s, d):
    return CH.upsert_promotions(T(s, d), V(s, d, "promotion_requests"))


def _court_upsert(s, d):
    return CH.upsert_courts(T(s, d), V(s, d, "court_requests"), V(s, d, "court_image_requests"),
                            V(s, d, "court_image_removals"))


def _cancel(s, d):
    return CH.cancel_bookings(T(s, d), V(s, d, "booking_actions"), AS_OF)


def _reviews(s, d):
    """Reviews and their requests come from bookings too: the columns that all three read are made and stored once."""
    made = fixture(s, d)
    if not made.materialized:
        made = made.over(bookings=cut_stored(made.view("bookings").select("id", "court_id", "user_id", "booking_status", "created_at")))
    t = T(s, d).replace(bookings=made.view("bookings"), reviews=made.view("reviews"))
    return CH.admit_reviews(t, made.view("review_requests"))


def _settle(s, d):
    return CH.settle_payments(T(s, d), V(s, d, "booking_actions"), AS_OF)


def _delete_courts(s, d):
    return CH.delete_courts(T(s, d), V(s, d, "court_delete_requests"))


def _delete_promotions(s, d):
    return CH.delete_promotions(T(s, d), V(s, d, "promotion_delete_requests"))


def _payouts(s, d):
    t = T(s, d)
    return CH.post_payouts(t, R.pending_payouts(t, AS_OF, exact=True), AS_OF)


def _targets(s, d):
    t = T(s, d)
    up = CH.upsert_promotions(t, V(s, d, "promotion_requests"))
    return CH.replace_promotion_targets(t, up.accepted, V(s, d, "promotion_target_requests"))


def _admit(s, d):
    return CH.admit_bookings(T(s, d), V(s, d, "booking_requests"))


def _admit_strict(s, d):
    return CH.admit_bookings(T(s, d), V(s, d, "booking_requests"), strict=True)


def _register(s, d):
    return CH.admit_registrations(T(s, d), V(s, d, "registration_requests"))


QUERIES.update({
    "slots_to_booking": lambda s, d: CH.slots_to_booking(V(s, d, "slot_requests"), T(s, d).courts),
    "approve_courts": lambda s, d: CH.approve_courts(T(s, d), V(s, d, "approval_requests")),
    "toggle_promotions": lambda s, d: CH.toggle_promotions(T(s, d), V(s, d, "toggle_requests")).table,
    "toggle_promotions_rejected": lambda s, d: CH.toggle_promotions(T(s, d), V(s, d, "toggle_requests")).rejected,
    "cancel_bookings": lambda s, d: _cancel(s, d).table,
    "cancel_bookings_rejected": lambda s, d: _cancel(s, d).rejected,
    "admit_reviews": lambda s, d: _reviews(s, d).table,
    "admit_reviews_rejected": lambda s, d: _reviews(s, d).rejected,
    "settle_payments_bookings": lambda s, d: _settle(s, d).bookings,
    "settle_payments_payments": lambda s, d: _settle(s, d).payments,
    "settle_payments_rejected": lambda s, d: _settle(s, d).rejected,
    "post_payouts": _payouts,
    "upsert_promotions": lambda s, d: _promo_upsert(s, d).promotions,
    "upsert_promotions_accepted": lambda s, d: _promo_upsert(s, d).accepted,
    "upsert_promotions_rejected": lambda s, d: _promo_upsert(s, d).rejected,
    "replace_promotion_targets": _targets,
    "delete_promotions": lambda s, d: _delete_promotions(s, d).promotions,
    "delete_promotions_usage": lambda s, d: _delete_promotions(s, d).voucher_usage,
    "delete_promotions_targets": lambda s, d: _delete_promotions(s, d).promotion_targets,
    "delete_courts": lambda s, d: _delete_courts(s, d).courts,
    "delete_courts_images": lambda s, d: _delete_courts(s, d).court_images,
    "delete_courts_rejected": lambda s, d: _delete_courts(s, d).rejected,
    "upsert_courts": lambda s, d: _court_upsert(s, d).courts,
    "upsert_courts_images": lambda s, d: _court_upsert(s, d).court_images,
    "upsert_courts_rejected": lambda s, d: _court_upsert(s, d).rejected,
    "admit_bookings": lambda s, d: _admit(s, d).bookings,
    "admit_bookings_rejected": lambda s, d: _admit(s, d).rejected,
    "admit_bookings_promotions": lambda s, d: _admit(s, d).promotions,
    "admit_bookings_usage": lambda s, d: _admit(s, d).usage,
    "admit_bookings_strict": lambda s, d: _admit_strict(s, d).bookings,
    "admit_registrations": lambda s, d: _register(s, d).users,
    "admit_registrations_owners": lambda s, d: _register(s, d).court_owners,
    "admit_registrations_rejected": lambda s, d: _register(s, d).rejected,
})

# ---- audits -----------------------------------------------------------------

QUERIES.update({
    "audit_unique": lambda s, d: Q.audit_unique(T(s, d)),
    "audit_not_null": lambda s, d: Q.audit_not_null(T(s, d)),
    "audit_check": lambda s, d: Q.audit_check(T(s, d)),
    "audit_foreign_keys": lambda s, d: Q.audit_foreign_keys(T(s, d)),
})

# ---- sources and sinks ------------------------------------------------------


def _scratch(spark: SparkSession, what: str) -> str:
    """A fresh folder under the session's shared checkpoint location."""
    return f"{shared_dir(spark).rstrip('/')}/tables/{what}-{uuid.uuid4().hex}"


def _written(df: DataFrame, what: str) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    path = _scratch(df.sparkSession, what)
    TB.write_table(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _load_tables(s, d):
    path = _scratch(s, "load")
    FX.materialize(s, d, path, declared=True)
    return FX.column_profile(TB.load_tables(s, path, optional=("court_availability",)))


def _write_table(s, d):
    path = _scratch(s, "bookings")
    TB.write_table(T(s, d).bookings, path, partition_by=["booking_date"])
    return s.read.parquet(path)


def _stored(s, d, what):
    """The bookings as a stored table of this run, and the fixture whose views are made from the stored rows."""
    table = ST.create(T(s, d).bookings, _scratch(s, what), block=10_000)
    return table, fixture(s, d).over(bookings=table.rows())


def _cancel_stored(s, d):
    """Cancellations that read and rewrite only the booking dates they touch; the whole stored table afterwards."""
    table, stored = _stored(s, d, "cancel")
    requests = stored.view("booking_actions")
    rows = table.touched(requests.select(F.col("booking_id").alias("id")))
    table.overwrite(CH.cancel_bookings(stored.tables().replace(bookings=rows), requests, AS_OF).table)
    return table.rows()


def _settle_stored(s, d):
    table, stored = _stored(s, d, "settle")
    requests = stored.view("booking_actions")
    rows = table.touched(requests.select(F.col("booking_id").alias("id")))
    table.overwrite(CH.settle_payments(stored.tables().replace(bookings=rows), requests, AS_OF).bookings)
    return table.rows()


def _publish_admission(s, d):
    """One batch of admitted bookings with its voucher usage, published together and read back: the new rows of both tables."""
    t, root = T(s, d), _scratch(s, "published")
    PB.publish(s, root, {"bookings": t.bookings, "voucher_usage": t.voucher_usage})
    before = PB.read(s, root)
    new = CH.admit_bookings(t.replace(**before), V(s, d, "booking_requests"))
    PB.publish(s, root, {"bookings": before["bookings"].unionByName(new.bookings, allowMissingColumns=True),
                         "voucher_usage": before["voucher_usage"].unionByName(new.usage, allowMissingColumns=True)},
               {"bookings": ["booking_date"]})
    after = PB.read(s, root)
    fresh = lambda name: after[name].join(before[name].select("id"), "id", "left_anti").select(F.lit(name).alias("table_name"), "id")
    return fresh("bookings").unionByName(fresh("voucher_usage"))


def _after_cancellations(s, d):
    """The tables after the cancellations, with a daily aggregate that was built before and refreshed for the days they touch."""
    path = _scratch(s, "daily")
    stored = fixture(s, d).over(bookings=_written(T(s, d).bookings, "before"))  # each state of the bookings is made once
    t, requests = stored.tables(), stored.view("booking_actions")
    DY.build(t, path)
    later = t.replace(bookings=_written(CH.cancel_bookings(t, requests, AS_OF).table, "after"))
    DY.refresh(later, path, DY.changed_days(later.bookings, requests.select(F.col("booking_id").alias("id"))))
    return later, path


def _daily_monthly(s, d):
    t, path = _after_cancellations(s, d)
    return R.owner_monthly_earnings(DY.with_daily(t, path))


def _daily_demand(s, d):
    t, path = _after_cancellations(s, d)
    return R.court_demand(DY.with_daily(t, path))


QUERIES.update({
    "owner_monthly_earnings_refreshed": _daily_monthly,
    "court_demand_refreshed": _daily_demand,
    "cancel_bookings_stored": _cancel_stored,
    "settle_payments_stored": _settle_stored,
    "publish_admission": _publish_admission,
})


def _registration_users(s, d):
    r = V(s, d, "registration_requests")
    return r.select((F.col("request_id") + F.lit(2000000000)).alias("id"), "username", "email",
                    F.coalesce(F.when(F.col("role") != "", F.col("role")), F.lit("user")).alias("role"),
                    "first_name", "last_name", F.lit(None).cast("string").alias("phone"),
                    F.col("requested_at").alias("created_at"))


QUERIES.update({
    "load_tables": _load_tables,
    "write_table": _write_table,
    "ensure_columns": lambda s, d: TB.ensure_columns(T(s, d).bookings, {
        "notes": ("string", None), "payment_intent_id": ("string", None), "voucher_code": ("string", None),
        "discount_amount": ("decimal(12,2)", 0)}),
    "insert_or_ignore": lambda s, d: TB.insert_or_ignore(
        T(s, d).users, _registration_users(s, d), unique=[["username"]]),
    "insert_or_ignore_two_keys": lambda s, d: TB.insert_or_ignore(
        T(s, d).users, _registration_users(s, d), unique=[["username"], ["email"]]),
})


def _incoming(s, d):
    """Tables as they would look if requests were written without the admission rules:
    raw registrations appended to users, raw review requests appended to reviews,
    and inactive promotions deleted without removing their targets."""
    t = T(s, d)
    r = V(s, d, "registration_requests")
    users = t.users.unionByName(r.select(
        (F.col("request_id") + F.lit(2000000000)).alias("id"), "username", "email", "role", "first_name",
        "last_name", F.lit(None).cast("string").alias("phone"), F.col("requested_at").alias("created_at")))
    rr = V(s, d, "review_requests")
    b = t.bookings.select(F.col("id").alias("booking_id"), "court_id")
    reviews = t.reviews.unionByName(rr.join(b, "booking_id").select(
        (F.col("request_id") + F.lit(3000000000)).alias("id"), "court_id", "user_id", "booking_id", "rating",
        F.col("requested_at").alias("created_at")))
    gone = V(s, d, "promotion_delete_requests")
    return t.replace(users=users, reviews=reviews, promotions=t.promotions.join(gone, "id", "left_anti"))


QUERIES.update({
    "audit_unique_incoming": lambda s, d: Q.audit_unique(_incoming(s, d)),
    "audit_not_null_incoming": lambda s, d: Q.audit_not_null(_incoming(s, d)),
    "audit_check_incoming": lambda s, d: Q.audit_check(_incoming(s, d)),
    "audit_foreign_keys_incoming": lambda s, d: Q.audit_foreign_keys(_incoming(s, d)),
})


def _profile_update(s, d):
    t = T(s, d)
    users = TB.ensure_columns(t.users, {"address": ("string", None)})
    return CH.merge_updates(users, V(s, d, "profile_requests"), "id", ["first_name", "last_name", "phone", "address"])


QUERIES.update({
    "validate_requests_booking": lambda s, d: S.validate_requests(V(s, d, "booking_requests"), "booking"),
    "validate_requests_review": lambda s, d: S.validate_requests(V(s, d, "review_requests"), "review"),
    "validate_requests_promotion": lambda s, d: S.validate_requests(V(s, d, "promotion_requests"), "promotion"),
    "validate_requests_court": lambda s, d: S.validate_requests(V(s, d, "court_requests"), "court"),
    "update_profiles": _profile_update,
    "court_search_with_images": lambda s, d: S.court_search(T(s, d), location="europe", with_images=True),
    "owner_court_search_with_images": lambda s, d: S.owner_court_search(T(s, d), indoor_outdoor="outdoor",
                                                                        with_images=True),
})

# ---- the sales dashboard from one shared aggregate ---------------------------

for _part in ("monthly", "today", "yearly", "daily", "weekday", "demand", "demand_bands", "recent", "chart_yearly",
              "chart_monthly"):
    QUERIES[f"sales_dashboard_{_part}"] = (
        lambda p: lambda s, d: getattr(DB.sales_dashboard(T(s, d), AS_OF, cache=False, bands=p == "demand_bands"), p))(_part)
