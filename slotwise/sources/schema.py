"""Declared schema of the twelve booking tables, and their declared constraints.

Money is DECIMAL(12,2) inside the library; times of day are zero-padded
"HH:MM" strings (text order equals time order); timestamps are TIMESTAMP_NTZ.
"""

from __future__ import annotations

from pyspark.sql import types as T

L, I, S, D = T.LongType(), T.IntegerType(), T.StringType(), T.DoubleType()
DATE, TS = T.DateType(), T.TimestampNTZType()
MONEY = T.DecimalType(12, 2)


def _struct(*cols: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in cols])


SCHEMAS: dict[str, T.StructType] = {
    "users": _struct(
        ("id", L), ("username", S), ("email", S), ("role", S), ("first_name", S), ("last_name", S),
        ("phone", S), ("address", S), ("created_at", TS), ("updated_at", TS)),
    "court_owners": _struct(
        ("id", L), ("user_id", L), ("business_name", S), ("business_address", S), ("business_phone", S),
        ("business_email", S), ("bank_name", S), ("bank_account_number", S), ("account_holder_name", S),
        ("subscription_plan", S), ("subscription_status", S), ("bank_details", S), ("payout_info", S),
        ("is_verified", I), ("created_at", TS)),
    "courts": _struct(
        ("id", L), ("owner_id", L), ("name", S), ("description", S), ("address", S), ("latitude", D),
        ("longitude", D), ("court_type", S), ("indoor_outdoor", S), ("has_ac", I), ("has_food", I),
        ("has_rest_area", I), ("has_changing_room", I), ("has_parking", I), ("hourly_rate", MONEY),
        ("open_time", S), ("close_time", S), ("is_active", I), ("is_approved", I), ("created_at", TS)),
    "court_images": _struct(("id", L), ("court_id", L), ("image_path", S), ("is_primary", I), ("created_at", TS)),
    "bookings": _struct(
        ("id", L), ("court_id", L), ("user_id", L), ("booking_date", DATE), ("start_time", S), ("end_time", S),
        ("total_hours", I), ("total_amount", MONEY), ("notes", S), ("payment_status", S), ("booking_status", S),
        ("payment_intent_id", S), ("voucher_code", S), ("discount_amount", MONEY), ("created_at", TS)),
    "reviews": _struct(
        ("id", L), ("court_id", L), ("user_id", L), ("booking_id", L), ("rating", I), ("comment", S),
        ("created_at", TS)),
    "court_availability": _struct(
        ("id", L), ("court_id", L), ("date", DATE), ("start_time", S), ("end_time", S), ("is_blocked", I),
        ("reason", S)),
    "payments": _struct(
        ("id", L), ("booking_id", L), ("amount", MONEY), ("payment_method", S), ("transaction_id", S),
        ("status", S), ("created_at", TS)),
    "payouts": _struct(
        ("id", L), ("owner_id", L), ("amount", MONEY), ("status", S), ("payout_date", TS), ("created_at", TS)),
    "promotions": _struct(
        ("id", L), ("code", S), ("title", S), ("description", S), ("discount_type", S), ("discount_value", MONEY),
        ("min_booking_amount", MONEY), ("max_discount_amount", MONEY), ("start_date", DATE), ("end_date", DATE),
        ("is_active", I), ("usage_limit", I), ("used_count", I), ("created_by", L), ("target_type", S),
        ("created_at", TS)),
    "promotion_targets": _struct(("id", L), ("promotion_id", L), ("user_id", L), ("created_at", TS)),
    "voucher_usage": _struct(
        ("id", L), ("promotion_id", L), ("booking_id", L), ("user_id", L), ("discount_amount", MONEY),
        ("used_at", TS)),
}

TABLES = tuple(SCHEMAS)

# The declared constraints of the booking schema.
NOT_NULL: dict[str, tuple[str, ...]] = {
    "users": ("username", "email", "role"),
    "court_owners": ("business_name",),
    "courts": ("name", "address", "hourly_rate"),
    "court_images": ("image_path",),
    "bookings": ("booking_date", "start_time", "end_time", "total_hours", "total_amount"),
    "reviews": ("rating",),
    "court_availability": ("date", "start_time", "end_time"),
    "payments": ("amount",),
    "payouts": ("amount",),
    "promotions": ("code", "title", "discount_type", "discount_value", "start_date", "end_date", "created_by"),
    "voucher_usage": ("discount_amount",),
}

UNIQUE: tuple[tuple[str, str], ...] = (("users", "username"), ("users", "email"), ("promotions", "code"))

# (table, rule name, SQL condition); NULL passes a CHECK, as in SQL
CHECKS: tuple[tuple[str, str, str], ...] = (
    ("reviews", "rating_between_1_and_5", "rating >= 1 AND rating <= 5"),
    ("promotions", "discount_type_in_percentage_fixed", "discount_type IN ('percentage', 'fixed')"),
    ("promotions", "target_type_in_all_specific", "target_type IN ('all', 'specific')"),
)

# (child table, column, parent table); parent key is always `id`
FOREIGN_KEYS: tuple[tuple[str, str, str], ...] = (
    ("court_owners", "user_id", "users"),
    ("courts", "owner_id", "court_owners"),
    ("court_images", "court_id", "courts"),
    ("bookings", "court_id", "courts"),
    ("bookings", "user_id", "users"),
    ("reviews", "court_id", "courts"),
    ("reviews", "user_id", "users"),
    ("reviews", "booking_id", "bookings"),
    ("court_availability", "court_id", "courts"),
    ("payments", "booking_id", "bookings"),
    ("payouts", "owner_id", "court_owners"),
    ("promotions", "created_by", "users"),
    ("promotion_targets", "promotion_id", "promotions"),
    ("promotion_targets", "user_id", "users"),
    ("voucher_usage", "promotion_id", "promotions"),
    ("voucher_usage", "booking_id", "bookings"),
    ("voucher_usage", "user_id", "users"),
)
