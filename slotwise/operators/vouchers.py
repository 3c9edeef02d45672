"""Promotions: discount rules, voucher validation, availability and eligibility, usage roll-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.functions.calendar import as_of_date
from slotwise.functions.money import final_after_discount, js_number_text, voucher_discount as discount_expr
from slotwise.functions.text import blank
from slotwise.sources.tables import Tables, ensure_columns

# The reference's voucher messages, in rule order.
MSG_BLANK = "Please enter a voucher code"
MSG_UNKNOWN = "Invalid voucher code"
MSG_DATES = "Voucher is not active"
MSG_LIMIT = "Voucher usage limit reached"
MSG_MINIMUM = "Minimum booking amount required: RM"
MSG_TARGET = "You are not eligible for this voucher"


def _dbl(c: Column) -> Column:
    return c.cast("double")


def voucher_discount(priced: DataFrame, amount: str = "booking_amount") -> DataFrame:
    """request_id, discount_amount, final_amount for rows that carry promotion columns."""
    d = discount_expr(amount, "discount_type", "discount_value", "max_discount_amount")
    return priced.select("request_id", _dbl(d).alias("discount_amount"),
                         _dbl(final_after_discount(amount, d)).alias("final_amount"))


def _active_by_code(t: Tables) -> DataFrame:
    return t.promotions.filter(F.col("is_active") == 1).select(
        F.col("id").alias("promotion_id"), F.col("code").alias("_code"), "title", "discount_type", "discount_value",
        "min_booking_amount", "max_discount_amount", "start_date", "end_date", "usage_limit", "used_count",
        "target_type")


def validate_vouchers(t: Tables, requests: DataFrame, now: str = "requested_at") -> DataFrame:
    """First failing rule wins, per request (request_id, user_id, code, booking_amount, ``now``).

    The date test follows the reference: a voucher is valid from 00:00 of its
    start date up to 00:00 of its end date (inclusive). Requests meet
    promotions through an equi join on the upper-cased code, and targeting
    through an equi join on (promotion_id, user_id) — no per-request lookups.
    """
    # the form trims the code before it is sent
    req = requests.withColumn("code", F.regexp_replace("code", r"(?U)^[\s﻿]+|[\s﻿]+$", ""))
    req = req.withColumn("_code", F.upper(F.col("code")))
    promos = _active_by_code(t)
    targets = t.promotion_targets.select("promotion_id", "user_id").dropna().distinct().withColumn(
        "_targeted", F.lit(True))
    j = (req.join(promos, "_code", "left")
         .join(targets, ["promotion_id", "user_id"], "left"))
    now_ts = F.col(now).cast("timestamp_ntz")
    start_ts = F.col("start_date").cast("timestamp_ntz")
    end_ts = F.col("end_date").cast("timestamp_ntz")
    amount = F.col("booking_amount")
    minimum = F.coalesce(F.col("min_booking_amount"), F.lit(0))
    reason = (F.when(blank(F.col("code")), F.lit(MSG_BLANK))
              .when(F.col("promotion_id").isNull(), F.lit(MSG_UNKNOWN))
              .when((now_ts < start_ts) | (now_ts > end_ts), F.lit(MSG_DATES))
              .when((F.col("usage_limit") > 0) & (F.col("used_count") >= F.col("usage_limit")), F.lit(MSG_LIMIT))
              .when(amount < minimum, F.concat(F.lit(MSG_MINIMUM), js_number_text(F.col("min_booking_amount"))))
              .when((F.col("target_type") == "specific") & F.col("_targeted").isNull(), F.lit(MSG_TARGET)))
    d = discount_expr(amount, "discount_type", "discount_value", "max_discount_amount")
    out = j.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())
    ok = F.col("valid")
    return out.select(
        "request_id", "valid", "reason",
        F.when(ok, F.col("promotion_id")).alias("promotion_id"), F.when(ok, F.col("title")).alias("title"),
        F.when(ok, F.col("discount_type")).alias("discount_type"),
        F.when(ok, _dbl(F.col("discount_value"))).alias("discount_value"),
        F.when(ok, _dbl(d)).alias("discount_amount"),
        F.when(ok, _dbl(final_after_discount(amount, d))).alias("final_amount"))


def _valid_on(day: Column) -> Column:
    return (F.col("is_active") == 1) & (F.col("start_date") <= day) & (F.col("end_date") >= day)


def available_vouchers(t: Tables, day, user_id=None, distinct: bool = False) -> DataFrame:
    """Promotions a user may use on ``day`` (whole end date included).

    With ``user_id``: the reference's LEFT JOIN to targets, so an 'all'
    promotion repeats once per target row. Without: answers for everyone —
    'all' promotions once (per target row) with user_id NULL meaning "every
    user", plus 'specific' ones per targeted user — never users × promotions.
    """
    d = as_of_date(day)
    p = t.promotions.filter(_valid_on(d))
    pt = t.promotion_targets.select(F.col("promotion_id").alias("id"), F.col("user_id").alias("_tu"))
    joined = p.join(pt, "id", "left")
    if user_id is not None:
        keep = (F.col("target_type") == "all") | ((F.col("target_type") == "specific") & (F.col("_tu") == user_id))
        out = joined.filter(keep).select(F.lit(user_id).cast("bigint").alias("user_id"), *t.promotions.columns)
    else:
        every = joined.filter(F.col("target_type") == "all").select(
            F.lit(None).cast("bigint").alias("user_id"), *t.promotions.columns)
        specific = joined.filter((F.col("target_type") == "specific") & F.col("_tu").isNotNull()).select(
            F.col("_tu").alias("user_id"), *t.promotions.columns)
        out = every.unionByName(specific)
    return out.dropDuplicates(["user_id", "id"]) if distinct else out


def eligible_vouchers(t: Tables, requests: DataFrame, as_of=None) -> DataFrame:
    """Vouchers for requests (request_id, user_id, booking_date, booking_amount), without repeating shared rows.

    * 'all' promotions: one row per (day on which there are requests, promotion valid that day), with request_id and
      user_id NULL: every request of that day whose amount reaches ``min_booking_amount`` (NULL: any) may use it;
    * 'specific' promotions: one row per targeted request that may use it.

    ``copies`` is the multiplicity of the LEFT JOIN to the targets, as in ``available_vouchers``. Day defaults to
    as_of's date, amount to 0. The output grows with promotions and with targeted requests, not with their product.
    """
    day = F.coalesce(F.col("booking_date"), as_of_date(as_of)) if as_of is not None else F.col("booking_date")
    req = requests.select("request_id", "user_id", day.alias("day"), F.coalesce(F.col("booking_amount"), F.lit(0)).alias("_amount"))
    p = t.promotions.filter(F.col("is_active") == 1)
    pcols = t.promotions.columns
    targets = t.promotion_targets.select(F.col("promotion_id").alias("id"), F.col("user_id").alias("_tu"))
    rows = targets.groupBy("id").agg(F.count(F.lit(1)).alias("_rows"))
    every = p.filter(F.col("target_type") == "all").join(rows, "id", "left").withColumn("copies", F.coalesce("_rows", F.lit(1)))
    days = req.select("day").dropna().distinct()
    # days of the requests, clipped to each promotion's span: an equi join on the day
    lo = F.greatest("start_date", days.agg(F.min("day")).scalar())
    hi = F.least("end_date", days.agg(F.max("day")).scalar())
    every = every.withColumn("day", F.explode(F.when(lo <= hi, F.sequence(lo, hi)))).join(days, "day")
    every = every.select(F.lit(None).cast("long").alias("request_id"), F.lit(None).cast("long").alias("user_id"), "day", "copies", *pcols)
    spec = p.filter(F.col("target_type") == "specific").join(targets.groupBy("id", "_tu").agg(F.count(F.lit(1)).alias("copies")), "id")
    may = ((F.col("start_date") <= F.col("day")) & (F.col("end_date") >= F.col("day"))
           & (F.col("min_booking_amount").isNull() | (F.col("min_booking_amount") <= F.col("_amount"))))
    spec = req.join(spec, req["user_id"] == spec["_tu"]).filter(may).select(
        F.col("request_id").cast("long").alias("request_id"), F.col("user_id").cast("long").alias("user_id"), "day", "copies", *pcols)
    return every.unionByName(spec)


def price_bookings(t: Tables, requests: DataFrame) -> DataFrame:
    """original = rate × hours; discount applies only when a code AND an amount are given; no floor."""
    courts = t.courts.select(F.col("id").alias("court_id"), "hourly_rate")
    requests = ensure_columns(requests, {"voucher_code": ("string", None), "discount_amount": ("decimal(12,2)", None)})
    j = requests.join(courts, "court_id")
    original = F.col("hourly_rate").cast("double") * F.col("total_hours").cast("double")
    has_voucher = ~blank("voucher_code") & ~blank("discount_amount", numeric=True)
    disc = F.when(has_voucher, F.col("discount_amount").cast("double")).otherwise(F.lit(0.0))
    return j.select("request_id", original.alias("original_amount"), disc.alias("discount_amount"),
                    (original - disc).alias("total_amount"))


def voucher_usage_rollup(t: Tables, new_usage: DataFrame) -> DataFrame:
    """Per promotion: uses and discount of ``new_usage`` (voucher_usage rows not counted yet) and the raised used_count.

    ``used_count`` already contains the rows of the voucher_usage table, so only the new rows are added.
    """
    usage = new_usage.groupBy(F.col("promotion_id").alias("id")).agg(
        F.count(F.lit(1)).alias("uses"), F.sum("discount_amount").alias("_disc"))
    return t.promotions.select("id", "used_count").join(usage, "id", "left").select(
        F.col("id").alias("promotion_id"), F.coalesce("uses", F.lit(0)).cast("bigint").alias("uses"),
        _dbl(F.coalesce("_disc", F.lit(0))).alias("total_discount"),
        (F.coalesce("used_count", F.lit(0)) + F.coalesce("uses", F.lit(0))).cast("bigint").alias("used_count"))


def usage_from_validations(validated: DataFrame, requests: DataFrame, used_at: str = "requested_at") -> DataFrame:
    """voucher_usage rows for the valid validations (one use per valid request)."""
    v = validated.filter("valid").select("request_id", "promotion_id", "discount_amount")
    r = requests.select("request_id", "user_id", F.col(used_at).cast("timestamp_ntz").alias("used_at"))
    return v.join(r, "request_id").select(
        F.col("request_id").alias("id"), "promotion_id", F.lit(None).cast("bigint").alias("booking_id"), "user_id",
        F.col("discount_amount").cast("decimal(12,2)").alias("discount_amount"), "used_at")
