"""Court search with optional conjunctive filters, visibility rules, simple predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.functions.text import blank, contains_ci
from slotwise.operators.reports import primary_image, review_summary
from slotwise.plans.paging import listing
from slotwise.sources.tables import Tables

# Required owner-profile fields, in the reference's order.
PROFILE_FIELDS = ("business_name", "business_phone", "business_email", "bank_name", "bank_account_number",
                  "account_holder_name", "subscription_plan", "subscription_status")

# Required request fields per kind and the reference's messages.
REQUEST_RULES = {
    "booking": (("court_id", "booking_date", "start_time", "end_time", "total_hours"), "Missing required fields"),
    "promotion": (("code", "title", "discount_type", "discount_value", "start_date", "end_date"),
                  "Please fill in all required fields"),
    "court": (("name", "address", "hourly_rate"), "Please fill in all required fields"),
    "review": (("rating",), "Invalid rating"),
}


def _all(preds: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, preds, F.lit(True))


def _facility_filters(court_type, indoor_outdoor, has_ac, has_parking, has_food) -> list[Column]:
    preds = []
    if court_type:
        preds.append(F.col("court_type") == F.lit(court_type))
    if indoor_outdoor:
        preds.append(F.col("indoor_outdoor") == F.lit(indoor_outdoor))
    for flag, col in ((has_ac, "has_ac"), (has_parking, "has_parking"), (has_food, "has_food")):
        if flag:
            preds.append(F.col(col) == 1)
    return preds


def visible_courts(t: Tables, require_approved: bool = True) -> DataFrame:
    """Active courts; bookable search also needs approval."""
    cond = F.col("is_active") == 1
    if require_approved:
        cond = cond & (F.col("is_approved") == 1)
    return t.courts.filter(cond)


def court_search(t: Tables, location: str | None = None, court_type: str | None = None,
                 indoor_outdoor: str | None = None, has_ac: bool = False, has_parking: bool = False,
                 has_food: bool = False, with_images: bool = False, ordered: bool = True, after=None,
                 limit: int | None = None) -> DataFrame:
    """Active, approved courts matching every given filter, with owner, rating summary and primary image, newest first.

    ``after=(created_at, id)`` and ``limit`` give one page, see ``plans.paging``.

    ``location`` matches the court address or the owner's business address
    (case-insensitive containment, like SQLite LIKE on ASCII).
    """
    owners = t.court_owners.select(F.col("id").alias("owner_id"), "business_name", "business_address")
    courts = visible_courts(t).join(owners, "owner_id")
    preds = _facility_filters(court_type, indoor_outdoor, has_ac, has_parking, has_food)
    if location:
        preds.append(contains_ci("address", location) | contains_ci("business_address", location))
    courts = courts.filter(_all(preds))
    rs = review_summary(t).withColumnRenamed("court_id", "id")
    pi = primary_image(t).withColumnRenamed("court_id", "id")
    out = courts.join(rs, "id", "left").join(pi, "id", "left").select(
        *t.courts.columns, "business_name", "business_address", "avg_rating",
        F.coalesce("review_count", F.lit(0)).cast("bigint").alias("review_count"), "primary_image")
    if with_images:
        from slotwise.operators.listings import court_images_nested
        out = out.join(court_images_nested(t).withColumnRenamed("court_id", "id"), "id", "left")
    return listing(out, ["created_at"], ordered, after, limit)


def owner_court_search(t: Tables, location: str | None = None, court_type: str | None = None,
                       indoor_outdoor: str | None = None, has_ac: bool = False, has_parking: bool = False,
                       has_food: bool = False, owner_id=None, with_images: bool = False, ordered: bool = True, after=None,
                       limit: int | None = None) -> DataFrame:
    """An owner's courts (all owners at once) matching the filters, newest first; location matches address or name."""
    courts = t.courts.filter(F.col("owner_id").isNotNull())
    if owner_id is not None:
        courts = courts.filter(F.col("owner_id") == F.lit(owner_id))
    preds = _facility_filters(court_type, indoor_outdoor, has_ac, has_parking, has_food)
    if location:
        preds.append(contains_ci("address", location) | contains_ci("name", location))
    courts = courts.filter(_all(preds))
    nb = t.bookings.groupBy(F.col("court_id").alias("id")).agg(F.count(F.lit(1)).alias("booking_count"))
    nr = t.reviews.groupBy(F.col("court_id").alias("id")).agg(F.avg("rating").alias("avg_rating"))
    out = courts.join(nb, "id", "left").join(nr, "id", "left").select(
        *t.courts.columns, F.coalesce("booking_count", F.lit(0)).cast("bigint").alias("booking_count"), "avg_rating")
    if with_images:
        from slotwise.operators.listings import court_images_nested
        out = out.join(court_images_nested(t).withColumnRenamed("court_id", "id"), "id", "left")
    return listing(out, ["created_at"], ordered, after, limit)


def users_by_role(t: Tables, role: str = "user") -> DataFrame:
    return (t.users.filter(F.col("role") == F.lit(role)).select("id", "first_name", "last_name", "email")
            .orderBy("first_name", "last_name", "id"))


def owner_profile_complete(t: Tables) -> DataFrame:
    """Owners with every required profile field non-empty; ``missing`` lists the others in field order."""
    co = t.court_owners
    flags = F.array(*[F.when(blank(F.col(c).cast("string")) if c in co.columns else F.lit(True), F.lit(c))
                      for c in PROFILE_FIELDS])
    missing = F.filter(flags, lambda x: x.isNotNull())
    return co.select(F.col("id").alias("owner_id"), missing.alias("missing")).select(
        "owner_id", (F.size("missing") == 0).alias("complete"), "missing")


def validate_requests(requests: DataFrame, kind: str) -> DataFrame:
    """requests.* + valid + reason (the reference's message for the first broken rule, else NULL).

    Blank means NULL, empty text or zero. Reviews also need 1 <= rating <= 5.
    """
    fields, message = REQUEST_RULES[kind]
    types = dict(requests.dtypes)
    numeric = lambda c: not types.get(c, "string").startswith(("string", "varchar", "char", "date", "timestamp"))
    broken = _any([blank(F.col(c), numeric(c)) for c in fields])
    if kind == "review":
        r = F.col("rating").cast("string").try_cast("double")
        broken = broken | F.coalesce((r < 1) | (r > 5), F.lit(True))
    reason = F.when(broken, F.lit(message))
    return requests.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())


def _any(preds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, preds, F.lit(False))
