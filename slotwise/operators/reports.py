"""Platform and owner reports (aggregations and window rankings).

Owner-scoped reports answer for every owner at once. They aggregate bookings
per court first (map-side partial aggregation, so a hot court shrinks inside
each task) and join the much smaller per-court rows to courts afterwards.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotwise.functions.calendar import as_of_date, as_of_ts, day_text, in_period, month, month_num, weekday_text, year_text
from slotwise.functions.text import full_name
from slotwise.plans.paging import listing
from slotwise.plans.ranking import positions, top_k
from slotwise.plans.rollup import court_owner, per_court, per_owner, share_of
from slotwise.sources.tables import Tables

# Constants of the reference's reports.
OWNER_SHARE = 0.8
PAYOUT_HOLD_DAYS = 7
TREND_DAYS = 30
PAGE_SIZE = 10
HIGH_DEMAND = 0.3
LOW_DEMAND = 0.7
CONFIRMED, PAID, PENDING = "confirmed", "paid", "pending"


def _dbl(c: Column) -> Column:
    return c.cast("double")


def _owner_filter(df: DataFrame, owner_id, col: str = "owner_id") -> DataFrame:
    return df if owner_id is None else df.filter(F.col(col) == F.lit(owner_id))


# ---------------------------------------------------------------- platform

def platform_stats(t: Tables) -> DataFrame:
    """One row of headline counts; three single-row aggregates merged without a cross join."""
    u = t.users.agg(F.count_if(F.col("role") == "user").alias("total_users"),
                    F.count_if(F.col("role") == "owner").alias("total_owners"))
    c = t.courts.agg(F.count_if(F.col("is_approved") == 1).alias("approved_courts"),
                     F.count_if(F.col("is_approved") == 0).alias("pending_courts"))
    b = t.bookings.agg(F.count_if(F.col("booking_status") == CONFIRMED).alias("total_bookings"),
                       F.sum(F.when(F.col("payment_status") == PAID, F.col("total_amount"))).alias("total_revenue"))
    merged = u.unionByName(c, allowMissingColumns=True).unionByName(b, allowMissingColumns=True)
    return merged.agg(
        F.max("total_users").alias("total_users"), F.max("total_owners").alias("total_owners"),
        F.max("approved_courts").alias("approved_courts"), F.max("pending_courts").alias("pending_courts"),
        F.max("total_bookings").alias("total_bookings"), _dbl(F.max("total_revenue")).alias("total_revenue"))


def users_with_booking_count(t: Tables, ordered: bool = True, after=None, limit: int | None = None) -> DataFrame:
    """Every user with the number of their bookings, newest first; ``after`` and ``limit`` give one page."""
    counts = t.bookings.groupBy(F.col("user_id").alias("id")).agg(F.count(F.lit(1)).alias("booking_count"))
    out = t.users.join(counts, "id", "left").withColumn("booking_count", F.coalesce("booking_count", F.lit(0)).cast("bigint"))
    return listing(out.select(*t.users.columns, "booking_count"), ["created_at"], ordered, after, limit)


def review_summary(t: Tables) -> DataFrame:
    """court_id -> avg_rating, review_count (only courts with reviews)."""
    return t.reviews.groupBy("court_id").agg(F.avg("rating").alias("avg_rating"),
                                             F.count(F.lit(1)).alias("review_count"))


def court_rating_summary(t: Tables) -> DataFrame:
    """Every court: avg_rating (NULL without reviews), review_count (0), filled stars out of 5."""
    s = review_summary(t)
    out = t.courts.select(F.col("id").alias("court_id")).join(s, "court_id", "left")
    stars = F.when(F.col("avg_rating").isNull(), 0).otherwise(
        F.least(F.greatest(F.floor("avg_rating"), F.lit(0)), F.lit(5)))
    return out.select("court_id", "avg_rating",
                      F.coalesce("review_count", F.lit(0)).cast("bigint").alias("review_count"),
                      stars.cast("int").alias("stars"))


def monthly_revenue(t: Tables, n: int = 12) -> DataFrame:
    """Paid bookings by created month, latest ``n`` months."""
    return (t.bookings.filter(F.col("payment_status") == PAID)
            .groupBy(month("created_at").alias("month"))
            .agg(_dbl(F.sum("total_amount")).alias("revenue"), F.count(F.lit(1)).alias("bookings"))
            .orderBy(F.col("month").desc_nulls_last()).limit(n))


def popular_courts(t: Tables, n: int = 10, distinct: bool = False) -> DataFrame:
    """Approved courts by booking count, top ``n``.

    The reference joins bookings AND reviews to the court before counting, so
    its count is bookings × max(reviews, 1). Both sides are pre-aggregated per
    court instead (no fan-out rows are ever built); ``distinct=True`` gives the
    plain booking count. The average rating is the same either way.
    """
    nb = t.bookings.groupBy("court_id").agg(F.count("id").alias("nb"))
    nr = t.reviews.groupBy("court_id").agg(F.count(F.lit(1)).alias("nr"), F.avg("rating").alias("avg_rating"))
    courts = (t.courts.filter(F.col("is_approved") == 1)
              .join(t.court_owners.select(F.col("id").alias("owner_id"), "business_name"), "owner_id")
              .select(F.col("id").alias("court_id"), "name", "business_name"))
    out = courts.join(nb, "court_id", "left").join(nr, "court_id", "left")
    nbc = F.coalesce("nb", F.lit(0))
    count = nbc if distinct else nbc * F.greatest(F.coalesce("nr", F.lit(0)), F.lit(1))
    return (out.select("court_id", "name", "business_name", count.cast("bigint").alias("booking_count"),
                       "avg_rating")
            .orderBy(F.col("booking_count").desc(), F.col("court_id")).limit(n))


def registration_trends(t: Tables, n: int = 12) -> DataFrame:
    """Users by (created month, role); the latest ``n`` ROWS (month desc, role)."""
    return (t.users.groupBy(month("created_at").alias("month"), "role")
            .agg(F.count(F.lit(1)).alias("registrations"))
            .orderBy(F.col("month").desc_nulls_last(), F.col("role").asc_nulls_last()).limit(n)
            .select("month", "registrations", "role"))


# ---------------------------------------------------------------- payouts

def unpaid_bookings_since_payout(t: Tables) -> DataFrame:
    """Paid bookings of each owner with no payout created after the booking.

    NOT EXISTS (payout of the owner created later) is rewritten as a
    comparison with the owner's latest payout — an equi join on owner instead
    of a range join, exact also for NULL creation times.
    """
    last = t.payouts.groupBy("owner_id").agg(F.max("created_at").alias("_last_payout"))
    court_cut = court_owner(t).join(last, "owner_id", "left")
    b = t.bookings.filter(F.col("payment_status") == PAID)
    joined = b.join(court_cut, "court_id")
    keep = (F.col("_last_payout").isNull() | F.col("created_at").isNull()
            | (F.col("created_at") >= F.col("_last_payout")))
    return joined.filter(keep).select("owner_id", *[F.col(c) for c in t.bookings.columns])


def pending_payouts(t: Tables, as_of, share: float = OWNER_SHARE, hold_days: int = PAYOUT_HOLD_DAYS,
                    exact: bool = False) -> DataFrame:
    """Per owner: share of paid bookings dated before as_of − hold_days with no later payout.

    ``exact`` keeps the amount as an exact decimal (what a payout job should post).
    """
    cutoff = F.date_sub(as_of_date(as_of), hold_days)
    unpaid = unpaid_bookings_since_payout(t).filter(F.col("booking_date") < cutoff)
    sums = unpaid.groupBy("owner_id").agg(F.sum("total_amount").alias("_amt"))
    owners = t.court_owners.select(F.col("id").alias("owner_id"), "business_name")
    amount = share_of(F.col("_amt"), share)
    return owners.join(sums, "owner_id").select(
        "owner_id", "business_name", (amount if exact else _dbl(amount)).alias("pending_amount"))


# ---------------------------------------------------------------- owner earnings

def owner_earnings_summary(t: Tables, owner_id=None, share: float = OWNER_SHARE) -> DataFrame:
    """Per owner: total / paid / pending earnings (NULL for owners without bookings)."""
    per_court = t.bookings.groupBy("court_id").agg(
        F.sum("total_amount").alias("_all"),
        F.sum(F.when(F.col("payment_status") == PAID, F.col("total_amount")).otherwise(0)).alias("_paid"),
        F.sum(F.when(F.col("payment_status") == PENDING, F.col("total_amount")).otherwise(0)).alias("_pend"))
    per_owner_ = (per_court.join(court_owner(t), "court_id").groupBy("owner_id")
                  .agg(F.sum("_all").alias("_all"), F.sum("_paid").alias("_paid"), F.sum("_pend").alias("_pend")))
    owners = _owner_filter(t.court_owners.select(F.col("id").alias("owner_id")), owner_id)
    return owners.join(per_owner_, "owner_id", "left").select(
        "owner_id", _dbl(share_of(F.col("_all"), share)).alias("total_earnings"),
        _dbl(share_of(F.col("_paid"), share)).alias("paid_earnings"),
        _dbl(share_of(F.col("_pend"), share)).alias("pending_earnings"))


def owner_monthly_earnings(t: Tables, owner_id=None, share: float = OWNER_SHARE, ordered: bool = True) -> DataFrame:
    """Confirmed bookings by created month, newest month first: earnings and count, per owner."""
    agg = per_owner(t, F.col("booking_status") == CONFIRMED, {"month": month("created_at")})
    out = _owner_filter(agg, owner_id).select(
        "owner_id", "month", _dbl(F.coalesce(share_of(F.col("amount"), share), F.lit(0))).alias("earnings"),
        F.col("n").alias("bookings"))
    return out.orderBy("owner_id", F.desc("month")) if ordered else out


def owner_today_sales(t: Tables, as_of, owner_id=None, share: float = OWNER_SHARE) -> DataFrame:
    """Confirmed bookings created on as_of's date; every owner, 0 if none."""
    agg = per_owner(t, (F.col("booking_status") == CONFIRMED) & (F.to_date("created_at") == as_of_date(as_of)))
    owners = _owner_filter(t.court_owners.select(F.col("id").alias("owner_id")), owner_id)
    return owners.join(agg, "owner_id", "left").select(
        "owner_id", _dbl(F.coalesce(share_of(F.col("amount"), share), F.lit(0))).alias("today_sales"))


def owner_yearly_sales(t: Tables, as_of, owner_id=None, share: float = OWNER_SHARE, ordered: bool = True) -> DataFrame:
    """Confirmed bookings created in as_of's year, by month, in its order."""
    where = (F.col("booking_status") == CONFIRMED) & in_period("created_at", as_of, "year")
    agg = per_owner(t, where, {"month": month("created_at")})
    out = _owner_filter(agg, owner_id).select(
        "owner_id", F.substring("month", 6, 2).alias("month_num"), "month",
        _dbl(F.coalesce(share_of(F.col("amount"), share), F.lit(0))).alias("sales"))
    return out.orderBy("owner_id", "month_num") if ordered else out


def owner_daily_sales(t: Tables, as_of, owner_id=None, share: float = OWNER_SHARE, ordered: bool = True) -> DataFrame:
    """Confirmed bookings created in as_of's month, by day of month ('DD'), in its order."""
    where = (F.col("booking_status") == CONFIRMED) & in_period("created_at", as_of, "month")
    agg = per_owner(t, where, {"day": day_text("created_at")})
    out = _owner_filter(agg, owner_id).select(
        "owner_id", "day", _dbl(F.coalesce(share_of(F.col("amount"), share), F.lit(0))).alias("sales"))
    return out.orderBy("owner_id", "day") if ordered else out


def owner_weekday_trend(t: Tables, as_of, days: int = TREND_DAYS, owner_id=None, ordered: bool = True) -> DataFrame:
    """Confirmed bookings created since as_of − days, by weekday of booking_date ('0' = Sunday first)."""
    since = as_of_ts(as_of) - F.expr(f"INTERVAL {int(days)} DAYS")
    where = (F.col("booking_status") == CONFIRMED) & (F.col("created_at") >= since)
    agg = per_owner(t, where, {"day_of_week": weekday_text("booking_date")})
    out = _owner_filter(agg, owner_id).select("owner_id", "day_of_week", F.col("n").alias("bookings"))
    return out.orderBy("owner_id", "day_of_week") if ordered else out


def owner_sales_headline(t: Tables, as_of, calendar: bool = False, share: float = OWNER_SHARE) -> DataFrame:
    """Per owner: 'annual' = Σ over all months, 'current month' = latest month with data, today.

    ``calendar=True`` restricts annual to as_of's year and current month to as_of's month.
    All three come from one per-(owner, created day) aggregate of confirmed bookings, so
    bookings are scanned once. Sums stay exact decimals and are rounded like toFixed(2).
    """
    daily = per_owner(t, F.col("booking_status") == CONFIRMED, {"_day": F.to_date("created_at")})
    own = share_of(F.col("amount"), share)
    monthly = daily.groupBy("owner_id", month("_day").alias("month")).agg(
        F.sum(own).alias("_m"), F.sum(F.when(F.col("_day") == as_of_date(as_of), own)).alias("_t"))
    today = F.sum("_t").alias("_today")
    if calendar:
        ts = as_of_ts(as_of)
        this_year = F.substring("month", 1, 4) == year_text(ts)
        heads = monthly.groupBy("owner_id").agg(
            F.sum(F.when(this_year, F.col("_m"))).alias("_annual"),
            F.sum(F.when(F.col("month") == month(ts), F.col("_m"))).alias("_cur"), today)
    else:
        heads = monthly.groupBy("owner_id").agg(F.sum("_m").alias("_annual"),
                                                F.max_by("_m", "month").alias("_cur"), today)
    owners = t.court_owners.select(F.col("id").alias("owner_id"))
    out = owners.join(heads, "owner_id", "left")
    r2 = lambda c: _dbl(F.round(F.coalesce(F.col(c).cast("decimal(38,3)"), F.lit(0)), 2))
    return out.select("owner_id", r2("_annual").alias("annual_sales"), r2("_cur").alias("current_month_sales"),
                      r2("_today").alias("today_sales"))


def chart_arrays(series: DataFrame) -> DataFrame:
    """(owner_id, label, sales) rows -> owner_id, labels[], data[] in label order, and the same as JSON.

    One small row per (owner, month) or (owner, day) — at most 31 entries per owner.
    """
    grouped = series.groupBy("owner_id").agg(F.sort_array(F.collect_list(F.struct("label", "sales"))).alias("_s"))
    labels = F.transform("_s", lambda x: x["label"])
    data = F.transform("_s", lambda x: x["sales"])
    return grouped.select("owner_id", labels.alias("labels"), data.alias("data")).withColumn(
        "json", F.to_json(F.struct("labels", "data")))


def sales_chart_series(t: Tables, as_of, period: str = "yearly", share: float = OWNER_SHARE) -> DataFrame:
    """Chart arrays per owner: labels[] and data[] in label order, also as one JSON text."""
    if period == "yearly":
        src = owner_yearly_sales(t, as_of, share=share, ordered=False).select("owner_id", F.col("month").alias("label"), "sales")
    elif period == "monthly":
        src = owner_daily_sales(t, as_of, share=share, ordered=False).select("owner_id", F.col("day").alias("label"), "sales")
    else:
        raise ValueError("period must be 'yearly' or 'monthly'")
    return chart_arrays(src)


def owner_history_counts(t: Tables, page_size: int = PAGE_SIZE) -> DataFrame:
    """Per owner: booking rows and pages of ``page_size`` (0 / 0 without bookings)."""
    agg = per_owner(t)
    owners = t.court_owners.select(F.col("id").alias("owner_id"))
    n = F.coalesce(F.col("n"), F.lit(0)).cast("bigint")
    return owners.join(agg, "owner_id", "left").select(
        "owner_id", n.alias("total_records"), F.ceil(n / F.lit(page_size)).cast("bigint").alias("total_pages"))


def deletable_courts(t: Tables, owner_id=None) -> DataFrame:
    """Courts with no booking of any status."""
    return _owner_filter(t.courts.join(t.bookings.select(F.col("court_id").alias("id")), "id", "left_anti"),
                         owner_id)


def owner_court_rollup(t: Tables, owner_id=None, ordered: bool = True, after=None, limit: int | None = None) -> DataFrame:
    """Every owned court: confirmed bookings, paid revenue (NULL if none), average rating, newest first."""
    b = t.bookings.groupBy(F.col("court_id").alias("id")).agg(
        F.count_if(F.col("booking_status") == CONFIRMED).alias("total_bookings"),
        F.sum(F.when(F.col("payment_status") == PAID, F.col("total_amount"))).alias("total_revenue"))
    r = t.reviews.groupBy(F.col("court_id").alias("id")).agg(F.avg("rating").alias("avg_rating"))
    courts = _owner_filter(t.courts.filter(F.col("owner_id").isNotNull()), owner_id)
    out = (courts.join(b, "id", "left").join(r, "id", "left")
           .withColumn("total_bookings", F.coalesce("total_bookings", F.lit(0)).cast("bigint"))
           .withColumn("total_revenue", _dbl(F.col("total_revenue"))))
    return listing(out, ["created_at"], ordered, after, limit)


# ---------------------------------------------------------------- demand

def court_demand(t: Tables, owner_id=None, share: float = OWNER_SHARE, ordered: bool = True) -> DataFrame:
    """Every owned court with its confirmed bookings and revenue, most booked first; idle courts stay with 0."""
    agg = per_court(t.bookings.filter(F.col("booking_status") == CONFIRMED)).withColumnsRenamed({"n": "_n", "amount": "_amt"})
    courts = _owner_filter(t.courts.filter(F.col("owner_id").isNotNull()), owner_id).select(
        "owner_id", F.col("id").alias("court_id"), "name")
    out = courts.join(agg, "court_id", "left").select(
        "owner_id", "court_id", "name", F.coalesce("_n", F.lit(0)).cast("bigint").alias("bookings"),
        _dbl(F.coalesce(share_of(F.col("_amt"), share), F.lit(0))).alias("revenue"))
    return out.orderBy("owner_id", F.desc("bookings"), "court_id") if ordered else out


def demand_split(t: Tables, high: float = HIGH_DEMAND, low: float = LOW_DEMAND, owner_id=None,
                 demand: DataFrame | None = None) -> DataFrame:
    """Per owner, courts ranked by bookings (desc, court id): 'high' = first ceil(n·high),
    'low' = last ceil(n·low) listed from the bottom up. A court can be in both bands.

    The cut sizes use binary-double products like the reference (10 × 0.3 is
    slightly above 3, so its ceiling is 4). Ranking uses the skew-safe
    ``positions`` (an owner with a third of all courts is spread over tasks).
    """
    d = court_demand(t, owner_id, ordered=False) if demand is None else demand
    ranked = positions(d, ["owner_id"], [F.col("bookings").desc(), F.col("court_id").asc()],
                       name="_rank", size_name="_n")
    n = F.col("_n").cast("double")
    hi_cut = F.ceil(n * F.lit(float(high)))
    lo_cut = F.ceil(n * F.lit(float(low)))
    hi = ranked.filter(F.col("_rank") <= hi_cut).select(
        "owner_id", F.lit("high").alias("band"), F.col("_rank").alias("position"), "court_id", "name",
        "bookings", "revenue")
    lo = ranked.filter(F.col("_rank") > F.col("_n") - lo_cut).select(
        "owner_id", F.lit("low").alias("band"), (F.col("_n") - F.col("_rank") + 1).alias("position"),
        "court_id", "name", "bookings", "revenue")
    return hi.unionByName(lo)


# ---------------------------------------------------------------- listings per owner

def _owner_bookings_base(t: Tables, where: Column | None = None, fk_checked: bool = False) -> DataFrame:
    """bookings ⋈ courts (owner, court name), restricted to bookings whose user exists (all do when ``fk_checked``)."""
    b = t.bookings if where is None else t.bookings.filter(where)
    courts = t.courts.filter(F.col("owner_id").isNotNull()).select(
        F.col("id").alias("court_id"), "owner_id", F.col("name").alias("court_name"))
    users = t.users.select(F.col("id").alias("user_id"))
    out = b.join(courts, "court_id")
    return out if fk_checked else out.join(users, "user_id", "left_semi")


def _with_user(df: DataFrame, t: Tables, cols: list[str]) -> DataFrame:
    users = t.users.select(F.col("id").alias("user_id"), *cols)
    return df.join(users, "user_id")


def history_directory(t: Tables, page: int, sort: str = "newest", page_size: int = PAGE_SIZE, fk_checked: bool = False) -> DataFrame:
    """(owner_id, booking_date, before): the dates that hold rows of the page, and how many rows of the owner stand before each.

    Counts per owner and date, prefix-summed in page order: narrow columns only, aggregated before any shuffle. Without
    ``fk_checked`` bookings whose user is missing are left out of the counts, as they are of the page. A booking without a
    date, which the schema forbids (``quality.audit_not_null``), is on no page.
    """
    t = t.replace(bookings=t.bookings.filter(F.col("booking_date").isNotNull()))
    if fk_checked:
        counts = t.bookings.groupBy("court_id", "booking_date").agg(F.count(F.lit(1)).alias("n"))
    else:
        users = t.users.select(F.col("id").alias("user_id"))
        counts = t.bookings.groupBy("court_id", "user_id", "booking_date").agg(F.count(F.lit(1)).alias("n")).join(users, "user_id", "left_semi")
        counts = counts.groupBy("court_id", "booking_date").agg(F.sum("n").alias("n"))
    per = counts.join(court_owner(t), "court_id").groupBy("owner_id", "booking_date").agg(F.sum("n").alias("n"))
    day = F.col("booking_date")
    earlier = Window.partitionBy("owner_id").orderBy(day.asc() if sort == "oldest" else day.desc()).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    first, last = (page - 1) * page_size, page * page_size
    return per.filter((F.col("before") < last) & (F.col("before") + F.col("n") > first)).select("owner_id", "booking_date", "before")


def booking_history_page(t: Tables, page: int = 1, sort: str = "newest", page_size: int = PAGE_SIZE, fk_checked: bool = False) -> DataFrame:
    """Page ``page`` of every owner's booking history, newest or oldest first.

    ``history_directory`` names the dates on which a page lies; only bookings of those dates are read wide (dynamic partition
    pruning where bookings are stored by date) and numbered within their date. Any page has the same lazy plan.
    """
    asc = sort == "oldest"
    page = max(int(page), 1)
    order = [F.col(k).asc() if asc else F.col(k).desc() for k in ("start_time", "id")]
    found = history_directory(t, page, sort, page_size, fk_checked)
    found = found.select(F.col("owner_id").alias("_owner"), F.col("booking_date").alias("_date"), "before")
    # one row per calendar day at most: broadcast, so that the scan of bookings stored by date lists those dates only
    days = F.broadcast(found.select(F.col("_date").alias("booking_date")).distinct())
    base = _owner_bookings_base(t.replace(bookings=t.bookings.join(days, "booking_date", "left_semi")), fk_checked=fk_checked)
    base = base.join(found, (F.col("owner_id") == F.col("_owner")) & (F.col("booking_date") == F.col("_date")))
    place = F.col("before") + F.row_number().over(Window.partitionBy("owner_id", "booking_date").orderBy(*order))
    ranked = base.withColumn("_rn", place).filter(F.col("_rn").between((page - 1) * page_size + 1, page * page_size))
    out = _with_user(ranked, t, ["first_name", "last_name", "email"])
    return out.select("owner_id", F.col("id").alias("order_id"), *t.bookings.columns, "court_name",
                      "first_name", "last_name", "email")


def owner_recent_bookings(t: Tables, n: int = 10, confirmed_only: bool = False) -> DataFrame:
    """Newest ``n`` bookings per owner (by created_at, then id).

    Only (owner, created_at, id) and the booking date are ranked; the winners, n per owner, then fetch their wide rows.
    """
    where = (F.col("booking_status") == CONFIRMED) if confirmed_only else None
    narrow = _owner_bookings_base(t, where).select("owner_id", "id", "booking_date", "created_at")
    ranked = top_k(narrow, ["owner_id"], [F.col("created_at").desc(), F.col("id").desc()], k=n, name="_rn")
    winners = ranked.select("owner_id", F.col("id").alias("_id"), F.col("booking_date").alias("_date"))
    rows = t.bookings.join(winners, (F.col("id") == F.col("_id")) & F.col("booking_date").eqNullSafe(F.col("_date"))).drop("_id", "_date")
    rows = rows.join(t.courts.select(F.col("id").alias("court_id"), F.col("name").alias("court_name")), "court_id")
    if confirmed_only:
        out = _with_user(rows, t, ["first_name", "last_name"])
        return out.select("owner_id", "id", "court_name", full_name("first_name", "last_name").alias("player_name"),
                          "booking_date", "start_time", "end_time", _dbl(F.col("total_amount")).alias("total_amount"))
    out = _with_user(rows, t, ["first_name", "last_name", "email"])
    return out.select("owner_id", *t.bookings.columns, "court_name", "first_name", "last_name", "email")


def primary_image(t: Tables) -> DataFrame:
    """One primary image per court (lowest image id); courts without one are absent."""
    return (t.court_images.filter(F.col("is_primary") == 1).groupBy("court_id")
            .agg(F.min_by("image_path", "id").alias("primary_image")))


def demand_cuts(n: int, high: float = HIGH_DEMAND, low: float = LOW_DEMAND) -> tuple[int, int]:
    """Band sizes for ``n`` courts, in the same double arithmetic (for tests)."""
    return math.ceil(n * high), math.ceil(n * low)


