"""Write routes re-aimed as batch jobs over request tables.

Each job takes the current tables plus a requests frame (one row per
incoming request, ordered by ``request_id``) and returns the changed table(s)
and a ``rejected`` frame (request_id, reason) with the reference's messages.
Decisions that depend on earlier requests in the batch ("first one wins")
are made set-based: min-by aggregates per key, never per-request loops.
"""

from __future__ import annotations

from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotwise.functions.calendar import as_of_ts
from slotwise.functions.clock import slot_ts
from slotwise.functions.text import blank
from slotwise.operators.intervals import blocked_rows, first_blocker, proper, taken
from slotwise.operators.search import validate_requests
from slotwise.plans import minutes as M
from slotwise.plans.greedy import first_wins
from slotwise.plans.ids import assign_ids
from slotwise.plans.lineage import cut, cut_even, cut_stored
from slotwise.sources.tables import Tables, ensure_columns

# Messages and constants of the reference's write routes.
MSG_NO_COURT = "Court not found or not available"
MSG_TAKEN = "Time slot is already booked"
MSG_BOOKING_NOT_FOUND = "Booking not found"
MSG_TOO_LATE = "Cannot cancel booking within 2 hours of start time"
MSG_REVIEW_BOOKING = "Booking not found or not completed"
MSG_REVIEW_EXISTS = "Review already submitted for this booking"
MSG_NOT_PAYABLE = "Booking not found or already paid"
MSG_CODE_EXISTS = "Promotion code already exists"
MSG_PROMO_NOT_FOUND = "Promotion not found"
MSG_COURT_NOT_OWNED = "Court not found or you do not have permission to delete it"
MSG_HAS_BOOKINGS = "Cannot delete court with existing bookings. Please contact support."
MSG_COURT_NOT_FOUND = "Court not found"
MSG_NO_OWNER = "Owner profile not found"
MSG_USER_EXISTS = "Username or email already exists"
CANCEL_LEAD_HOURS = 2
ROUNDS_PER_CUT = 3
NOTES_MAX = 255
OPTIONAL_BOOKING_FIELDS = {"voucher_code": ("string", None), "discount_amount": ("decimal(12,2)", None),
                           "notes": ("string", None)}


class Outcome(NamedTuple):
    table: DataFrame
    rejected: DataFrame
    extra: DataFrame | None = None


def _rejected(df: DataFrame, reason: Column | str) -> DataFrame:
    r = F.lit(reason) if isinstance(reason, str) else reason
    return df.select("request_id", r.alias("reason"))


def _fail(d: DataFrame, cond: Column, message: str | Column) -> DataFrame:
    """Record ``message`` as the reason of rows that still have none and meet ``cond``."""
    m = F.lit(message) if isinstance(message, str) else message
    return d.withColumn("reason", F.coalesce(F.col("reason"), F.when(cond, m)))


def _first_wins_rule(d: DataFrame, key: list[str], message: str) -> DataFrame:
    """Among rows still in the running, a row sharing ``key`` with an earlier one (by request_id) fails.

    One partial min aggregate and a join — a hot key never gathers in one task.
    """
    firsts = d.filter(F.col("reason").isNull()).groupBy(*key).agg(F.min("request_id").alias("_first"))
    d = d.join(firsts, key, "left")
    return _fail(d, F.col("_first").isNotNull() & (F.col("request_id") != F.col("_first")), message).drop("_first")


def _split(d: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, rejected (request_id, reason)) of a decision frame."""
    return d.filter(F.col("reason").isNull()).drop("reason"), d.filter(F.col("reason").isNotNull()).select(
        "request_id", "reason")


# ------------------------------------------------------------------ merge

def merge_updates(df: DataFrame, changes: DataFrame, key: str | list[str], columns: list[str],
                  order: str | None = None) -> DataFrame:
    """Keyed column update: matched rows take the new values (NULL included), others keep theirs.

    Several changes for one key: the one with the largest ``order`` wins
    (the last update applied), chosen with a partial max-by aggregate. Without
    ``order`` a key with two different changes is an error when the plan runs.
    """
    keys = [key] if isinstance(key, str) else list(key)
    ch = changes.select(*keys, *columns, *([order] if order else []))
    if order:
        ch = ch.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.col(order)).alias("_v")).select(
            *keys, *[F.col("_v")[c].alias(c) for c in columns])
    else:
        one = F.when(F.count_distinct(F.struct(*columns)) > 1, F.raise_error(F.lit("several changes for one key need an order"))
                     ).otherwise(F.first(F.struct(*columns)))
        ch = ch.groupBy(*keys).agg(one.alias("_v")).select(*keys, *[F.col("_v")[c].alias(c) for c in columns])
    ch = ch.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_matched"))
    j = df.join(ch, keys, "left")
    out = []
    for c in df.columns:
        if c in columns:
            out.append(F.when(F.col("_matched"), F.col(f"_new_{c}").cast(dict(df.dtypes)[c]))
                       .otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return j.select(*out)


def approve_courts(t: Tables, requests: DataFrame) -> DataFrame:
    """requests(id, approved): is_approved = 1 when approved == 'true', else 0."""
    ch = requests.select("id", F.when(F.col("approved") == "true", 1).otherwise(0).alias("is_approved"))
    return merge_updates(t.courts, ch, "id", ["is_approved"])


def toggle_promotions(t: Tables, requests: DataFrame) -> Outcome:
    """requests(request_id, id): each toggle flips is_active; an even number of toggles cancels out."""
    counts = requests.groupBy("id").agg(F.count(F.lit(1)).alias("_n"))
    flips = counts.filter(F.col("_n") % 2 == 1).join(t.promotions.select("id", "is_active"), "id").select(
        "id", (1 - F.coalesce(F.col("is_active"), F.lit(0))).cast("int").alias("is_active"))
    missing = requests.join(t.promotions.select("id"), "id", "left_anti")
    return Outcome(merge_updates(t.promotions, flips, "id", ["is_active"]), _rejected(missing, MSG_PROMO_NOT_FOUND))


# ------------------------------------------------------------------ bookings

def slots_to_booking(slots: DataFrame, courts: DataFrame) -> DataFrame:
    """Collapse chosen hourly slots per request: start = min, end = max + 1 h, hours = COUNT (gaps ignored)."""
    s = slots.select("request_id", "court_id", "booking_date", "slot").dropDuplicates(["request_id", "slot"])
    g = s.groupBy("request_id", "court_id", "booking_date").agg(
        F.min("slot").alias("start_time"), F.max("slot").alias("_last"), F.count(F.lit(1)).alias("total_hours"))
    end_h = F.split_part(F.col("_last"), F.lit(":"), F.lit(1)).try_cast("int") + 1
    rate = courts.select(F.col("id").alias("court_id"), "hourly_rate")
    return g.join(rate, "court_id").select(
        "request_id", "court_id", "booking_date", "start_time",
        F.concat(F.lpad(end_h.cast("string"), 2, "0"), F.lit(":00")).alias("end_time"),
        F.col("total_hours").cast("int").alias("total_hours"),
        (F.col("total_hours").cast("double") * F.col("hourly_rate").cast("double")).alias("amount"))


_GREEDY_SCHEMA = T.StructType([T.StructField("request_id", T.LongType()), T.StructField("admitted", T.BooleanType())])


def _greedy_admission(strict: bool):
    """Grouped-map body for one court-day: requests in id order, each admitted unless an
    already admitted one blocks it. The minutes of the admitted ones are the bits of one number."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        minutes = 0
        kept: list[tuple[int, int]] = []   # asked only by intervals that cover no minute, and only under the strict test
        odd: list[tuple[int, int]] = []    # admitted intervals that cover no minute
        out = []
        for rid, s, e in pdf.sort_values("request_id")[["request_id", "s", "e"]].itertuples(index=False):
            if pd.isna(s) or pd.isna(e):
                out.append((int(rid), True))
                continue
            s, e = int(s), int(e)
            if not strict:
                blocked = minutes >> s & 1 or (e > 0 and minutes >> (e - 1) & 1)
            elif s < e:
                blocked = minutes >> s & ((1 << (e - s)) - 1) or any(os < e and oe > s for os, oe in odd)
            else:
                blocked = any(os < e and oe > s for os, oe in kept)
            if not blocked:
                kept.append((s, e))
                if s < e:
                    minutes |= ((1 << (e - s)) - 1) << s
                else:
                    odd.append((s, e))
            out.append((int(rid), not blocked))
        return pd.DataFrame(out, columns=["request_id", "admitted"])

    return run


class Admission(NamedTuple):
    bookings: DataFrame   # the new booking rows
    rejected: DataFrame   # request_id, reason
    usage: DataFrame      # voucher_usage rows of the new bookings
    promotions: DataFrame  # id, used_count of the promotions that the new bookings used


def admit_bookings(t: Tables, requests: DataFrame, as_of=None, strict: bool = False) -> Admission:
    """Admit booking requests in request_id order, as the reference does one POST at a time.

    Rules: required fields → court active and approved → no conflict with an
    existing confirmed booking or an earlier ADMITTED request → price.

    Everything that can be decided set-based is:

    1. validation and court visibility are joins;
    2. a request that an existing confirmed booking blocks is rejected: a bit
       test on the minutes of its court-day (``plans.minutes``);
    3. among requests with the same (court, date, start, end) and start < end
       only the first can be admitted — a later twin meets the first or
       whatever blocked it — settled with a min aggregate;
    4. a request whose minutes no earlier request covers is admitted;
    5. only court-days that still hold undecided requests go through one
       grouped-map greedy pass, and only with their surviving requests (after
       3. these are distinct intervals, a number bounded by the 'HH:MM' grid
       whatever the data size). A later twin of an empty or inverted interval
       blocks and is blocked by the same requests as the first of its kind, so
       it stays out of the pass and fails iff an earlier admitted request
       blocks it.

    Each of the decision frame, the narrow table of distinct intervals and the
    refused requests is checkpointed once, so no stage runs again for another output.
    The stored side is cut to the requests' dates and court-days before its bits are set. Every voucher booking raises the
    ``used_count`` of its promotion; the changed rows are returned.
    """
    key = "request_id"
    day, interval = list(M.DAY), [*M.DAY, "start_time", "end_time"]
    requests = ensure_columns(requests, OPTIONAL_BOOKING_FIELDS)
    # one decision frame: every request with the reason it fails (NULL = still in the running)
    visible = t.courts.filter((F.col("is_active") == 1) & (F.col("is_approved") == 1)).select(
        F.col("id").alias("court_id"), "hourly_rate")
    d = (validate_requests(requests, "booking").drop("valid")
         .join(visible, "court_id", "left")
         .withColumn("reason", F.coalesce("reason", F.when(F.col("hourly_rate").isNull(), F.lit(MSG_NO_COURT)))))
    iv = d.filter(F.col("reason").isNull()).select(key, *interval)
    first_day, last_day = iv.agg(F.min("booking_date")).scalar(), iv.agg(F.max("booking_date")).scalar()
    existing = (t.bookings.filter((F.col("booking_status") == "confirmed") & F.col("booking_date").between(first_day, last_day))
                .join(iv.select(*day).distinct(), day, "left_semi").select(*interval))
    if strict:  # read three times; equal intervals block alike
        existing = cut(existing.distinct())
    d = d.join(M.occupancy(existing), day, "left").withColumn(
        "reason", F.coalesce("reason", F.when(taken(F.col("hours"), strict), F.lit(MSG_TAKEN)))).drop("hours")
    if strict:  # intervals that cover no minute
        distinct = existing.withColumn("id", F.lit(0))
        odd = blocked_rows(iv.filter(~proper()), distinct, strict, later_id=key).unionByName(
            blocked_rows(iv.filter(proper()), distinct.filter(~proper()), strict, later_id=key)).distinct().withColumn("_odd", F.lit(True))
        d = _fail(d.join(odd, key, "left"), F.col("_odd"), MSG_TAKEN).drop("_odd")
    d = cut(d)

    alive = d.filter(F.col("reason").isNull()).select(key, *interval)
    kinds = alive.groupBy(*interval).agg(F.min(key).alias(key))
    contested = F.coalesce(first_blocker(F.col("firsts"), strict) < F.col(key), F.lit(False))
    if strict:
        contested = contested | ~proper()
    kinds = cut(kinds.join(M.first_covers(kinds, key, starts=strict), day, "left").select(key, *interval, contested.alias("_contested")))
    hot_days = kinds.filter("_contested").select(*day).distinct()
    decided = (kinds.join(hot_days, day, "left_semi").select(key, *day, M.minute_of("start_time").alias("s"), M.minute_of("end_time").alias("e"))
               .groupBy(*day).applyInPandas(_greedy_admission(strict), _GREEDY_SCHEMA))
    refused = cut(decided.filter(~F.col("admitted")).select(key))
    twins = alive.join(kinds.select(*interval, F.col(key).alias("_first")), interval).filter(F.col(key) != F.col("_first"))
    odd_twins = blocked_rows(twins.filter(~proper()), kinds.join(refused, key, "left_anti"), strict, ordered=True, later_id=key, earlier_id=key)
    lost = twins.filter(proper()).select(key).unionByName(refused).unionByName(odd_twins).withColumn(
        "_lost", F.lit(True))
    d = cut(d.join(lost, key, "left").withColumn(
        "reason", F.coalesce("reason", F.when(F.col("_lost"), F.lit(MSG_TAKEN)))).drop("_lost"))

    accepted = d.filter(F.col("reason").isNull())
    rejected = d.filter(F.col("reason").isNotNull()).select(key, "reason")

    has_voucher = ~blank("voucher_code") & ~blank("discount_amount", numeric=True)
    total = F.col("hourly_rate").cast("double") * F.col("total_hours").cast("double") - F.when(
        has_voucher, F.col("discount_amount").cast("double")).otherwise(0.0)
    created = F.col("requested_at").cast("timestamp_ntz") if "requested_at" in requests.columns else as_of_ts(as_of)
    notes = F.substring(F.col("notes").cast("string"), 1, NOTES_MAX)
    rows = accepted.select(
        key, "court_id", "user_id", F.col("booking_date").cast("date").alias("booking_date"),
        "start_time", "end_time", F.col("total_hours").cast("int").alias("total_hours"),
        total.cast("decimal(12,2)").alias("total_amount"),
        F.when(notes != "", notes).cast("string").alias("notes"),
        F.lit("pending").alias("payment_status"), F.lit("confirmed").alias("booking_status"),
        F.when(~blank("voucher_code"), F.col("voucher_code")).cast("string").alias("voucher_code"),
        F.coalesce(F.col("discount_amount"), F.lit(0)).cast("decimal(12,2)").alias("discount_amount"),
        created.alias("created_at"), has_voucher.alias("_voucher"))
    rows = assign_ids(rows, t.bookings, [F.col(key)])
    codes = t.promotions.select(F.col("id").alias("promotion_id"), F.upper("code").alias("_code"))
    usage = (rows.filter("_voucher").withColumn("_code", F.upper("voucher_code")).join(codes, "_code", "left")
             .select(key, "promotion_id", F.col("id").alias("booking_id"), "user_id",
                     "discount_amount", F.col("created_at").alias("used_at")))
    usage = assign_ids(usage, t.voucher_usage, [F.col(key)]).drop(key)
    cols = [c for c in t.bookings.columns if c in rows.columns]
    used = usage.groupBy(F.col("promotion_id").alias("id")).agg(F.count(F.lit(1)).alias("_n"))
    raised = t.promotions.select("id", "used_count").join(used, "id").select(
        "id", (F.coalesce("used_count", F.lit(0)) + F.col("_n")).cast("int").alias("used_count"))
    return Admission(rows.select(*cols), rejected, usage, raised)


def cancel_bookings(t: Tables, requests: DataFrame, as_of, lead_hours: int = CANCEL_LEAD_HOURS) -> Outcome:
    """requests(request_id, booking_id, user_id): own booking starting at least ``lead_hours`` after as_of."""
    b = t.bookings.select(F.col("id").alias("booking_id"), "user_id", "booking_date", "start_time",
                          F.lit(True).alias("_found"))
    seconds = F.timestamp_diff("SECOND", as_of_ts(as_of), slot_ts("booking_date", "start_time"))
    d = requests.withColumn("reason", F.lit(None).cast("string")).join(b, ["booking_id", "user_id"], "left")
    d = _fail(d, F.col("_found").isNull(), MSG_BOOKING_NOT_FOUND)
    d = _fail(d, F.coalesce(seconds < lead_hours * 3600, F.lit(False)), MSG_TOO_LATE)
    ok, rejected = _split(d)
    ok = ok.select(F.col("booking_id").alias("id")).distinct().withColumn("booking_status", F.lit("cancelled"))
    return Outcome(merge_updates(t.bookings, ok, "id", ["booking_status"]), rejected)


def admit_reviews(t: Tables, requests: DataFrame, as_of=None) -> Outcome:
    """requests(request_id, booking_id, user_id, rating, comment) → new review rows.

    Rating 1..5 → booking owned and 'completed' → no review of that booking yet
    (nor an earlier accepted request for it in this batch). One decision
    frame: each rule fills ``reason`` through a left join.

    Requests are shuffled once, against completed bookings that know whether
    they are reviewed, and what became of them is stored; only those still in
    the running meet again for the first of each booking. Columns of the new
    review go along only as long as a request may still become one.
    """
    carried = ["user_id", "booking_id", *[c for c in ("rating", "comment", "requested_at") if c in requests.columns]]
    d = validate_requests(requests, "review")
    d = d.select("request_id", "reason", "user_id", "booking_id", *[F.when(F.col("valid"), F.col(c)).alias(c) for c in carried[2:]])
    reviewed = t.reviews.select("booking_id").dropna().distinct().withColumn("_reviewed", F.lit(True))
    done = t.bookings.filter(F.col("booking_status") == "completed").select(
        F.col("id").alias("booking_id"), "user_id", "court_id", F.lit(True).alias("_done")).join(reviewed, "booking_id", "left")
    d = _fail(d.join(done, ["booking_id", "user_id"], "left"), F.col("_done").isNull(), MSG_REVIEW_BOOKING)
    d = _fail(d, F.col("_reviewed").isNotNull(), MSG_REVIEW_EXISTS)
    judged = cut_stored(d.select("request_id", "reason", *[F.when(F.col("reason").isNull(), F.col(c)).alias(c) for c in (*carried, "court_id")]))
    turns = cut_stored(_first_wins_rule(judged.filter(F.col("reason").isNull()), ["booking_id"], MSG_REVIEW_EXISTS))
    first, late = _split(turns)
    rejected = _split(judged)[1].unionByName(late)
    created = F.col("requested_at").cast("timestamp_ntz") if "requested_at" in requests.columns else as_of_ts(as_of)
    rows = first.select("request_id", "court_id", "user_id", "booking_id", F.col("rating").cast("int").alias("rating"),
                        F.col("comment").cast("string").alias("comment") if "comment" in first.columns
                        else F.lit(None).cast("string").alias("comment"), created.alias("created_at"))
    rows = assign_ids(rows, t.reviews, [F.col("request_id")]).drop("request_id")
    return Outcome(t.reviews.unionByName(rows.select(*t.reviews.columns), allowMissingColumns=True), rejected, rows)


class Settlement(NamedTuple):
    bookings: DataFrame
    payments: DataFrame
    rejected: DataFrame


def settle_payments(t: Tables, requests: DataFrame, as_of) -> Settlement:
    """requests(request_id, booking_id, user_id): own booking with payment 'pending' → 'paid' + a payment row."""
    pend = t.bookings.filter(F.col("payment_status") == "pending").select(
        F.col("id").alias("booking_id"), "user_id", "total_amount", F.lit(True).alias("_pending"))
    d = requests.withColumn("reason", F.lit(None).cast("string")).join(pend, ["booking_id", "user_id"], "left")
    d = _fail(d, F.col("_pending").isNull(), MSG_NOT_PAYABLE)
    d = _first_wins_rule(d, ["booking_id"], MSG_NOT_PAYABLE)
    first, rejected = _split(d)
    # numbering checkpoints the narrow rows; both tables go on from there
    pay = assign_ids(first.select("request_id", "booking_id", F.col("total_amount").cast("decimal(12,2)").alias("amount")),
                     t.payments, [F.col("request_id")])
    paid = pay.select(F.col("booking_id").alias("id"), F.lit("paid").alias("payment_status"))
    pay = pay.select("id", "booking_id", "amount", F.lit("online").alias("payment_method"), F.lit(None).cast("string").alias("transaction_id"),
                     F.lit("completed").alias("status"), as_of_ts(as_of).alias("created_at"))
    return Settlement(merge_updates(t.bookings, paid, "id", ["payment_status"]),
                      t.payments.unionByName(pay.select(*t.payments.columns)), rejected)


def post_payouts(t: Tables, amounts: DataFrame, as_of, amount_col: str = "pending_amount") -> DataFrame:
    """Append one 'completed' payout per (owner_id, amount) row, dated as_of."""
    rows = amounts.select("owner_id", F.col(amount_col).cast("decimal(12,2)").alias("amount"),
                          F.lit("completed").alias("status"), as_of_ts(as_of).alias("payout_date"),
                          as_of_ts(as_of).alias("created_at"))
    rows = assign_ids(rows, t.payouts, [F.col("owner_id")])
    return t.payouts.unionByName(rows, allowMissingColumns=True)


# ------------------------------------------------------------------ promotions

PROMO_FIELDS = ("code", "title", "description", "discount_type", "discount_value", "min_booking_amount",
                "max_discount_amount", "start_date", "end_date", "usage_limit", "target_type")


class PromotionUpsert(NamedTuple):
    promotions: DataFrame
    accepted: DataFrame   # request_id, promotion_id, target_type
    rejected: DataFrame


def _code_decisions(requests: DataFrame, promotions: DataFrame) -> DataFrame:
    """(request_id, clash) for ``requests(request_id, id, _ucode)`` taken one at a time in request_id order.

    A request clashes when another promotion holds its code at its turn; an
    accepted edit gives up its old code and an accepted request holds its new
    one. Rounds: a request is decided once no undecided earlier request
    touches its code, its promotion, or the promotion that holds its code; it
    clashes at once when no earlier edit of that holder is left to free the
    code, so a code with many requests takes two rounds. Decided rows leave,
    and each round's rows are checkpointed once. The codes in force are those that
    requests ask for or give up; they follow from the rounds before and are
    checkpointed every few rounds, so that the plan stays short.

    Every round joins by a shuffle, so that no round's rows go to the driver, and what is checkpointed is rebalanced
    first: the number of partitions follows the rows that are left, however many rounds' rows are put together.
    """
    key = "request_id"
    shuffled = lambda df: df.hint("merge")
    pending = cut_even(requests.select(key, "id", "_ucode"))
    asked, edited = pending.select(F.col("_ucode").alias("_code")).distinct(), pending.select(F.col("id").alias("_holder")).dropna().distinct()
    codes = promotions.select(F.upper("code").alias("_code"), F.col("id").alias("_holder"))
    # of the other promotions neither the code nor the holder can matter to any request
    state = cut_even(codes.join(shuffled(asked.withColumn("_asked", F.lit(True))), "_code", "left")
                 .join(shuffled(edited.withColumn("_edited", F.lit(True))), "_holder", "left").filter("_asked OR _edited").select("_code", "_holder"))
    decided, rounds = None, 0
    while not pending.isEmpty():
        held = state.groupBy("_code").agg(F.min("_holder").alias("_holder"), F.max("_holder").alias("_last"))
        p = pending.join(shuffled(held), F.col("_ucode") == F.col("_code"), "left").drop("_code")
        touched = p.select(key, F.concat(F.lit("c"), F.col("_ucode")).alias("_what"))
        for c in ("id", "_holder", "_last"):
            touched = touched.unionByName(p.filter(F.col(c).isNotNull()).select(key, F.concat(F.lit("p"), F.col(c)).alias("_what")))
        first = touched.groupBy("_what").agg(F.min(key).alias("_first"))
        waits = touched.join(shuffled(first), "_what").filter(F.col("_first") < F.col(key)).select(key).distinct().withColumn("_waits", F.lit(True))
        edits = pending.filter(F.col("id").isNotNull()).groupBy(F.col("id").alias("_holder")).agg(F.min(key).alias("_edited"))
        clash = F.col("_holder").isNotNull() & ((F.col("_holder") != F.col("_last")) | ~F.col("_holder").eqNullSafe(F.col("id")))
        stuck = clash & (F.col("_holder") == F.col("_last")) & (F.coalesce("_edited", F.col(key)) >= F.col(key))
        p = p.join(shuffled(waits), key, "left").join(shuffled(edits), "_holder", "left").withColumn("clash", clash).withColumn(
            "_done", F.col("_waits").isNull() | stuck)
        p = cut_even(p.select(key, "id", "_ucode", "clash", "_done"))
        done = p.filter("_done").select(key, "clash")
        decided = done if decided is None else decided.unionByName(done)
        taken = p.filter("_done AND NOT clash")
        state = state.join(shuffled(taken.select(F.col("id").alias("_holder")).dropna()), "_holder", "left_anti").select("_code", "_holder").unionByName(
            taken.select(F.col("_ucode").alias("_code"), F.coalesce("id", -F.col(key)).alias("_holder")))
        rounds += 1
        state = state if rounds % ROUNDS_PER_CUT else cut_even(state)
        pending = p.filter("NOT _done").select(key, "id", "_ucode")
    return requests.select(key, F.lit(False).alias("clash")).limit(0) if decided is None else decided


def upsert_promotions(t: Tables, requests: DataFrame, as_of=None) -> PromotionUpsert:
    """Create (id NULL) or edit (id given) promotions from requests.

    Required fields → edits of unknown ids rejected → code unique (upper-cased)
    among the promotions as they are at the request's turn: an edit may keep
    its own code, and a code that an earlier edit gave up is free again →
    defaults: min 0, max NULL when blank or 0, usage_limit −1, target 'all'.
    """
    d = validate_requests(requests, "promotion").drop("valid").withColumn("_ucode", F.upper("code"))
    known = t.promotions.select("id", F.lit(True).alias("_known"))
    d = _fail(d.join(known, "id", "left"), F.col("id").isNotNull() & F.col("_known").isNull(), MSG_PROMO_NOT_FOUND)
    codes = _code_decisions(d.filter(F.col("reason").isNull()), t.promotions)
    d = _fail(d.join(codes.hint("merge"), "request_id", "left"), F.coalesce("clash", F.lit(False)), MSG_CODE_EXISTS).drop("clash")
    ok, rejected = _split(cut_even(d))
    vals = {
        "code": F.col("_ucode"),
        "min_booking_amount": F.when(blank("min_booking_amount", True), F.lit(0)).otherwise(
            F.col("min_booking_amount")).cast("decimal(12,2)"),
        "max_discount_amount": F.when(blank("max_discount_amount", True), F.lit(None)).otherwise(
            F.col("max_discount_amount")).cast("decimal(12,2)"),
        "usage_limit": F.when(blank("usage_limit", True), F.lit(-1)).otherwise(F.col("usage_limit")).cast("int"),
        "target_type": F.when(blank("target_type"), F.lit("all")).otherwise(F.col("target_type")),
    }
    created_at = F.col("requested_at").cast("timestamp_ntz") if "requested_at" in requests.columns \
        else as_of_ts(as_of)
    shaped = ok.select("request_id", "id", "created_by", created_at.alias("created_at"),
                       *[vals.get(c, F.col(c) if c in ok.columns else F.lit(None)).alias(c) for c in PROMO_FIELDS])
    edits = shaped.filter(F.col("id").isNotNull())
    promotions = merge_updates(t.promotions, edits, "id", list(PROMO_FIELDS), order="request_id")
    creates = assign_ids(shaped.filter(F.col("id").isNull()).drop("id"), t.promotions, [F.col("request_id")])
    types = dict(t.promotions.dtypes)
    new_rows = creates.select(*[(F.col(c) if c in creates.columns else F.lit(None)).cast(types[c]).alias(c)
                                for c in t.promotions.columns if c not in ("is_active", "used_count")],
                              F.lit(1).alias("is_active"), F.lit(0).alias("used_count"))
    promotions = promotions.unionByName(new_rows.select(*t.promotions.columns))
    accepted = edits.select("request_id", F.col("id").alias("promotion_id"), "target_type").unionByName(
        creates.select("request_id", F.col("id").alias("promotion_id"), "target_type"))
    return PromotionUpsert(promotions, accepted, rejected)


def replace_promotion_targets(t: Tables, accepted: DataFrame, target_users: DataFrame, as_of=None) -> DataFrame:
    """Drop the targets of every accepted promotion; re-insert the listed users where target_type is 'specific'.

    ``target_users`` is (request_id, user_ids array), the request's user list,
    or its exploded form (request_id, user_id).
    """
    if "user_ids" in target_users.columns:
        target_users = target_users.select("request_id", F.explode("user_ids").alias("user_id"))
    kept = t.promotion_targets.join(accepted.select(F.col("promotion_id")).distinct(), "promotion_id", "left_anti")
    spec = accepted.filter(F.col("target_type") == "specific").select("request_id", "promotion_id")
    new = spec.join(target_users.select("request_id", "user_id"), "request_id").select(
        "request_id", "promotion_id", F.col("user_id").cast("bigint").alias("user_id"),
        *([as_of_ts(as_of).alias("created_at")] if "created_at" in t.promotion_targets.columns else []))
    new = assign_ids(new, t.promotion_targets, [F.col("request_id"), F.col("user_id")]).drop("request_id")
    return kept.unionByName(new.select(*t.promotion_targets.columns))


def delete_promotions(t: Tables, ids: DataFrame) -> Tables:
    """Remove promotions with their targets and usage rows (three anti joins)."""
    gone = ids.select(F.col("id").alias("promotion_id")).distinct()
    return t.replace(
        promotions=t.promotions.join(gone.withColumnRenamed("promotion_id", "id"), "id", "left_anti"),
        promotion_targets=t.promotion_targets.join(gone, "promotion_id", "left_anti"),
        voucher_usage=t.voucher_usage.join(gone, "promotion_id", "left_anti"))


# ------------------------------------------------------------------ courts

class CourtChange(NamedTuple):
    courts: DataFrame
    court_images: DataFrame
    rejected: DataFrame


def _ownership(t: Tables) -> DataFrame:
    """(court_id, user_id, _owned): each court with the user id of its owner."""
    return t.courts.select(F.col("id").alias("court_id"), "owner_id").join(
        t.court_owners.select(F.col("id").alias("owner_id"), F.col("user_id")), "owner_id").select(
        "court_id", "user_id", F.lit(True).alias("_owned"))


def delete_courts(t: Tables, requests: DataFrame) -> CourtChange:
    """requests(request_id, court_id, user_id): owned courts without bookings are removed with their images."""
    d = requests.withColumn("reason", F.lit(None).cast("string")).join(_ownership(t), ["court_id", "user_id"], "left")
    d = _fail(d, F.col("_owned").isNull(), MSG_COURT_NOT_OWNED)
    booked = t.bookings.select("court_id").distinct().withColumn("_booked", F.lit(True))
    d = _fail(d.join(booked, "court_id", "left"), F.col("_booked").isNotNull(), MSG_HAS_BOOKINGS)
    ok, rejected = _split(d)
    gone = ok.select("court_id").distinct()
    courts = t.courts.join(gone.withColumnRenamed("court_id", "id"), "id", "left_anti")
    images = t.court_images.join(gone, "court_id", "left_anti")
    return CourtChange(courts, images, rejected)


COURT_EDIT_FIELDS = ("name", "description", "address", "latitude", "longitude", "court_type", "indoor_outdoor",
                     "has_ac", "has_food", "has_rest_area", "has_changing_room", "has_parking", "hourly_rate",
                     "open_time", "close_time")


def _court_values(df: DataFrame) -> dict[str, Column]:
    types = dict(df.dtypes)

    def col(c):
        return F.col(c) if c in df.columns else F.lit(None)

    def flag(c):
        # `x ? 1 : 0` in JavaScript: text is true unless empty, numbers unless 0, NULL is false
        numeric = c in types and not types[c].startswith(("string", "varchar", "char"))
        return F.when(~blank(col(c), numeric), 1).otherwise(0)

    return {
        "name": col("name"), "description": col("description"), "address": col("address"),
        "latitude": F.when(blank(col("latitude"), True), None).otherwise(col("latitude")).cast("double"),
        "longitude": F.when(blank(col("longitude"), True), None).otherwise(col("longitude")).cast("double"),
        "court_type": F.when(blank(col("court_type")), "synthetic").otherwise(col("court_type")),
        "indoor_outdoor": F.when(blank(col("indoor_outdoor")), "indoor").otherwise(col("indoor_outdoor")),
        "has_ac": flag("has_ac"), "has_food": flag("has_food"), "has_rest_area": flag("has_rest_area"),
        "has_changing_room": flag("has_changing_room"), "has_parking": flag("has_parking"),
        "hourly_rate": col("hourly_rate").cast("decimal(12,2)"),
        "open_time": F.when(blank(col("open_time")), "06:00").otherwise(col("open_time")),
        "close_time": F.when(blank(col("close_time")), "22:00").otherwise(col("close_time")),
    }


def upsert_courts(t: Tables, requests: DataFrame, new_images: DataFrame | None = None,
                  removed_images: DataFrame | None = None, as_of=None) -> CourtChange:
    """Add courts (id NULL) or edit owned courts (id given), with image rows appended / removed.

    Adds need name, address and rate, and an owner profile for the user; they
    start active and unapproved. Edits need ownership and overwrite the 15 form
    fields (defaults: synthetic, indoor, 06:00, 22:00; flags to 0/1; blank
    coordinates to NULL). New images get is_primary 0; removals only touch
    images of the edited court. One decision frame covers both kinds.
    """
    vals = _court_values(requests)
    created_at = F.col("requested_at").cast("timestamp_ntz") if "requested_at" in requests.columns \
        else as_of_ts(as_of)
    is_add = F.col("id").isNull()
    d = (validate_requests(requests, "court").drop("valid")
         .withColumn("reason", F.when(is_add, F.col("reason")))
         .withColumn("court_id", F.col("id"))
         .join(_ownership(t), ["court_id", "user_id"], "left")
         .join(t.court_owners.groupBy("user_id").agg(F.min("id").alias("_owner_id")), "user_id", "left"))
    d = _fail(d, ~is_add & F.col("_owned").isNull(), MSG_COURT_NOT_FOUND)
    d = _fail(d, is_add & F.col("_owner_id").isNull(), MSG_NO_OWNER)
    ok, rejected = _split(d)
    ok = ok.select("request_id", "id", F.col("_owner_id").alias("owner_id"),
                   *[vals[c].alias(c) for c in COURT_EDIT_FIELDS], created_at.alias("created_at"))
    # edits
    edit_rows = ok.filter(F.col("id").isNotNull())
    courts = merge_updates(t.courts, edit_rows, "id", list(COURT_EDIT_FIELDS), order="request_id")
    # adds
    add_rows = assign_ids(ok.filter(F.col("id").isNull()).drop("id").withColumn("is_active", F.lit(1))
                          .withColumn("is_approved", F.lit(0)), t.courts, [F.col("request_id")])
    types = dict(t.courts.dtypes)
    courts = courts.unionByName(add_rows.select(*[(F.col(c) if c in add_rows.columns else F.lit(None))
                                                  .cast(types[c]).alias(c) for c in t.courts.columns]))
    # images: resolve each request's court id (edit target or new id)
    target = edit_rows.select("request_id", F.col("id").alias("court_id"), "created_at").unionByName(
        add_rows.select("request_id", F.col("id").alias("court_id"), "created_at"))
    images = t.court_images
    if removed_images is not None:
        rm = removed_images.join(target, "request_id").select(F.col("image_id").alias("id"), "court_id")
        images = images.join(rm, ["id", "court_id"], "left_anti")
    if new_images is not None:
        new = new_images.join(target, "request_id").select(
            "request_id", "court_id", "image_path", F.lit(0).alias("is_primary"), "created_at")
        new = assign_ids(new, t.court_images, [F.col("request_id"), F.col("image_path")]).drop("request_id")
        images = images.unionByName(new.select(*[c for c in images.columns]), allowMissingColumns=True)
    return CourtChange(courts, images, rejected)


# ------------------------------------------------------------------ users

class Registration(NamedTuple):
    users: DataFrame
    court_owners: DataFrame
    rejected: DataFrame


def admit_registrations(t: Tables, requests: DataFrame, as_of=None) -> Registration:
    """Register users in request order; reject when the username OR e-mail is taken
    (by an existing user or an earlier registered request). Owners also get a
    profile named "<first> <last>'s Courts"."""
    fresh = (requests.join(t.users.select("username").dropna().distinct(), "username", "left_anti")
             .join(t.users.select("email").dropna().distinct(), "email", "left_anti"))
    clash = requests.join(fresh.select("request_id"), "request_id", "left_anti")
    kept, later = first_wins(fresh, [["username"], ["email"]], "request_id")
    created = F.col("requested_at").cast("timestamp_ntz") if "requested_at" in requests.columns else as_of_ts(as_of)
    rows = kept.select("request_id", "username", "email",
                       F.when(blank("role"), "user").otherwise(F.col("role")).alias("role"),
                       "first_name", "last_name", created.alias("created_at"))
    rows = assign_ids(rows, t.users, [F.col("request_id")])
    users = t.users.unionByName(rows.drop("request_id"), allowMissingColumns=True)
    js = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("undefined"))  # noqa: E731  (template literal)
    owners = rows.filter(F.col("role") == "owner").select(
        "request_id", F.col("id").alias("user_id"),
        F.concat(js("first_name"), F.lit(" "), js("last_name"), F.lit("'s Courts")).alias("business_name"),
        F.col("created_at"))
    owners = assign_ids(owners, t.court_owners, [F.col("request_id")]).drop("request_id")
    court_owners = t.court_owners.unionByName(owners, allowMissingColumns=True)
    rejected = _rejected(clash, MSG_USER_EXISTS).unionByName(_rejected(later, MSG_USER_EXISTS))
    return Registration(users, court_owners, rejected)
