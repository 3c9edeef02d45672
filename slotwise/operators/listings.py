"""Joined listings: admin, owner and user views of bookings, courts, payouts, promotions.

Every listing takes ``after`` and ``limit`` for one page of it, see ``plans.paging``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.functions.text import full_name
from slotwise.plans.lineage import cut
from slotwise.plans.paging import listing
from slotwise.plans.ranking import positions, top_k
from slotwise.sources.tables import Tables


def _users(t: Tables, key: str, *cols: str) -> DataFrame:
    return t.users.select(F.col("id").alias(key), *cols)


def _owners(t: Tables, *cols: str) -> DataFrame:
    return t.court_owners.select(F.col("id").alias("owner_id"), *cols)


def _court_cols(t: Tables, *cols) -> DataFrame:
    return t.courts.select(F.col("id").alias("court_id"), *cols)


def recent_bookings(t: Tables, n: int = 10, fk_checked: bool = False) -> DataFrame:
    """Newest ``n`` bookings platform-wide with court name and booker's names.

    The inner joins drop bookings whose court or user is missing, so more than
    the newest ``n`` may be needed: the newest 2n are taken (a per-task top-k,
    no shuffle of bookings) and only their keys are looked up; while fewer than
    ``n`` have both, twice as many are taken. With ``fk_checked=True`` (foreign keys
    audited clean, see ``quality.audit_foreign_keys``) no booking can be dropped,
    so the newest ``n`` are enough and the plan is lazy.
    """
    order = [F.col("created_at").desc_nulls_last(), F.col("id").desc()]
    taken = n if fk_checked else 2 * n
    b = t.bookings.orderBy(*order).limit(taken)
    while not fk_checked:
        b = cut(b)
        whole = b.join(_court_cols(t), "court_id", "left_semi").join(_users(t, "user_id"), "user_id", "left_semi")
        if whole.count() >= n or b.count() < taken:
            break
        taken *= 2
        b = t.bookings.orderBy(*order).limit(taken)
    out = (b.join(_court_cols(t, F.col("name").alias("court_name")), "court_id")
           .join(_users(t, "user_id", "first_name", "last_name"), "user_id"))
    return (out.orderBy(*order).limit(n)
            .select(*t.bookings.columns, "court_name", "first_name", "last_name"))


def pending_courts(t: Tables, ordered: bool = True, after=None, limit: int | None = None) -> DataFrame:
    """Courts awaiting approval, with owner business and owner user names."""
    owners = _owners(t, "business_name", F.col("user_id").alias("_owner_user"))
    users = _users(t, "_owner_user", "first_name", "last_name")
    out = (t.courts.filter(F.col("is_approved") == 0).join(owners, "owner_id").join(users, "_owner_user")
           .select(*t.courts.columns, "business_name", "first_name", "last_name"))
    return listing(out, ["created_at"], ordered, after, limit)


def admin_courts(t: Tables, ordered: bool = True, after=None, limit: int | None = None) -> DataFrame:
    """All courts with owner names, booking count (any status) and average rating."""
    owners = _owners(t, "business_name", F.col("user_id").alias("_owner_user"))
    users = _users(t, "_owner_user", "first_name", "last_name")
    nb = t.bookings.groupBy(F.col("court_id").alias("id")).agg(F.count(F.lit(1)).alias("booking_count"))
    nr = t.reviews.groupBy(F.col("court_id").alias("id")).agg(F.avg("rating").alias("avg_rating"))
    out = (t.courts.join(owners, "owner_id").join(users, "_owner_user")
           .join(nb, "id", "left").join(nr, "id", "left")
           .select(*t.courts.columns, "business_name", "first_name", "last_name",
                   F.coalesce("booking_count", F.lit(0)).cast("bigint").alias("booking_count"), "avg_rating"))
    return listing(out, ["created_at"], ordered, after, limit)


def admin_bookings(t: Tables, ordered: bool = True, after=None, limit: int | None = None) -> DataFrame:
    """Every booking with court, owner business and booker details.

    The court → owner chain is joined first (court-sized), so bookings take
    part in one join per key instead of being reshuffled by owner_id.
    """
    courts = _court_cols(t, F.col("name").alias("court_name"), "owner_id").join(
        _owners(t, "business_name"), "owner_id").drop("owner_id")
    out = (t.bookings.join(courts, "court_id")
           .join(_users(t, "user_id", "first_name", "last_name", "email"), "user_id")
           .select(*t.bookings.columns, "court_name", "business_name", "first_name", "last_name", "email"))
    return listing(out, ["created_at"], ordered, after, limit)


def payout_list(t: Tables, ordered: bool = True, after=None, limit: int | None = None) -> DataFrame:
    owners = _owners(t, "business_name", F.col("user_id").alias("_owner_user"))
    out = (t.payouts.join(owners, "owner_id").join(_users(t, "_owner_user", "first_name", "last_name"), "_owner_user")
           .select(*t.payouts.columns, "business_name", "first_name", "last_name"))
    return listing(out, ["created_at"], ordered, after, limit)


def user_bookings(t: Tables, user_id=None, detail: bool = False, ordered: bool = True, after=None,
                  limit: int | None = None) -> DataFrame:
    """Bookings with court and owner contact; ``detail`` adds the booker's names."""
    b = t.bookings if user_id is None else t.bookings.filter(F.col("user_id") == F.lit(user_id))
    courts = _court_cols(t, F.col("name").alias("court_name"), F.col("address").alias("court_address"),
                         "owner_id").join(_owners(t, "business_name", "business_phone"), "owner_id").drop("owner_id")
    out = b.join(courts, "court_id")
    cols = [*t.bookings.columns, "court_name", "court_address", "business_name", "business_phone"]
    if detail:
        out = out.join(_users(t, "user_id", "first_name", "last_name"), "user_id")
        cols += ["first_name", "last_name"]
    return listing(out.select(*cols), ["booking_date", "start_time"], ordered, after, limit)


def owner_bookings(t: Tables, owner_id=None, ordered: bool = True, after=None, limit: int | None = None) -> DataFrame:
    """Bookings on each owner's courts with the booker's contact details."""
    courts = _court_cols(t, F.col("name").alias("court_name"), "owner_id").filter(F.col("owner_id").isNotNull())
    if owner_id is not None:
        courts = courts.filter(F.col("owner_id") == F.lit(owner_id))
    out = (t.bookings.join(courts, "court_id")
           .join(_users(t, "user_id", "first_name", "last_name", "email", "phone"), "user_id")
           .select("owner_id", *t.bookings.columns, "court_name", "first_name", "last_name", "email", "phone"))
    return listing(out, ["booking_date", "start_time"], ordered, after, limit)


def owned_courts(t: Tables, user_id=None) -> DataFrame:
    """Courts with the user id of their owner (the ownership test, for all users at once)."""
    owners = t.court_owners.select(F.col("id").alias("owner_id"), "user_id").filter(F.col("user_id").isNotNull())
    if user_id is not None:
        owners = owners.filter(F.col("user_id") == F.lit(user_id))
    return t.courts.join(owners, "owner_id").select(*t.courts.columns, "user_id")


def promotion_list(t: Tables, ordered: bool = True, after=None, limit: int | None = None) -> DataFrame:
    """Promotions with creator name (NULL if a name part is NULL) and number of targets."""
    counts = (t.promotion_targets.groupBy(F.col("promotion_id").alias("id"))
              .agg(F.count("user_id").alias("target_count")))
    creators = t.users.select(F.col("id").alias("created_by"),
                              full_name("first_name", "last_name").alias("created_by_name"))
    out = (t.promotions.join(creators, "created_by", "left").join(counts, "id", "left")
           .select(*t.promotions.columns, "created_by_name",
                   F.coalesce("target_count", F.lit(0)).cast("bigint").alias("target_count")))
    return listing(out, ["created_at"], ordered, after, limit)


def promotion_target_users(t: Tables, promotion_id=None) -> DataFrame:
    pt = t.promotion_targets
    if promotion_id is not None:
        pt = pt.filter(F.col("promotion_id") == F.lit(promotion_id))
    return (pt.select("promotion_id", "user_id").join(_users(t, "user_id", "first_name", "last_name", "email"),
                                                       "user_id")
            .select("promotion_id", "user_id", "first_name", "last_name", "email"))


def court_reviews_latest(t: Tables, n: int = 10) -> DataFrame:
    """Newest ``n`` reviews of every court with the reviewer's names.

    Top-k per court: Spark adds a partial WindowGroupLimit before the shuffle,
    so a court with a huge number of reviews forwards only ``n`` rows per task.
    """
    ranked = top_k(t.reviews, ["court_id"], [F.col("created_at").desc_nulls_last(), F.col("id").desc()], k=n,
                   name="_rn")
    return (ranked.join(_users(t, "user_id", "first_name", "last_name", "username"), "user_id")
            .select(*t.reviews.columns, "first_name", "last_name", "username"))


def court_images_nested(t: Tables) -> DataFrame:
    """All images of each court as one array<struct<id, image_path, is_primary>>, primary first then id.

    The array is the output itself (a court page lists every image), so the
    group is collected; rows are narrowed to three columns before the shuffle.
    """
    img = t.court_images.select("court_id", F.struct((-F.col("is_primary")).alias("k"), "id", "image_path",
                                                     "is_primary").alias("s"))
    grouped = img.groupBy("court_id").agg(F.sort_array(F.collect_list("s")).alias("_s"))
    images = F.transform("_s", lambda x: F.struct(x["id"].alias("id"), x["image_path"].alias("image_path"),
                                                  x["is_primary"].alias("is_primary")))
    return grouped.select("court_id", images.alias("images"))


def court_images_parts(t: Tables, most: int = 100) -> DataFrame:
    """(court_id, part, images): the images of ``court_images_nested`` in parts of at most ``most``, numbered from 0.

    Positions come from the skew-safe numbering of ``plans.ranking``, so a court with a third of all images is spread over
    tasks and no array grows with it.
    """
    order = [F.col("is_primary").desc_nulls_last(), F.col("id").asc()]
    placed = positions(t.court_images.select("court_id", "id", "image_path", "is_primary"), ["court_id"], order, name="_at")
    part = F.floor((F.col("_at") - 1) / most).cast("bigint")
    entry = F.struct(F.col("_at"), F.struct("id", "image_path", "is_primary").alias("image"))
    grouped = placed.groupBy("court_id", part.alias("part")).agg(F.sort_array(F.collect_list(entry)).alias("_s"))
    return grouped.select("court_id", "part", F.transform("_s", lambda x: x["image"]).alias("images"))
