"""Properties from the test strategy: set identities that must hold on whole fixture tables."""

from pyspark.sql import functions as F

from slotwise.operators import changes as CH
from slotwise.operators import intervals as I
from slotwise.operators import quality as Q
from slotwise.operators import reports as R
from slotwise.sources.fixtures import Fixture


def test_free_and_booked_slots_partition_all_slots(spark, small_dir):
    t = Fixture(spark, small_dir).tables()
    day = "2001-06-15"
    every = I.court_hour_slots(t).select("court_id", "start_time")
    free = I.available_slots(t, day).select("court_id", "start_time")
    conf = t.bookings.filter((F.col("booking_date") == F.lit(day).cast("date")) & (F.col("booking_status") == "confirmed"))
    booked = (every.join(conf.select("court_id", F.col("start_time").alias("bs"), F.col("end_time").alias("be")),
                         "court_id")
              .filter((F.col("bs") <= F.col("start_time")) & (F.col("be") > F.col("start_time")))
              .select("court_id", "start_time").distinct())
    assert free.join(booked, ["court_id", "start_time"]).count() == 0
    assert free.unionByName(booked).distinct().count() == every.distinct().count()


def test_admitted_bookings_are_never_blocked(spark, small_dir):
    fx = Fixture(spark, small_dir)
    t = fx.tables()
    res = CH.admit_bookings(t, fx.view("booking_requests"))
    after = t.bookings.unionByName(res.bookings.select(*t.bookings.columns))
    pairs = I.booking_conflicts(t.replace(bookings=after))
    new_ids = res.bookings.select(F.col("id").alias("later_id"))
    assert pairs.join(new_ids, "later_id").count() == 0
    assert res.bookings.count() > 0


def test_history_pages_partition_each_owner(spark, small_dir):
    t = Fixture(spark, small_dir).tables()
    counts = {r["owner_id"]: r["total_records"] for r in R.owner_history_counts(t).collect()}
    pages = max((n + 9) // 10 for n in counts.values())
    seen = None
    for p in range(1, pages + 1):
        page = R.booking_history_page(t, page=p).select("owner_id", "id")
        seen = page if seen is None else seen.unionByName(page)
    got = {r["owner_id"]: r["count"] for r in seen.groupBy("owner_id").count().collect()}
    assert seen.count() == seen.distinct().count()
    assert got == {k: v for k, v in counts.items() if v}


def test_cascading_delete_leaves_no_orphans(spark, small_dir):
    fx = Fixture(spark, small_dir)
    t = fx.tables()
    gone = t.promotions.select("id")          # delete every promotion
    after = CH.delete_promotions(t, gone)
    orphans = Q.audit_foreign_keys(after).filter(F.col("child").startswith("promotion"))
    assert after.promotions.count() == 0 and orphans.count() == 0
    naive = t.replace(promotions=t.promotions.limit(0))
    assert Q.audit_foreign_keys(naive).filter(F.col("child") == "promotion_targets").count() == \
        t.promotion_targets.count()
