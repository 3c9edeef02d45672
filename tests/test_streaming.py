"""The admission stream equals the sequential rule over requests in arrival order."""

import tempfile

from slotwise.streaming.admission import admit_stream
from tests import hand as H
from tests.test_admission import sequential

SCHEMA = ("request_id long, court_id long, booking_date date, start_time string, end_time string, "
          "total_hours int, user_id long")


def test_later_batches_see_earlier_admissions(spark):
    t = H.tables(spark, courts=[H.court(1), H.court(2)], bookings=[H.booking(1, start="08:00", end="09:00")])
    t = t.replace(bookings=t.bookings.select(*t.bookings.columns))
    src = tempfile.mkdtemp(prefix="req-")
    batches = [
        [(1, 1, "10:00", "12:00"), (2, 1, "08:30", "09:30"), (3, 2, "10:00", "11:00")],
        [(4, 1, "11:00", "12:00"), (5, 2, "11:00", "12:00"), (6, 1, "12:00", "13:00")],
    ]
    for i, rows in enumerate(batches):
        df = spark.createDataFrame([(r, c, H.d("2001-06-15"), s, e, 1, 7) for r, c, s, e in rows], SCHEMA)
        df.coalesce(1).write.parquet(f"{src}/part{i}")
    out, ckpt = tempfile.mkdtemp(prefix="out-"), tempfile.mkdtemp(prefix="ckpt-")
    q = admit_stream(spark, t, f"{src}/*", SCHEMA, out, ckpt, files_per_batch=1)
    q.awaitTermination(120)
    got = {r["request_id"]: r["reason"] for r in spark.read.parquet(f"{out}/rejected").collect()}
    reqs = [dict(request_id=r, court_id=c, booking_date=H.d("2001-06-15"), start_time=s, end_time=e, total_hours=1)
            for rows in batches for r, c, s, e in rows]
    want = sequential([r.asDict() for r in t.bookings.collect()], [r.asDict() for r in t.courts.collect()], reqs,
                      False)
    assert got == {k: v for k, v in want.items() if v is not None}
    assert spark.read.parquet(f"{out}/bookings").count() == sum(v is None for v in want.values())


def test_restart_from_checkpoint_does_not_duplicate(spark):
    t = H.tables(spark, courts=[H.court(1)])
    src = tempfile.mkdtemp(prefix="req-")
    rows = [(1, 1, "10:00", "11:00"), (2, 1, "10:30", "11:30"), (3, 1, "12:00", "13:00")]
    spark.createDataFrame([(r, c, H.d("2001-06-15"), s, e, 1, 7) for r, c, s, e in rows], SCHEMA) \
        .coalesce(1).write.parquet(f"{src}/part0")
    out, ckpt = tempfile.mkdtemp(prefix="out-"), tempfile.mkdtemp(prefix="ckpt-")
    for _ in range(2):      # the second start finds nothing new in the checkpoint and writes nothing
        admit_stream(spark, t, f"{src}/*", SCHEMA, out, ckpt).awaitTermination(120)
    assert spark.read.parquet(f"{out}/bookings").count() == 2
    assert [r["request_id"] for r in spark.read.parquet(f"{out}/rejected").collect()] == [2]
