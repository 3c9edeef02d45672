"""The spark-submit entry point runs operators over stored tables and writes every output."""

import os
import tempfile

from slotwise.__main__ import main, operators
from slotwise.sources import fixtures as FX


def test_operator_listing_covers_the_jobs():
    ops = operators()
    for name in ("admit_bookings", "owner_sales_headline", "available_slots", "audit_foreign_keys", "court_search"):
        assert name in ops


def test_run_writes_outputs(spark, small_dir):
    base = tempfile.mkdtemp(prefix="cli-")
    FX.materialize(spark, small_dir, f"{base}/tables", declared=True)
    FX.Fixture(spark, small_dir).view("booking_requests").write.parquet(f"{base}/requests")
    assert main(["run", "admit_bookings", "--optional", "court_availability", "--tables", f"{base}/tables", "--requests", f"{base}/requests",
                 "--out", f"{base}/admission"]) == 0
    assert sorted(os.listdir(f"{base}/admission")) == ["bookings", "promotions", "rejected", "usage"]
    assert main(["run", "available_slots", "--optional", "court_availability", "--tables", f"{base}/tables", "--out", f"{base}/slots",
                 "--param", "date=2001-06-15"]) == 0
    assert spark.read.parquet(f"{base}/slots").count() > 0
