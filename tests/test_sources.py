"""Sources and sinks: declared schema on load, missing tables, partitioned writes, added columns."""

import tempfile

import pytest

from pyspark.sql import functions as F

from slotwise.sources import fixtures as FX
from slotwise.sources.schema import SCHEMAS
from slotwise.sources.tables import ensure_columns, load_tables, write_table


EMPTY = ("court_availability",)


def test_a_missing_table_is_an_error(spark, small_dir):
    with pytest.raises(FileNotFoundError, match="users"):
        load_tables(spark, "/no/such/folder", optional=EMPTY)
    out = tempfile.mkdtemp(prefix="load-")
    FX.materialize(spark, small_dir, out, declared=True)
    with pytest.raises(FileNotFoundError, match="court_availability"):
        load_tables(spark, out)


def test_load_tables_conforms_and_fills_missing(spark, small_dir):
    out = tempfile.mkdtemp(prefix="load-")
    FX.materialize(spark, small_dir, out, declared=True)            # domain tables only: court_availability is absent
    t = load_tables(spark, out, optional=EMPTY)
    for name, df in t.items():
        assert [f.name for f in df.schema.fields][:len(SCHEMAS[name])] == SCHEMAS[name].fieldNames()
    assert t.court_availability.count() == 0 and t.payments.count() > 0 and t.voucher_usage.count() > 0
    assert dict(t.bookings.dtypes)["total_amount"] == "decimal(12,2)"
    assert t.bookings.filter(F.col("payment_intent_id").isNotNull()).count() == 0


def test_write_table_partitions_bookings_by_date(spark, small_dir):
    out = tempfile.mkdtemp(prefix="write-")
    b = FX.Fixture(spark, small_dir).view("bookings")
    write_table(b, f"{out}/bookings", partition_by=["booking_date"])
    back = spark.read.parquet(f"{out}/bookings")
    assert back.count() == b.count()
    import os
    parts = sorted(d for d in os.listdir(f"{out}/bookings") if d.startswith("booking_date="))
    assert len(parts) == b.select("booking_date").distinct().count() and "booking_date=2001-06-15" in parts


def test_ensure_columns_adds_only_missing(spark):
    df = spark.createDataFrame([(1, "x")], "id long, notes string")
    out = ensure_columns(df, {"notes": ("string", "dflt"), "discount_amount": ("decimal(12,2)", 0)})
    row = out.collect()[0]
    assert row["notes"] == "x" and float(row["discount_amount"]) == 0.0
    assert dict(out.dtypes)["discount_amount"] == "decimal(12,2)"
