"""Stored tables rewrite only touched partitions; several tables are published together or not at all."""

import pytest
from pyspark.sql import functions as F

from slotwise.operators import changes as CH
from slotwise.operators import stored as ST
from slotwise.operators.listings import court_images_parts
from slotwise.sources import published as PB
from tests import hand as H

DAYS = ["2001-06-%02d" % d for d in range(1, 21)]


def bookings(spark):
    rows = [H.booking(i, date=DAYS[i % 20], payment_status="pending" if i % 2 else "paid", user_id=i % 3) for i in range(200)]
    return H.tables(spark, bookings=rows)


def files(spark, table):
    return {f: (spark.sparkContext._jvm.java.io.File(f.removeprefix("file:"))).lastModified() for f in table.rows().inputFiles()}


@pytest.fixture()
def table(spark, tmp_path):
    return ST.create(bookings(spark).bookings, str(tmp_path / "bookings"), block=50)


def test_stored_rows_are_the_rows(spark, table):
    want = bookings(spark).bookings
    assert sorted(table.rows().collect()) == sorted(want.collect()) and table.rows().columns == want.columns


def test_scan_lists_only_touched_partitions(spark, table):
    keys = spark.createDataFrame([(3,), (43,), (4,), (999_999,), (None,)], "id long")
    rows = table.touched(keys)
    assert {r[0].split("booking_date=")[1][:10] for r in rows.select(F.input_file_name()).distinct().collect()} == {DAYS[3], DAYS[4]}
    assert {r.booking_date.isoformat() for r in rows.collect()} == {DAYS[3], DAYS[4]} and rows.count() == 20
    assert table.touched(keys.filter("id > 1000")).count() == 0
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert f"PartitionFilters: [booking_date" in plan and DAYS[3] in plan and "Exchange" not in plan


def test_update_leaves_other_files_alone(spark, table):
    before = files(spark, table)
    changes = spark.createDataFrame([(3, "cancelled", 1), (3, None, 2), (23, "cancelled", 1), (10**6, "x", 1)], "id long, booking_status string, n int")
    table.update(changes, ["booking_status"], order="n")
    after = files(spark, table)
    assert {f for f in before if DAYS[3] not in f} == {f for f in after if DAYS[3] not in f}
    assert all(before[f] == after[f] for f in after if f in before) and {f for f in after if f not in before}
    got = {r.id: r.booking_status for r in table.rows().collect()}
    assert got == {i: {3: None, 23: "cancelled"}.get(i, "confirmed") for i in range(200)}
    with pytest.raises(ValueError, match="place a row"):
        table.update(changes, ["booking_date"])


def test_change_jobs_on_touched_partitions(spark, table):
    t = bookings(spark)
    requests = spark.createDataFrame([(i, 7 * i, 7 * i % 3) for i in range(40)] + [(99, 5, 1)], "request_id long, booking_id long, user_id long")
    want = CH.settle_payments(t, requests, "2001-06-15 12:00:00")
    rows = table.touched(requests.select(F.col("booking_id").alias("id")))
    got = CH.settle_payments(t.replace(bookings=rows), requests, "2001-06-15 12:00:00")
    assert sorted(got.rejected.collect()) == sorted(want.rejected.collect()) and sorted(got.payments.collect()) == sorted(want.payments.collect())
    table.overwrite(got.bookings)
    assert sorted(table.rows().collect()) == sorted(want.bookings.collect())


def test_inserted_rows_are_found(spark, table):
    new = H.tables(spark, bookings=[H.booking(500, date="2002-01-01"), H.booking(501, date=DAYS[0])]).bookings
    table.insert(new)
    assert table.rows().count() == 202
    assert {r.id for r in table.touched(new.select("id").filter("id = 500")).collect()} == {500}


def published(spark, root):
    return {name: sorted(df.collect()) for name, df in PB.read(spark, root).items()}


def test_tables_are_published_together(spark, tmp_path, monkeypatch):
    root, t = str(tmp_path / "p"), bookings(spark)
    users = H.tables(spark, users=[H.user(1)]).users
    assert PB.publish(spark, root, {"bookings": t.bookings, "users": users}, {"bookings": ["booking_date"]}) == 1
    old = published(spark, root)
    assert old["bookings"] == sorted(t.bookings.collect()) and len(old["users"]) == 1
    more = H.tables(spark, users=[H.user(1), H.user(2)], bookings=[H.booking(900)])
    real, done = PB.write_table, []

    def fails_between(df, path, **kw):
        if done:
            raise OSError("lost")
        done.append(real(df, path, **kw))

    monkeypatch.setattr(PB, "write_table", fails_between)
    with pytest.raises(OSError, match="lost"):
        PB.publish(spark, root, {"bookings": more.bookings, "users": more.users})
    assert done and published(spark, root) == old
    monkeypatch.setattr(PB, "write_table", real)
    # a table may be made from the one it replaces; tables left alone stay
    assert PB.publish(spark, root, {"users": PB.read(spark, root)["users"].unionByName(more.users.filter("id = 2"))}) == 2
    assert [r.id for r in published(spark, root)["users"]] == [1, 2] and published(spark, root)["bookings"] == old["bookings"]


def test_of_two_publications_from_one_version_one_fails(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "p")
    users = H.tables(spark, users=[H.user(1)]).users
    PB.publish(spark, root, {"users": users})
    real = PB.write_table

    def overtaken(df, path, **kw):
        real(df, path, **kw)
        monkeypatch.setattr(PB, "write_table", real)
        PB.publish(spark, root, {"users": users.limit(0)})

    monkeypatch.setattr(PB, "write_table", overtaken)
    with pytest.raises(PB.PublishConflict):
        PB.publish(spark, root, {"users": users})
    assert published(spark, root) == {"users": []}
    with pytest.raises(PB.PublishConflict, match="taken"):
        PB._commit(spark, root, 2, {})
    with pytest.raises(FileNotFoundError):
        PB.read(spark, root, ["payments"])


def test_a_version_that_was_reserved_but_never_named_is_skipped(spark, tmp_path):
    root, users = str(tmp_path / "p"), H.tables(spark, users=[H.user(1)]).users
    PB.publish(spark, root, {"users": users})
    fs, taken = PB._hadoop(spark, f"{root}/_versions/{2:012d}.taken")
    fs.createNewFile(taken)
    assert PB.current(spark, root)[0] == 1
    assert PB.publish(spark, root, {"users": users.limit(0)}) == 3 and published(spark, root) == {"users": []}


def test_images_of_a_hot_court_come_in_bounded_parts(spark):
    rows = [H.row("court_images", id=i, court_id=1 if i % 3 else i, image_path=f"p{i}", is_primary=int(i % 100 == 1)) for i in range(1, 2001)]
    got = court_images_parts(H.tables(spark, court_images=rows), most=50).collect()
    assert max(len(r.images) for r in got) == 50
    hot = [x.id for r in sorted((r for r in got if r.court_id == 1), key=lambda r: r.part) for x in r.images]
    assert hot == [r["id"] for r in sorted((r for r in rows if r["court_id"] == 1), key=lambda r: (-r["is_primary"], r["id"]))]
