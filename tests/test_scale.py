"""What must not grow with the tables: partitions of the rounds, evaluations of an input, the size of a task's input."""

import time

from pyspark.sql import functions as F

from slotwise.catalog import QUERIES
from slotwise.operators import changes as CH
from slotwise.operators import stored as ST
from slotwise.plans.lineage import FREE_SHUFFLES, cut_stored
from slotwise.session import SCALE_CONF
from slotwise.sources.fixtures import fixture
from tests import hand as H


def test_rounds_of_code_decisions_neither_add_partitions_nor_broadcast(spark):
    settings = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    chain = [(i, i if i % 2 else None, f"C{i + 1}") for i in range(12)] + [(100 + i, None, "C5") for i in range(20)]
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        requests = spark.createDataFrame(chain, "request_id long, id long, _ucode string")
        promotions = spark.createDataFrame([(i, f"c{i}") for i in range(12)], "id long, code string")
        decided = CH._code_decisions(requests, promotions)
        assert decided.count() == len(chain) and decided.rdd.getNumPartitions() < 64
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_a_stored_table_evaluates_its_rows_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)
    rows = spark.sparkContext.parallelize([(i, i % 3) for i in range(90)], 3).map(lambda r: (seen.add(1), r)[1])
    df = spark.createDataFrame(rows, "id long, day int").withColumn("booking_date", F.date_add(F.lit("2001-06-01").cast("date"), F.col("day")))
    table = ST.create(df, str(tmp_path / "t"), block=10)
    assert seen.value == 90 and table.rows().count() == 90
    assert sorted(r[0] for r in table.directory().select("id").collect()) == list(range(90))
    table.update(spark.createDataFrame([(4, 7)], "id long, day int"), ["day"])
    assert {r.id: r.day for r in table.rows().collect()} == {i: 7 if i == 4 else i % 3 for i in range(90)}
    assert sorted(p.name for p in (tmp_path / "t").iterdir()) == ["directory", "rows"]


def test_views_over_given_rows_do_not_make_them_again(spark, small_dir, tmp_path):
    fx = fixture(spark, small_dir)
    fx.view("bookings").limit(20).write.parquet(str(tmp_path / "b"))
    own = fx.over(bookings=spark.read.parquet(str(tmp_path / "b")))
    actions = own.view("booking_actions")
    assert all(str(tmp_path) in f for f in actions.inputFiles())
    ids = {r[0] for r in own.tables().bookings.select("id").collect()}
    assert {r[0] for r in actions.select("booking_id").collect()} == ids and len(ids) == 20


def test_queries_bound_what_a_task_reads_in_any_session(spark, small_dir):
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(size, "64MB")
    try:
        fixture(spark, small_dir)
        assert spark.conf.get(size) == SCALE_CONF[size] == "8MB"
    finally:
        spark.conf.set(size, SCALE_CONF[size])


def test_reviews_are_judged_in_one_pass_over_their_requests(spark):
    seen = spark.sparkContext.accumulator(0)
    asked = [(1, 10, 1, 5), (2, 10, 1, 4), (3, 10, 2, 4), (4, 20, 1, 3), (5, 30, 1, 3), (6, 40, 1, 0), (7, 40, 1, 2),
             (8, None, 1, 2), (9, 50, 1, None), (None, 60, 1, 5), (11, 60, 1, 5), (12, 70, 1, 6), (13, 70, 1, 1), (14, 70, 1, 1)]
    requests = spark.createDataFrame(spark.sparkContext.parallelize(asked, 3).map(lambda r: (seen.add(1), (*r, f"text {r[0]}"))[1]),
                                     "request_id long, booking_id long, user_id long, rating int, comment string")
    done = [H.booking(i, court_id=i + 100, booking_status="completed") for i in (10, 20, 40, 50, 60, 70, 70)]  # 70 comes twice
    t = H.tables(spark, bookings=[*done, H.booking(30)], reviews=[
        H.row("reviews", id=7, court_id=120, user_id=1, booking_id=20, rating=1), H.row("reviews", id=8, court_id=1, user_id=1, rating=1)])
    got = CH.admit_reviews(t, requests, "2001-06-15 12:00:00")
    missing, exists, invalid = CH.MSG_REVIEW_BOOKING, CH.MSG_REVIEW_EXISTS, "Invalid rating"
    assert sorted(map(tuple, got.rejected.collect())) == [
        (2, exists), (3, missing), (4, exists), (5, missing), (6, invalid), (8, missing), (9, invalid), (12, invalid), (12, invalid),
        (14, exists), (14, exists)]
    new = got.table.filter("id > 8").orderBy("id").collect()
    assert [r.id for r in new] == [9, 10, 11, 12, 13, 14] and [r.court_id for r in new] == [160, 110, 140, 160, 170, 170]
    assert sorted((r.booking_id, r.rating, r.comment) for r in got.extra.collect()) == [
        (10, 5, "text 1"), (40, 2, "text 7"), (60, 5, "text 11"), (60, 5, "text None"), (70, 1, "text 13"), (70, 1, "text 13")]
    assert seen.value == len(asked)


def test_rejected_reviews_do_not_make_the_bookings_again(spark, small_dir):
    for query in ("admit_reviews", "admit_reviews_rejected"):
        files = QUERIES[query](spark, small_dir).inputFiles()
        assert files and not [f for f in files if small_dir in f]


def test_a_stored_frame_leaves_no_shuffle_files(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        files = manager.getAllFiles()
        return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_")}

    before, setting = shuffles(), spark.conf.get(FREE_SHUFFLES, None)
    got = cut_stored(spark.range(0, 1000, 1, 4).repartition(5, "id").groupBy((F.col("id") % 10).alias("k")).agg(F.sum("id").alias("s")))
    until = time.time() + 10
    while (left := shuffles() - before) and time.time() < until:  # they are removed in the background
        time.sleep(0.1)
    assert not left and spark.conf.get(FREE_SHUFFLES, None) == setting
    assert got.count() == 10 and got.agg(F.sum("s")).first()[0] == 499500
