"""Column helpers: the reference's text date functions, 'HH:MM' handling, LIKE, truthiness, money rules."""

import datetime as dt

from pyspark.sql import functions as F

from slotwise.functions import calendar as C
from slotwise.functions import clock as K
from slotwise.functions import money as M
from slotwise.functions import text as X


def one(spark, col, data, schema):
    return [r[0] for r in spark.createDataFrame(data, schema).select(col).collect()]


def test_calendar_formats(spark):
    rows = [(dt.datetime(2001, 6, 3, 10, 30), dt.date(2001, 6, 3))]        # a Sunday
    schema = "ts timestamp_ntz, d date"
    assert one(spark, C.month("ts"), rows, schema) == ["2001-06"]
    assert one(spark, C.month_num("ts"), rows, schema) == ["06"]
    assert one(spark, C.day_text("ts"), rows, schema) == ["03"]
    assert one(spark, C.weekday_text("d"), rows, schema) == ["0"]          # strftime('%w'): Sunday is 0
    assert one(spark, C.as_of_date("2001-06-15 23:59:00"), rows, schema) == [dt.date(2001, 6, 15)]


def test_clock(spark):
    rows = [("07:30",), ("21:00",), ("x",), (None,), ("25:00",)]
    assert one(spark, K.hour_of("t"), rows, "t string") == [7, 21, None, None, 25]
    assert one(spark, K.hhmm(F.lit(7)), rows[:1], "t string") == ["07:00"]
    got = one(spark, K.slot_ts(F.lit(dt.date(2001, 6, 15)), "t"), rows, "t string")
    assert got == [dt.datetime(2001, 6, 15, 7, 30), dt.datetime(2001, 6, 15, 21, 0), None, None, None]


def test_like_and_truthiness(spark):
    rows = [("Jalan 50% Off",), ("a\\b",), ("",), (None,)]
    assert one(spark, X.contains_ci("s", "50%"), rows, "s string") == [True, False, False, None]
    assert one(spark, X.contains_ci("s", "a\\b"), rows, "s string") == [False, True, False, None]
    assert one(spark, X.blank("s"), rows, "s string") == [False, False, True, True]
    nums = [(0,), (3,), (None,)]
    assert one(spark, X.blank("n", numeric=True), nums, "n int") == [True, False, True]
    names = [("Ann", "Lee"), ("Ann", None)]
    assert one(spark, X.full_name("a", "b"), names, "a string, b string") == ["Ann Lee", None]


def test_discount_rule(spark):
    rows = [(100.0, "percentage", 15.0, 10.0), (100.0, "percentage", 15.0, 0.0), (10.0, "fixed", 25.0, None)]
    schema = "a double, t string, v double, m double"
    assert one(spark, M.voucher_discount("a", "t", "v", "m"), rows, schema) == [10.0, 15.0, 25.0]
    assert one(spark, M.final_after_discount("a", M.voucher_discount("a", "t", "v", "m")), rows, schema) == \
        [90.0, 85.0, 0.0]
    assert one(spark, M.js_number_text("x"), [(220.0,), (220.5,)], "x double") == ["220", "220.5"]
