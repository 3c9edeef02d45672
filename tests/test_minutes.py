"""The minutes of a court-day against plain loops: bits, first covers and first starts, for intervals of any alignment."""

import random

import pytest
from pyspark.sql import functions as F

from slotwise.plans import minutes as M
from tests import hand as H


def hhmm(m):
    return f"{m // 60:02d}:{m % 60:02d}"


@pytest.fixture(scope="module")
def rows():
    rng, out = random.Random(4), []
    for i in range(1, 200):
        s = rng.choice([rng.randrange(1440), 60 * rng.randrange(24), 15 * rng.randrange(96)])
        e = rng.choice([min(1440, s + rng.randint(1, 200)), min(1440, s + 60 * rng.randint(1, 4)), s, max(0, s - 30), 1440])
        out.append((i, rng.choice([1, 1, 2]), H.d(f"2001-06-1{rng.randint(0, 6)}"), s, e))
    return out + [(500, 3, H.d("2001-06-10"), 0, 1440), (501, 4, H.d("2001-06-10"), 1, 1439)]


@pytest.fixture(scope="module")
def bookings(spark, rows):
    odd = [(900, 1, H.d("2001-06-10"), "9:00", "10:00"), (901, 1, H.d("2001-06-10"), None, "10:00"), (902, 1, H.d("2001-06-10"), "08:00", "25:00")]
    return spark.createDataFrame([(i, c, d, hhmm(s), hhmm(e)) for i, c, d, s, e in rows] + odd,
                                 "id long, court_id long, booking_date date, start_time string, end_time string")


def days(rows):
    out = {}
    for i, c, d, s, e in rows:
        out.setdefault((c, d), []).append((i, s, e))
    return out


def test_minute_of(spark):
    texts = {"00:00": 0, "09:05": 545, "23:59": 1439, "24:00": 1440, "24:01": None, "9:00": None, "aa:bb": None, "12-30": None, "": None, None: None, "12:60": None}
    df = spark.createDataFrame([(k,) for k in texts], "t string").select("t", M.minute_of("t").alias("m"))
    assert {r.t: r.m for r in df.collect()} == texts


def test_bits_say_which_minutes_are_covered(spark, rows, bookings):
    got = {(r.court_id, r.booking_date): r.hours for r in M.occupancy(bookings).collect()}
    for day, own in days(rows).items():
        covered = {m for _, s, e in own for m in range(s, e)}
        assert {60 * h + b for h in range(24) for b in range(60) if got[day][h] >> b & 1} == covered if covered else day not in got
    asked = spark.range(-1, 1442).select(F.col("id").cast("int").alias("m"))
    hours = F.array(*[F.lit(x).cast("long") for x in got[2, rows[0][2]]]) if (2, rows[0][2]) in got else F.array(*[F.lit(x).cast("long") for x in next(iter(got.values()))])
    bits = got.get((2, rows[0][2])) or next(iter(got.values()))
    for r in asked.select("m", M.covered(hours, F.col("m")).alias("c"), M.any_covered(hours, F.col("m"), F.col("m") + 95).alias("a")).collect():
        at = lambda m: 0 <= m < 1440 and bool(bits[m // 60] >> (m % 60) & 1)
        assert r.c == at(r.m)
        assert r.m < 0 or r.a == any(at(m) for m in range(r.m, r.m + 95))


def test_first_covers_and_starts(spark, rows, bookings):
    maps = M.first_covers(bookings, "id", starts=True)
    asked = maps.crossJoin(spark.range(0, 1440, 7).select(F.col("id").cast("int").alias("m")))
    out = asked.select("court_id", "booking_date", "m", M.first_at(F.col("firsts"), F.col("m")).alias("cover"),
                       M.first_start(F.col("firsts"), F.col("m"), F.least(F.col("m") + 80, F.lit(1440))).alias("start"))
    by_day = days(rows)
    for r in out.collect():
        own = [(i, s, e) for i, s, e in by_day[r.court_id, r.booking_date] if s < e]
        assert r.cover == min((i for i, s, e in own if s <= r.m < e), default=None)
        assert r.start == min((i for i, s, e in own if r.m <= s < min(r.m + 80, 1440)), default=None)


def test_a_court_day_has_a_bounded_table(spark):
    rng = random.Random(1)
    rows = [(i, 1, H.d("2001-06-10"), hhmm(s := rng.randrange(1400)), hhmm(rng.randint(s + 1, 1440))) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, court_id long, booking_date date, start_time string, end_time string")
    firsts = M.first_covers(df, "id").select(F.size("firsts").alias("n")).collect()
    assert len(firsts) == 1 and firsts[0].n <= 24 + 96 + 1440
