"""First-one-wins over several unique keys, and registrations, against sequential inserts."""

import random

import pytest

from slotwise.operators import changes as CH
from slotwise.plans.greedy import first_wins
from slotwise.sources.fixtures import Fixture
from tests import hand as H


def sequential(rows, keys):
    seen = [set() for _ in keys]
    kept = []
    for r in sorted(rows, key=lambda r: r["o"]):
        vals = [tuple(r[c] for c in k) for k in keys]
        if any(None not in v and v in s for v, s in zip(vals, seen)):
            continue
        kept.append(r["o"])
        for v, s in zip(vals, seen):
            if None not in v:
                s.add(v)
    return set(kept)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_first_wins_matches_sequential(spark, seed):
    rnd = random.Random(seed)
    rows = [{"o": i, "a": rnd.randrange(15), "b": rnd.choice([None] + list(range(12)))} for i in range(200)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "o long, a long, b long")
    kept, ignored = first_wins(df, [["a"], ["b"]], "o")
    assert {r["o"] for r in kept.collect()} == sequential(rows, [["a"], ["b"]])
    assert kept.count() + ignored.count() == len(rows)


def test_long_chain_of_shared_keys(spark):
    rows = [{"o": i, "a": i // 2, "b": (i + 1) // 2} for i in range(25)]   # each row shares a key with the next
    kept, ignored = first_wins(spark.createDataFrame(rows, "o long, a long, b long"), [["a"], ["b"]], "o")
    assert {r["o"] for r in kept.collect()} == sequential(rows, [["a"], ["b"]]) == set(range(0, 25, 2))
    assert ignored.count() == 12


def test_no_rows(spark):
    kept, ignored = first_wins(spark.createDataFrame([], "o long, a long, b long"), [["a"], ["b"]], "o")
    assert kept.count() == ignored.count() == 0


def test_chain_blocked_only_by_ignored_row_is_kept(spark):
    df = spark.createDataFrame([(1, "u1", "e1"), (2, "u2", "e1"), (3, "u2", "e2"), (4, "u3", "e2"), (5, "u3", "e3")],
                               "o long, u string, e string")
    kept, _ = first_wins(df, [["u"], ["e"]], "o")
    assert sorted(r["o"] for r in kept.collect()) == [1, 3, 5]


def test_registrations_match_sequential(spark, small_dir):
    fx = Fixture(spark, small_dir)
    t = fx.tables()
    req = fx.view("registration_requests")
    users = [r.asDict() for r in t.users.collect()]
    taken_u = {u["username"] for u in users}
    taken_e = {u["email"] for u in users}
    want_ok = []
    for r in sorted([r.asDict() for r in req.collect()], key=lambda r: r["request_id"]):
        if r["username"] in taken_u or r["email"] in taken_e:
            continue
        taken_u.add(r["username"])
        taken_e.add(r["email"])
        want_ok.append(r)
    res = CH.admit_registrations(t, req)
    new = res.users.join(t.users.select("id"), "id", "left_anti")
    assert sorted(r["username"] for r in new.collect()) == sorted(r["username"] for r in want_ok)
    owners = [r for r in want_ok if r["role"] == "owner"]
    assert res.court_owners.count() == t.court_owners.count() + len(owners)
    assert res.rejected.count() + len(want_ok) == req.count()


def test_registration_owner_profile_name(spark):
    t = H.tables(spark, users=[H.user(1)])
    req = spark.createDataFrame([(5, "ann", "ann@x", "Ann", "Lee", "owner")],
                                "request_id long, username string, email string, first_name string, "
                                "last_name string, role string")
    res = CH.admit_registrations(t, req)
    row = res.court_owners.collect()[0]
    assert row["business_name"] == "Ann Lee's Courts" and row["user_id"] == 2
