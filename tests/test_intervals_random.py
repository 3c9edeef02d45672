"""Hour-bucket interval joins against brute force on random 'HH:MM' intervals (minutes, empty, inverted)."""

import itertools
import random

import pytest

from slotwise.operators import intervals as I
from tests import hand as H


def hhmm(m: int) -> str:
    return f"{m // 60:02d}:{m % 60:02d}"


def blocks(es, ee, ns, ne, strict):
    if strict:
        return es < ne and ee > ns
    return (es <= ns and ee > ns) or (es < ne and ee >= ne)


@pytest.mark.parametrize("seed", [11, 12])
def test_conflicts_and_slots_match_brute_force(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(1, 301):
        court, day = rnd.randint(1, 3), rnd.choice(["2001-06-15", "2001-06-16"])
        s = rnd.randrange(0, 24 * 60)
        e = rnd.choice([s, max(0, s - rnd.randint(1, 120)), min(24 * 60 - 1, s + rnd.randint(1, 240))])
        status = rnd.choice(["confirmed", "confirmed", "confirmed", "cancelled"])
        rows.append(H.booking(i, court_id=court, date=day, start=hhmm(s), end=hhmm(e), booking_status=status))
    courts = [H.court(c, open_time=f"{rnd.randint(0, 9):02d}:{rnd.choice(['00', '30'])}",
                      close_time=f"{rnd.randint(12, 23):02d}:00") for c in (1, 2, 3)]
    t = H.tables(spark, courts=courts, bookings=rows)
    conf = [r for r in rows if r["booking_status"] == "confirmed"]
    for strict in (False, True):
        want = {(a["id"], b["id"]) for a, b in itertools.combinations(sorted(conf, key=lambda r: r["id"]), 2)
                if a["court_id"] == b["court_id"] and a["booking_date"] == b["booking_date"]
                and blocks(a["start_time"], a["end_time"], b["start_time"], b["end_time"], strict)}
        want = {(min(a for a, b in want if b == later), later) for _, later in want}
        got = {(r["first_id"], r["later_id"]) for r in I.booking_conflicts(t, strict=strict).collect()}
        assert got == want, strict
    day = H.d("2001-06-15")
    want_slots = set()
    for c in courts:
        for h in range(int(c["open_time"][:2]), int(c["close_time"][:2])):
            slot = f"{h:02d}:00"
            if not any(b["court_id"] == c["id"] and b["booking_date"] == day and b["start_time"] <= slot < b["end_time"]
                       for b in conf):
                want_slots.add((c["id"], slot))
    got_slots = {(r["court_id"], r["start_time"]) for r in I.available_slots(t, "2001-06-15").collect()}
    assert got_slots == want_slots
