"""Hand tables: a few rows per behaviour, every other table empty with its declared schema."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from slotwise.sources.schema import SCHEMAS
from slotwise.sources.tables import Tables


def ts(s: str) -> dt.datetime:
    return dt.datetime.fromisoformat(s)


def d(s: str) -> dt.date:
    return dt.date.fromisoformat(s)


def m(x) -> Decimal:
    return Decimal(str(x)).quantize(Decimal("0.01"))


def row(table: str, **values) -> dict:
    out = {f: None for f in SCHEMAS[table].fieldNames()}
    out.update(values)
    return out


def tables(spark, **rows) -> Tables:
    frames = {}
    for name, schema in SCHEMAS.items():
        data = [tuple(r[f] for f in schema.fieldNames()) for r in rows.get(name, [])]
        frames[name] = spark.createDataFrame(data, schema)
    return Tables(**frames)


def court(id, owner_id=1, **kw) -> dict:
    base = dict(id=id, owner_id=owner_id, name=f"court {id}", address=f"{id} Main St", court_type="synthetic",
                indoor_outdoor="indoor", has_ac=0, has_food=0, has_parking=0, hourly_rate=m(10),
                open_time="06:00", close_time="22:00", is_active=1, is_approved=1, created_at=ts("2001-01-01"))
    base.update(kw)
    return row("courts", **base)


def booking(id, court_id=1, user_id=1, date="2001-06-15", start="10:00", end="11:00", **kw) -> dict:
    base = dict(id=id, court_id=court_id, user_id=user_id, booking_date=d(date), start_time=start, end_time=end,
                total_hours=1, total_amount=m(10), payment_status="paid", booking_status="confirmed",
                discount_amount=m(0), created_at=ts("2001-06-01"))
    base.update(kw)
    return row("bookings", **base)


def user(id, **kw) -> dict:
    base = dict(id=id, username=f"u{id}", email=f"u{id}@x", role="user", first_name=f"F{id}", last_name=f"L{id}",
                created_at=ts("2000-01-01"))
    base.update(kw)
    return row("users", **base)


def owner(id, user_id, **kw) -> dict:
    base = dict(id=id, user_id=user_id, business_name=f"Biz {id}", business_address="KL")
    base.update(kw)
    return row("court_owners", **base)
