"""Every fixture view gives the same rows in Spark and in DuckDB (the oracle's copy of the text)."""

import pytest

from slotwise.sources import fixtures as FX
from tools.compare import compare, duck


@pytest.fixture(scope="module")
def con(small_dir):
    return duck(small_dir)


@pytest.mark.parametrize("name", list(FX.VIEWS))
def test_view_is_the_same_in_both_engines(spark, con, small_dir, name):
    got = FX.Fixture(spark, small_dir).view(name).toArrow()
    want = con.sql(FX.with_views(f"SELECT * FROM {name}", [name])).to_arrow_table()
    assert compare(got, want) is None
    assert got.num_rows > 0


def test_documented_counts_at_sf0001(spark, small_dir):
    fx = FX.Fixture(spark, small_dir)
    counts = {n: fx.view(n).count() for n in ("users", "court_owners", "courts", "bookings", "reviews", "payouts",
                                              "court_images", "promotions", "promotion_targets")}
    assert counts == {"users": 160, "court_owners": 10, "courts": 200, "bookings": 4599, "reviews": 523,
                      "payouts": 12, "court_images": 288, "promotions": 10, "promotion_targets": 321}
