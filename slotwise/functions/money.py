"""Money rules as Column expressions.

Discounts follow the reference's JavaScript number arithmetic: binary doubles,
same operation order ((amount * value) / 100), so results are bit-identical.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def voucher_discount(amount: str | Column, discount_type: str | Column, value: str | Column,
                     max_discount: str | Column) -> Column:
    """percentage: amount·value/100, capped by max only when max is non-zero; fixed: value."""
    amount, discount_type, value, max_discount = map(_c, (amount, discount_type, value, max_discount))
    a, v, m = amount.cast("double"), value.cast("double"), max_discount.cast("double")
    pct = a * v / F.lit(100.0)
    capped = F.when(F.coalesce(m != 0, F.lit(False)), F.least(pct, m)).otherwise(pct)
    return F.when(discount_type == "percentage", capped).otherwise(v)


def final_after_discount(amount: str | Column, discount: str | Column) -> Column:
    """max(0, amount − discount)."""
    return F.greatest(_c(amount).cast("double") - _c(discount).cast("double"), F.lit(0.0))


def js_number_text(x: str | Column) -> Column:
    """Number as JavaScript prints it in a template: 220 -> '220', 220.5 -> '220.5'."""
    s = _c(x).cast("double").cast("string")
    return F.regexp_replace(s, r"\.0$", "")
