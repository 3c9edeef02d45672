"""Pages of ordered listings by cursor.

A listing's order ends with its id, so the last row of a page names the place where the next one begins. The rows after it
are a filter on the listing's own columns, which reaches the scan, and a page of n rows is a top-n: every task keeps n rows
and no listing is sorted whole. Pages stay whole when rows are added or removed between them, unlike those by OFFSET.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _after(keys: Sequence[str], values: Sequence, newest: bool) -> Column:
    """Rows that stand after ``values`` under ``keys``, each newest first with nulls last, or oldest first with nulls first."""
    alternatives = []
    for i, (key, value) in enumerate(zip(keys, values)):
        c = F.col(key)
        if value is None:
            here = F.lit(False) if newest else c.isNotNull()
        else:
            here = (c < F.lit(value)) | c.isNull() if newest else c > F.lit(value)
        same = [F.col(k).eqNullSafe(F.lit(v)) for k, v in zip(keys[:i], values[:i])]
        alternatives.append(reduce(lambda a, b: a & b, [*same, here]))
    return reduce(lambda a, b: a | b, alternatives)


def listing(df: DataFrame, keys: Sequence[str], ordered: bool = True, after: Sequence | None = None, limit: int | None = None,
            newest: bool = True) -> DataFrame:
    """``df`` by ``keys`` and id, newest first; from the row after the cursor ``after`` (its values of the keys and id), ``limit`` rows.

    ``ordered=False`` leaves out the sort of a listing that nobody reads in order; a page is always in order.
    """
    keys = [*keys, "id"]
    if after is not None:
        if len(after) != len(keys):
            raise ValueError(f"the cursor needs values of {', '.join(keys)}")
        df = df.filter(_after(keys, after, newest))
    if ordered or limit is not None:
        df = df.orderBy(*[F.col(k).desc_nulls_last() if newest else F.col(k).asc_nulls_first() for k in keys])
    return df if limit is None else df.limit(int(limit))
