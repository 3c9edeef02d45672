"""Text predicates and JS-style truthiness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def like_pattern(fragment: str) -> str:
    """'%fragment%' with Spark's LIKE escape character doubled (input % and _ stay wild, as in SQLite)."""
    return "%" + fragment.replace("\\", "\\\\") + "%"


def contains_ci(col: str | Column, fragment: str) -> Column:
    """SQLite ``col LIKE '%x%'``: case-insensitive containment."""
    c = F.col(col) if isinstance(col, str) else col
    return c.ilike(like_pattern(fragment))


def blank(col: str | Column, numeric: bool = False) -> Column:
    """JS falsiness of a form value: NULL or '' for text; NULL or 0 for numbers."""
    c = F.col(col) if isinstance(col, str) else col
    if numeric:
        return c.isNull() | F.coalesce(c.cast("double") == 0, F.lit(False))
    return c.isNull() | (c.cast("string") == "")


def full_name(first: str | Column, last: str | Column) -> Column:
    """first || ' ' || last — NULL when either part is NULL (SQL concat semantics)."""
    return F.concat(F.col(first) if isinstance(first, str) else first, F.lit(" "),
                    F.col(last) if isinstance(last, str) else last)
