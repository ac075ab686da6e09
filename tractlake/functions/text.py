"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character a Python ``str.strip`` removes.
WHITESPACE = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def col_of(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def strip(column: Column | str) -> Column:
    """Trim all white space, where ``F.trim`` takes spaces only."""
    return F.btrim(col_of(column), F.lit(WHITESPACE))


def joined_or(items: Column, empty: str = "none", separator: str = ", ") -> Column:
    """An array as sorted, separated text; an empty or null array as ``empty``."""
    return F.when(F.size(items) > 0, F.array_join(F.array_sort(items), separator)).otherwise(empty)


def has_prefix_and_suffix(
    column: Column | str, prefix: Column | str, suffix: str
) -> Column:
    """``column`` begins with ``prefix`` (text or a column) and ends with ``suffix``."""
    start = prefix if isinstance(prefix, Column) else F.lit(prefix)
    value = col_of(column)
    return F.startswith(value, start) & F.endswith(value, F.lit(suffix))
