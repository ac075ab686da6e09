"""Expressions on tract, table and variable codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tractlake.functions.text import col_of

# The last letter of a variable code says what the number is.
ESTIMATE_SUFFIX = "E"
MARGIN_SUFFIX = "M"
COLLAPSED_PREFIX = "C"


def geoid(*parts: Column | str) -> Column:
    """Parts joined to one code; a missing part counts as empty text."""
    return F.concat(*[F.coalesce(col_of(part), F.lit("")) for part in parts])


def without_last_char(column: Column | str) -> Column:
    value = col_of(column)
    return F.left(value, F.length(value) - 1)


def margin_code(root: Column | str) -> Column:
    return F.concat(col_of(root), F.lit(MARGIN_SUFFIX))


def table_of(code: Column | str) -> Column:
    """``B19013_001E`` to ``B19013``."""
    return F.substring_index(col_of(code), "_", 1)


def is_estimate_code(code: Column | str) -> Column:
    """``<table>_<...>E``; ``NAME`` has no table part and does not count."""
    value = col_of(code)
    return (F.instr(value, "_") > 1) & F.endswith(value, F.lit(ESTIMATE_SUFFIX))


def collapsed_id(table_id: Column | str) -> Column:
    """The id of the collapsed twin: the first letter becomes ``C``."""
    value = col_of(table_id)
    return F.concat(F.lit(COLLAPSED_PREFIX), F.substring(value, F.lit(2), F.length(value)))
