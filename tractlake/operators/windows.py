"""Ratios and change against the previous row of a short, aggregated series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tractlake.functions.text import col_of


def ratio(part: Column | str, whole: Column | str) -> Column:
    """part / whole; null where whole is 0."""
    return F.try_divide(col_of(part), col_of(whole))


def with_change(
    series: DataFrame,
    value: str,
    order_by: str,
    name: str,
    partition_by: Sequence[str] = (),
) -> DataFrame:
    """Add value / previous value - 1; null on the first row.

    Without ``partition_by`` the series goes through one task. It must then be the
    result of a grouping with few groups, such as one row per year.
    """
    window = Window.partitionBy(*partition_by).orderBy(order_by)
    previous = F.lag(value).over(window)
    return series.withColumn(name, F.try_divide(F.col(value), previous) - 1)
