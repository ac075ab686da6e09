"""Margins of error, coefficients of variation and the grade they give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tractlake.functions.casts import lenient_double, null_if_nan
from tractlake.functions.text import col_of

# Margins are published at 90 % confidence; grades end at these CVs.
MARGIN_TO_ERROR = 1.645
RELIABLE_UP_TO = 12.0
CAUTION_UP_TO = 40.0
RELIABLE = "reliable"
CAUTION = "use with caution"
UNRELIABLE = "not reliable"
NOT_APPLICABLE = "not applicable"
GRADES = (RELIABLE, CAUTION, UNRELIABLE, NOT_APPLICABLE)

# Codes the Census Bureau puts in place of a number.
SENTINELS = (
    -222222222,
    -333333333,
    -555555555,
    -666666666,
    -888888888,
    -999999999,
)


def standard_error(moe: Column | str) -> Column:
    return col_of(moe) / F.lit(MARGIN_TO_ERROR)


def cv_percent(error: Column | str, estimate: Column | str) -> Column:
    """abs(error / estimate) in percent; null, never NaN, where it is undefined."""
    value = col_of(estimate)
    return null_if_nan(F.when(value != 0, F.abs(F.try_divide(col_of(error), value)) * 100))


def grade(
    cv: Column | str, reliable: float = RELIABLE_UP_TO, caution: float = CAUTION_UP_TO
) -> Column:
    value = col_of(cv)
    return (
        F.when(value.isNull(), NOT_APPLICABLE)
        .when(value <= reliable, RELIABLE)
        .when(value <= caution, CAUTION)
        .otherwise(UNRELIABLE)
    )


def with_reliability(
    df: DataFrame,
    estimate: str = "estimate",
    moe: str = "moe",
    null_sentinels: bool = False,
) -> DataFrame:
    """Parse estimate and margin and add standard_error, cv_pct and reliability.

    A pure projection: no shuffle, one code-generated stage. Sentinel codes are
    kept as numbers unless ``null_sentinels`` is set.
    """
    numbers = {}
    for name in (estimate, moe):
        value = lenient_double(name)
        numbers[name] = F.when(~value.isin(*SENTINELS), value) if null_sentinels else value
    return (
        df.withColumns(numbers)
        .withColumn("standard_error", standard_error(moe))
        .withColumn("cv_pct", cv_percent("standard_error", estimate))
        .withColumn("reliability", grade("cv_pct"))
    )
