"""Strict and lenient casts that do not depend on the session's ANSI setting."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tractlake.functions.text import col_of

# Numbers as text: Spark alone would also take '1d', '2f' and hex floats.
NUMERIC = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf(inity)?))\s*$"
FLOATING = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf(inity)?|nan))\s*$"
WHOLE_NUMBER = r"^\s*[+-]?\d+\s*$"


def _shaped_like(value: Column, pattern: str) -> Column:
    """The text fits ``pattern``, or is so shaped that a cast alone decides as the pattern would.

    From a sign, point or digit to a digit, without an x, nothing but plain decimals converts:
    the suffixes, hex floats and stray control characters that the patterns refuse are out.
    Most values end here, and a match costs several times as much.
    """
    plain = (
        F.substring(value, 1, 1).between("+", "9")
        & F.substring(value, -1, 1).between("0", "9")
        & ~value.contains("x")
        & ~value.contains("X")
    )
    return plain | value.rlike(pattern)


def strict_cast(column: Column | str, type_name: str, name: str = "value") -> Column:
    """Null stays null; text that does not convert ends the run. NaN is a double."""
    value = col_of(column)
    if type_name == "string":
        return value.cast("string")
    bad = F.concat(F.lit(f"{name}: cannot cast to {type_name}: "), value.cast("string"))
    cast = value.try_cast(type_name)
    if type_name in ("double", "float"):
        cast = F.when(_shaped_like(value.cast("string"), FLOATING), cast)
    return F.coalesce(cast, F.when(value.isNotNull(), F.raise_error(bad))).cast(type_name)


def lenient_double(column: Column | str) -> Column:
    """Text to double; anything that is no number becomes null, NaN too.

    NaN is not null in Spark and compares greater than every number, so it must
    not reach a threshold test. The pattern is tested first, as a failed parse
    costs far more than a failed match.
    """
    value = col_of(column).cast("string")
    return F.when(_shaped_like(value, NUMERIC), value.try_cast("double"))


def lenient_int(column: Column | str, type_name: str = "int") -> Column:
    """Text to a whole number; anything else, or one out of range, becomes null."""
    value = col_of(column).cast("string")
    return F.when(value.rlike(WHOLE_NUMBER), value.try_cast(type_name))


def null_if_nan(column: Column | str) -> Column:
    value = col_of(column)
    return F.when(~F.isnan(value), value)


def money(column: Column | str, name: str = "amount") -> Column:
    """``$1,234.50`` to 1234.5; null stays null, other text ends the run."""
    return strict_cast(F.translate(col_of(column).cast("string"), "$,", ""), "double", name)


def clean_numeric_columns(
    df: DataFrame, suffixes: Iterable[str] = ("_count", "_number")
) -> DataFrame:
    """Cast the columns with such names, each one wholly or not at all.

    One aggregate pass over the candidates brings one row of counters to the
    driver; the casts are then part of a plain projection. Whole numbers become
    bigint, other numbers double, and a column with any bad value stays text.
    """
    text = {field.name for field in df.schema if field.dataType.simpleString() == "string"}
    names = [c for c in df.columns if c in text and c.endswith(tuple(suffixes))]
    if not names:
        return df
    counters = []
    for i, name in enumerate(names):
        value = F.col(f"`{name}`")
        counters += [
            F.count_if(~value.rlike(NUMERIC)).alias(f"bad_{i}"),
            F.count_if(value.isNotNull() & lenient_int(value, "bigint").isNull()).alias(
                f"broken_{i}"
            ),
        ]
    found = df.agg(*counters).first()
    types = {}
    for i, name in enumerate(names):
        if found[f"bad_{i}"] == 0:
            types[name] = "bigint" if found[f"broken_{i}"] == 0 else "double"
    return df.select(
        *[
            F.col(f"`{c}`").try_cast(types[c]).alias(c) if c in types else F.col(f"`{c}`")
            for c in df.columns
        ]
    )
