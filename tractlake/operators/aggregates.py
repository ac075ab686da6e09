"""Grouped and whole-table aggregates; all of them combine in each task first."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tractlake.functions.casts import null_if_nan
from tractlake.operators.columns import quoted

METRIC_FUNCTIONS = {
    "sum": F.sum,
    "count": F.count,
    "avg": F.avg,
    "mean": F.avg,
    "min": F.min,
    "max": F.max,
    "count_distinct": F.count_distinct,
}


def category_counts(df: DataFrame, column: str, categories: Sequence[str]) -> DataFrame:
    """Rows per category of a fixed list, zero where there are none.

    One pass and one result row, which is then turned into a row per category.
    """
    counted = df.agg(
        *[
            F.count_if(F.col(quoted(column)) == category).alias(f"n{i}")
            for i, category in enumerate(categories)
        ]
    )
    items = F.array(
        *[
            F.struct(F.lit(category).alias(column), F.col(f"n{i}").alias("row_count"))
            for i, category in enumerate(categories)
        ]
    )
    return counted.select(F.inline(items))


def sum_numeric_by(
    df: DataFrame, keys: Sequence[str], exclude: Sequence[str] = ()
) -> DataFrame:
    """Sum of every numeric column per key; nulls and NaN are skipped, none left gives 0."""
    skipped = {*keys, *exclude}

    def values(field: T.StructField) -> Column:
        column = F.col(quoted(field.name))
        return null_if_nan(column) if isinstance(field.dataType, (T.DoubleType, T.FloatType)) else column

    sums = [
        F.coalesce(F.sum(values(field)), F.lit(0)).alias(field.name)
        for field in df.schema
        if isinstance(field.dataType, T.NumericType) and field.name not in skipped
    ]
    return df.groupBy(*[F.col(quoted(k)) for k in keys]).agg(*sums)


def metric_table(df: DataFrame, name: str, spec: Mapping) -> DataFrame:
    """``{group_by: [..], aggregation: {column: function}}`` to a grouped metric.

    With one aggregate the metric has the name itself, else ``name_column``.
    """
    aggregation = spec["aggregation"]
    unknown = sorted(set(aggregation.values()) - set(METRIC_FUNCTIONS))
    if unknown:
        raise ValueError(f"metric {name}: unknown function {', '.join(unknown)}")
    single = len(aggregation) == 1
    return df.groupBy(*spec.get("group_by", ())).agg(
        *[
            METRIC_FUNCTIONS[function](quoted(column)).alias(name if single else f"{name}_{column}")
            for column, function in aggregation.items()
        ]
    )


def metric_tables(df: DataFrame, specs: Mapping[str, Mapping]) -> dict[str, DataFrame]:
    return {name: metric_table(df, name, spec) for name, spec in specs.items()}


def distinct_with_null(*columns: str) -> Column:
    """Distinct count in which null is a value, as in ``distinct().count()``."""
    return F.count_distinct(F.struct(*[F.col(quoted(c)) for c in columns]))
