"""Point-in-time counts: a typed CSV to metrics per area, and yearly totals."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tractlake.functions.casts import clean_numeric_columns, lenient_int
from tractlake.operators.aggregates import metric_tables, sum_numeric_by
from tractlake.operators.columns import flatten, normalize_names, snake_case
from tractlake.operators.windows import ratio, with_change
from tractlake.schemas import PIT
from tractlake.sinks.writers import replace_path, write_dataset
from tractlake.sources.files import read_dataset, read_delimited, read_json

# The declared metrics.
METRICS = {"total_count": {"group_by": ["year", "spa"], "aggregation": {"count": "sum"}}}


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    return read_delimited(spark, path, PIT)


def clean_counts(counts: DataFrame) -> DataFrame:
    """Area and population as text, the count as int; a bad count is null."""
    return counts.withColumns(
        {
            "spa": F.col("spa").cast("string"),
            "population_type": F.col("population_type").cast("string"),
            "count": lenient_int("count"),
        }
    )


def count_metrics(clean: DataFrame, specs: Mapping[str, Mapping] = METRICS) -> dict:
    """One grouped table per declared metric."""
    return metric_tables(clean, specs)


def clean_totals(raw: DataFrame) -> DataFrame:
    """Nested records to flat, named columns, with counts as numbers."""
    return clean_numeric_columns(normalize_names(flatten(raw), snake_case))


def yearly_totals(
    totals: DataFrame,
    year: str = "year",
    unsheltered: str = "unsheltered",
    total: str = "total_homeless",
) -> DataFrame:
    """Sum of every numeric column per year, the unsheltered share and the change.

    The change runs over one row per year, after the grouping.
    """
    yearly = sum_numeric_by(totals, [year])
    shares = yearly.withColumn("pct_unsheltered", ratio(unsheltered, total))
    return with_change(shares, total, year, "pct_change_total")


def load_totals(
    spark: SparkSession, root: str, raw_path: str, fmt: str = "parquet"
) -> dict[str, str]:
    """Landed records of totals to the clean table and the table per year.

    Columns follow from the records, so neither has a registered schema. Each is a new version of
    its folder; the yearly table reads the clean one that was written.
    """
    clean = clean_totals(read_json(spark, raw_path))
    paths = {"silver.pit_totals": replace_path(clean, f"{root}/silver/pit_totals", fmt)}
    yearly = yearly_totals(spark.read.format(fmt).load(paths["silver.pit_totals"]))
    paths["gold.pit_yearly"] = replace_path(yearly, f"{root}/gold/pit_yearly", fmt)
    return paths


def load_all(
    spark: SparkSession, root: str, csv_path: str, fmt: str = "parquet"
) -> dict[str, str]:
    """CSV to the bronze table, the clean silver table and the gold metric."""
    bronze_path = write_dataset(read_counts(spark, csv_path), root, "bronze.pit", fmt)
    clean = clean_counts(read_dataset(spark, root, "bronze.pit", fmt))
    silver_path = write_dataset(clean, root, "silver.pit", fmt)
    metric = count_metrics(read_dataset(spark, root, "silver.pit", fmt))["total_count"]
    return {
        "bronze.pit": bronze_path,
        "silver.pit": silver_path,
        "gold.pit_metrics": write_dataset(metric, root, "gold.pit_metrics", fmt),
    }
