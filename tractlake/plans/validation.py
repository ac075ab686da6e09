"""Checks on the gold business tables, each as a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tractlake.operators.dedup import distinct_values
from tractlake.operators.quality import profile, reconcile, row_counts, schema_report
from tractlake.schemas import DATASETS


def validate_gold(business: DataFrame, geography: DataFrame, districts: DataFrame) -> dict:
    """Row counts, reconciliation, nulls, distinct values and schemas.

    Each table is scanned once per check that needs its rows; nulls and distinct
    values of one table come from the same pass.
    """
    tables = {
        "gold.business": business,
        "gold.geography": geography,
        "gold.business_by_district": districts,
    }
    return {
        "row_counts": row_counts(tables),
        "reconciliation": reconcile(business, districts, "business_count"),
        "geography": profile(
            geography, ["latitude", "longitude"], ["latitude", "longitude"]
        ),
        "districts": distinct_values(districts, "council_district", ordered=True),
        "naics": profile(business, ["naics"], ["naics"]),
        **{
            f"schema {name}": schema_report(df, DATASETS[name].schema)
            for name, df in tables.items()
        },
    }
