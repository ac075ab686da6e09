"""Business licences: nested raw records to business, geography and district tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tractlake.functions.casts import lenient_double, lenient_int
from tractlake.functions.dates import iso_timestamp
from tractlake.operators.columns import (
    drop_columns,
    normalize_names,
    trimmed_lower,
    with_lineage,
)
from tractlake.operators.dedup import first_per_key
from tractlake.schemas import BUSINESS_TEXT_COLUMNS, DATASETS, GOLD_BUSINESS
from tractlake.sinks.writers import write_dataset
from tractlake.sources.files import read_dataset

# What the gold tables say about their origin.
DATA_SOURCE = "LA City Business Dataset"
GEOGRAPHY_DOMAIN = "geography"
DISTRICT_DOMAIN = "business_by_district"
NESTED_COLUMN = "location_1"
PORTAL_PREFIX = "@computed_region_"

# The columns of the geography table, before its lineage.
GEOGRAPHY_COLUMNS = (
    "location_account",
    "street_address",
    "city",
    "zip_code",
    "council_district",
    "latitude",
    "longitude",
)


def silver_business(raw: DataFrame) -> DataFrame:
    """Trimmed text, lenient numbers and date, coordinates out of the nested field.

    Columns that are not named here pass through, but for the portal's own.
    """
    typed = raw.withColumns(
        {
            "latitude": lenient_double(f"{NESTED_COLUMN}.latitude"),
            "longitude": lenient_double(f"{NESTED_COLUMN}.longitude"),
            **{name: F.trim(name) for name in BUSINESS_TEXT_COLUMNS},
            "naics": lenient_int("naics"),
            "council_district": lenient_int("council_district"),
            "location_start_date": iso_timestamp("location_start_date"),
        }
    )
    return drop_columns(typed, [NESTED_COLUMN], [PORTAL_PREFIX])


def gold_business(silver: DataFrame) -> DataFrame:
    return silver.select(*GOLD_BUSINESS.fieldNames())


def gold_geography(silver: DataFrame, now: datetime | None = None) -> DataFrame:
    """One row per address and coordinates, the smallest account on ties."""
    places = normalize_names(silver, trimmed_lower).select(*GEOGRAPHY_COLUMNS)
    unique = first_per_key(places, DATASETS["gold.geography"].key).select(*GEOGRAPHY_COLUMNS)
    return with_lineage(unique, DATA_SOURCE, GEOGRAPHY_DOMAIN, now)


def district_summary(
    df: DataFrame, district: str, category: str, latitude: str, longitude: str
) -> DataFrame:
    """Count, distinct categories and mean position per district, in district order.

    Rows without a district are a group of their own, a null category is not
    counted. The distinct count groups by (district, category) first, so one large
    district is spread over all tasks.
    """
    return (
        df.groupBy(F.col(district).alias("council_district"))
        .agg(
            F.count("*").alias("business_count"),
            F.count_distinct(category).alias("unique_categories"),
            F.avg(latitude).alias("avg_latitude"),
            F.avg(longitude).alias("avg_longitude"),
        )
        .orderBy("council_district")
    )


def gold_districts(business: DataFrame, now: datetime | None = None) -> DataFrame:
    summary = district_summary(
        normalize_names(business, trimmed_lower),
        "council_district",
        "naics",
        "latitude",
        "longitude",
    )
    return with_lineage(summary, DATA_SOURCE, DISTRICT_DOMAIN, now)


def load_all(
    spark: SparkSession,
    root: str,
    raw: DataFrame,
    fmt: str = "parquet",
    now: datetime | None = None,
) -> dict[str, str]:
    """Raw records to silver and the three gold tables."""
    paths = {}

    def store(name: str, df: DataFrame, keep_others: bool = False) -> DataFrame:
        paths[name] = write_dataset(df, root, name, fmt, keep_others)
        return read_dataset(spark, root, name, fmt)

    silver = store("silver.business", silver_business(raw), keep_others=True)
    business = store("gold.business", gold_business(silver))
    store("gold.geography", gold_geography(silver, now))
    store("gold.business_by_district", gold_districts(business, now))
    return paths
