"""Schemas, keys and places of every table of the four domains."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import types as T

TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "integer": T.IntegerType(),
    "bigint": T.LongType(),
    "long": T.LongType(),
    "double": T.DoubleType(),
    "date": T.DateType(),
    "timestamp": T.TimestampNTZType(),
}


def schema_from_spec(spec: Sequence[Mapping]) -> T.StructType:
    """``[{name, type, nullable}, ...]`` to a ``StructType`` for ``reader.schema``."""
    fields = []
    for entry in spec:
        type_name = str(entry["type"]).lower()
        if type_name not in TYPES:
            raise ValueError(f"unknown type {entry['type']!r} for column {entry['name']!r}")
        fields.append(
            T.StructField(entry["name"], TYPES[type_name], bool(entry.get("nullable", True)))
        )
    return T.StructType(fields)


def _columns(type_name: str, *names: str) -> list[dict]:
    return [{"name": name, "type": type_name} for name in names]


TABLE_CONFIG = schema_from_spec(_columns("string", "table_id", "series"))
VARIABLES = schema_from_spec(_columns("string", "table_id", "variable", "variable_label"))

_ESTIMATE_IDS = [
    *_columns("string", "table_id", "variable", "variable_label", "tract_fips", "tract_name"),
    *_columns("int", "year"),
]
BRONZE_ESTIMATES = schema_from_spec(
    [*_ESTIMATE_IDS, *_columns("string", "estimate", "moe", "ingested_at")]
)
SILVER_ESTIMATES = schema_from_spec(
    [
        *_ESTIMATE_IDS,
        *_columns("double", "estimate", "moe", "standard_error", "cv_pct"),
        *_columns("string", "reliability", "processed_at"),
    ]
)
DIM_VARIABLE = schema_from_spec(_columns("string", "variable", "variable_label", "table_id"))
DIM_TRACT = schema_from_spec(_columns("string", "tract_fips", "tract_name"))
FACT_ESTIMATES = schema_from_spec(
    [
        *_columns("string", "tract_fips", "variable"),
        *_columns("int", "year"),
        *_columns("double", "estimate", "moe", "standard_error", "cv_pct"),
        *_columns("string", "reliability"),
    ]
)

# Source column -> silver column of the expense feed, all text.
EXPENSE_TEXT_COLUMNS = {
    "fiscal_year": "fiscal_year",
    "dept_nm": "dept_name",
    "fund_nm": "fund_nm",
    "mjr_project_code": "mjr_project_code",
    "mjr_project_name": "mjr_project_name",
    "business_type": "business_type",
    "payment_type": "payment_type",
    "vendor_name": "vendor_name",
    "payment_description": "payment_description",
    "work_order_nm": "work_order_name",
    "work_order": "work_order",
    "appr_nm": "appr_name",
    "doc_id": "doc_id",
    "doc_cd": "doc_cd",
    "dept_cd": "dept_cd",
    "appr_cd": "appr_cd",
    "doc_actg_ln_no": "doc_actg_ln_no",
    "fund_cd": "fund_cd",
    "transaction_closed": "transaction_closed",
    "vend_cust_cd": "vend_cust_cd",
}
# What makes an expense line unique.
EXPENSE_KEY = ("doc_id", "doc_cd", "dept_cd", "vend_cust_cd", "fiscal_year", "doc_actg_ln_no")

RAW_EXPENSES = schema_from_spec(
    _columns("string", *EXPENSE_TEXT_COLUMNS, "pstng_am", "transaction_date")
)
SILVER_EXPENSES = schema_from_spec(
    [
        *_columns("string", *EXPENSE_TEXT_COLUMNS.values()),
        *_columns("double", "amount"),
        *_columns("timestamp", "transaction_date", "ingest_timestamp"),
        *_columns("int", "rn"),
    ]
)

# The text columns of the licence feed.
BUSINESS_TEXT_COLUMNS = (
    "location_account",
    "business_name",
    "street_address",
    "city",
    "zip_code",
    "location_description",
    "primary_naics_description",
)
RAW_BUSINESS = T.StructType(
    [
        *schema_from_spec(
            _columns(
                "string",
                *BUSINESS_TEXT_COLUMNS,
                "naics",
                "council_district",
                "location_start_date",
            )
        ).fields,
        T.StructField(
            "location_1", schema_from_spec(_columns("string", "latitude", "longitude"))
        ),
    ]
)
SILVER_BUSINESS = schema_from_spec(
    [
        *_columns("string", *BUSINESS_TEXT_COLUMNS),
        *_columns("int", "naics", "council_district"),
        *_columns("timestamp", "location_start_date"),
        *_columns("double", "latitude", "longitude"),
    ]
)
GOLD_BUSINESS = schema_from_spec(
    [
        *_columns("string", "business_name", "location_account"),
        *_columns("int", "naics"),
        *_columns("string", "primary_naics_description"),
        *_columns("int", "council_district"),
        *_columns("timestamp", "location_start_date"),
        *_columns("double", "latitude", "longitude"),
        *_columns("string", "zip_code", "city"),
    ]
)
_LINEAGE = [*_columns("date", "ingestion_date"), *_columns("string", "data_source", "data_domain")]
GOLD_GEOGRAPHY = schema_from_spec(
    [
        *_columns("string", "location_account", "street_address", "city", "zip_code"),
        *_columns("int", "council_district"),
        *_columns("double", "latitude", "longitude"),
        *_LINEAGE,
    ]
)
GOLD_DISTRICTS = schema_from_spec(
    [
        *_columns("int", "council_district"),
        *_columns("bigint", "business_count", "unique_categories"),
        *_columns("double", "avg_latitude", "avg_longitude"),
        *_LINEAGE,
    ]
)

# The columns of the point-in-time counts.
PIT_SPEC = [
    {"name": "year", "type": "integer", "nullable": True},
    {"name": "spa", "type": "string", "nullable": True},
    {"name": "population_type", "type": "string", "nullable": True},
    {"name": "count", "type": "integer", "nullable": True},
]
PIT = schema_from_spec(PIT_SPEC)
PIT_METRICS = schema_from_spec(
    [*_columns("int", "year"), *_columns("string", "spa"), *_columns("bigint", "total_count")]
)


@dataclass(frozen=True)
class Dataset:
    """One stored table: where it lies, what it holds, what makes a row unique."""

    name: str
    path: str
    schema: T.StructType
    key: tuple[str, ...]
    partition_by: tuple[str, ...] = ()

    def location(self, root: str) -> str:
        return f"{root.rstrip('/')}/{self.path}"


# Readers and writers take places from here only, so they cannot drift apart.
REJECTS = schema_from_spec(
    [{"name": "reason", "type": "string"}, {"name": "content", "type": "string"}]
)

DATASETS = {
    dataset.name: dataset
    for dataset in (
        Dataset("bronze.variables", "bronze/variables", VARIABLES, ("variable",)),
        Dataset("bronze.rejects", "bronze/rejects", REJECTS, ()),
        Dataset(
            "bronze.selected_variables", "bronze/selected_variables", VARIABLES, ("variable",)
        ),
        Dataset(
            "bronze.estimates",
            "bronze/estimates",
            BRONZE_ESTIMATES,
            ("table_id", "variable", "tract_fips", "year"),
            ("year",),
        ),
        Dataset(
            "silver.estimates",
            "silver/estimates",
            SILVER_ESTIMATES,
            ("table_id", "variable", "tract_fips", "year"),
            ("year",),
        ),
        Dataset("gold.dim_variable", "gold/dim_variable", DIM_VARIABLE, ("variable",)),
        Dataset("gold.dim_tract", "gold/dim_tract", DIM_TRACT, ("tract_fips",)),
        Dataset(
            "gold.fact_estimates",
            "gold/fact_estimates",
            FACT_ESTIMATES,
            ("tract_fips", "variable", "year"),
            ("year",),
        ),
        Dataset("silver.expenses", "silver/expenses", SILVER_EXPENSES, EXPENSE_KEY),
        Dataset("silver.business", "silver/business", SILVER_BUSINESS, ("location_account",)),
        Dataset("gold.business", "gold/business", GOLD_BUSINESS, ("location_account",)),
        Dataset(
            "gold.geography",
            "gold/geography",
            GOLD_GEOGRAPHY,
            ("street_address", "zip_code", "latitude", "longitude"),
        ),
        Dataset(
            "gold.business_by_district",
            "gold/business_by_district",
            GOLD_DISTRICTS,
            ("council_district",),
        ),
        Dataset("bronze.pit", "bronze/pit", PIT, ()),
        Dataset("silver.pit", "silver/pit", PIT, ()),
        Dataset("gold.pit_metrics", "gold/pit_metrics", PIT_METRICS, ("year", "spa")),
    )
}
