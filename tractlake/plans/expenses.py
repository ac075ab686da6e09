"""Expense records: raw JSON to a typed, de-duplicated silver table and a fact."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tractlake.functions.casts import strict_cast
from tractlake.functions.dates import run_timestamp, strict_date
from tractlake.operators.columns import (
    cast_and_alias,
    cast_by_name,
    normalize_names,
    rename,
    snake_case_no_dollar,
)
from tractlake.operators.dedup import drop_duplicate_rows, keep_latest
from tractlake.schemas import EXPENSE_KEY, EXPENSE_TEXT_COLUMNS, RAW_EXPENSES
from tractlake.sinks.writers import write_snapshot
from tractlake.sources.files import read_json_pages
from tractlake.sources.snapshots import read_latest_json

# Silver name -> gold name.
GOLD_NAMES = {
    "dept_name": "department",
    "vendor_name": "vendor",
    "fund_nm": "fund",
    "mjr_project_code": "project_code",
    "mjr_project_name": "project_name",
    "amount": "expense_amount",
}


def typed_expenses(raw: DataFrame, ingested: datetime | None = None) -> DataFrame:
    """Text columns, a double amount and a date; a bad amount or date ends the run."""
    return raw.select(
        *cast_and_alias(raw, EXPENSE_TEXT_COLUMNS),
        strict_cast("pstng_am", "double", "pstng_am").alias("amount"),
        strict_date("transaction_date", name="transaction_date").alias("transaction_date"),
        run_timestamp(ingested).alias("ingest_timestamp"),
    )


def silver_expenses(
    raw: DataFrame, ingested: datetime | None = None, nearly_unique: bool = False
) -> DataFrame:
    """One row per document line; the newest load wins, then the greatest row.

    With ``nearly_unique`` lines are sorted once; say so only if no line is repeated often.
    """
    typed = typed_expenses(raw, ingested)
    return keep_latest(typed, EXPENSE_KEY, "ingest_timestamp", nearly_unique)


def silver_expenses_by_name(raw: DataFrame) -> DataFrame:
    """The loose variant: types follow from column names, whole rows are distinct."""
    return drop_duplicate_rows(cast_by_name(normalize_names(raw, snake_case_no_dollar)))


def gold_expenses(silver: DataFrame) -> DataFrame:
    return rename(silver, GOLD_NAMES)


def land_pages(
    spark: SparkSession,
    pages_path: str,
    bronze_dir: str,
    whole_files: bool = True,
    now: datetime | None = None,
) -> str | None:
    """All landed pages as one bronze snapshot; None if the pages hold no records.

    A page that is not a list of records ends the run. ``record`` holds the record as
    the source wrote it, so fields that the schema doesn't name are kept.
    """
    records = read_json_pages(spark, pages_path, RAW_EXPENSES, whole_files, text="record")
    return write_snapshot(records, bronze_dir, "json", now)


def load_all(
    spark: SparkSession,
    bronze_dir: str,
    silver_dir: str,
    gold_dir: str,
    now: datetime | None = None,
) -> dict[str, str | None]:
    """Newest bronze snapshot to a new silver snapshot and a new gold snapshot."""
    raw = read_latest_json(spark, bronze_dir, RAW_EXPENSES)
    silver_path = write_snapshot(silver_expenses(raw, now), silver_dir, "parquet", now)
    if silver_path is None:
        return {"silver": None, "gold": None}
    silver = spark.read.parquet(silver_path)
    return {
        "silver": silver_path,
        "gold": write_snapshot(gold_expenses(silver), gold_dir, "parquet", now),
    }


def load_by_name(
    spark: SparkSession, bronze_dir: str, silver_dir: str, now: datetime | None = None
) -> str | None:
    """Newest bronze snapshot, of whatever columns, to a new snapshot of the loose silver table."""
    raw = read_latest_json(spark, bronze_dir)
    return write_snapshot(silver_expenses_by_name(raw), silver_dir, "parquet", now)


def expenses_by(silver: DataFrame, *keys: str) -> DataFrame:
    """Number and sum of expenses per key."""
    return silver.groupBy(*keys).agg(
        F.count("*").alias("expense_count"), F.sum("amount").alias("expense_amount")
    )
