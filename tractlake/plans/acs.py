"""Survey estimates: header-row payloads to a star schema.

Each step is one lazy plan; a ``load_*`` function writes a registered table.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tractlake.functions.dates import iso_text
from tractlake.functions.keys import collapsed_id
from tractlake.functions.reliability import (
    CAUTION,
    NOT_APPLICABLE,
    RELIABLE,
    UNRELIABLE,
    with_reliability,
)
from tractlake.operators.dedup import first_per_key
from tractlake.operators.joins import left_lookup, star_join, with_match
from tractlake.operators.quality import coverage_counts, duplicate_report, ingest_summary
from tractlake.operators.reshape import melt_payloads
from tractlake.schemas import (
    BRONZE_ESTIMATES,
    DATASETS,
    FACT_ESTIMATES,
    SILVER_ESTIMATES,
)
from tractlake.sinks.writers import write_dataset
from tractlake.sources.census import read_payloads, read_variable_labels, rejects
from tractlake.sources.files import read_dataset, read_table_config


def known_tables(config: DataFrame, variables: DataFrame) -> DataFrame:
    """The configured tables the source has variables for."""
    return with_match(
        config.select("table_id").distinct(), variables, "table_id", "table_id"
    )


def collapsed_tables(config: DataFrame, variables: DataFrame) -> DataFrame:
    """Collapsed twins of the known tables, those that have variables themselves."""
    known = known_tables(config, variables)
    twins = known.select(collapsed_id("table_id").alias("table_id")).distinct()
    return with_match(twins, variables, "table_id", "table_id")


def selected_variables(config: DataFrame, variables: DataFrame) -> DataFrame:
    """The variables of the known tables and of their collapsed twins."""
    wanted = known_tables(config, variables).select(
        F.explode(F.array(F.col("table_id"), collapsed_id("table_id"))).alias("table_id")
    )
    return with_match(
        variables.select("table_id", "variable", "variable_label"), wanted, "table_id", "table_id"
    )


def bronze_estimates(
    payloads: DataFrame, selected: DataFrame, year: int, now: datetime | None = None
) -> DataFrame:
    """Long rows of the selected tables, values as text, with variable labels.

    ``selected`` should be a stored table: Spark then knows its size when it plans
    and sends it to every task if it is small, so the long rows are not shuffled.
    """
    long_rows = with_match(melt_payloads(payloads), selected, "table_id", "table_id")
    labels = selected.select("variable", "variable_label")
    labelled = left_lookup(long_rows, labels, "variable", {"variable_label": ""})
    return labelled.select(
        "table_id",
        "variable",
        "variable_label",
        "tract_fips",
        "tract_name",
        F.lit(year).cast("int").alias("year"),
        "estimate",
        "moe",
        iso_text(now).alias("ingested_at"),
    ).to(BRONZE_ESTIMATES)


def silver_estimates(
    bronze: DataFrame, null_sentinels: bool = False, now: datetime | None = None
) -> DataFrame:
    """Numbers, standard error, CV and grade; the same rows as bronze."""
    graded = with_reliability(bronze.drop("ingested_at"), null_sentinels=null_sentinels)
    return graded.withColumn("processed_at", iso_text(now)).select(
        *SILVER_ESTIMATES.fieldNames()
    )


def dim_variable(silver: DataFrame) -> DataFrame:
    """One row per variable: the label of its latest year, the smallest on ties."""
    rows = silver.select("variable", "variable_label", "table_id", "year").distinct()
    return first_per_key(rows, ["variable"], [F.col("year").desc_nulls_last()]).select(
        "variable", "variable_label", "table_id"
    )


def dim_tract(silver: DataFrame) -> DataFrame:
    """One row per tract: the name of its latest year, the smallest on ties."""
    rows = silver.select("tract_fips", "tract_name", "year").distinct()
    return first_per_key(rows, ["tract_fips"], [F.col("year").desc_nulls_last()]).select(
        "tract_fips", "tract_name"
    )


def fact_estimates(silver: DataFrame) -> DataFrame:
    """Rows whose estimate is a number; zeros stay, and no grade is left out."""
    return silver.filter(F.col("estimate").isNotNull()).select(*FACT_ESTIMATES.fieldNames())


def labelled_facts(
    fact: DataFrame, variables: DataFrame, tracts: DataFrame, salts: int = 1
) -> DataFrame:
    """The fact table with its variable labels and tract names."""
    return star_join(fact, {"variable": variables, "tract_fips": tracts}, salts)


def metric_columns() -> dict[str, Column]:
    """Rows without a number, and rows per grade, as aggregates."""
    grades = {
        "reliable_count": RELIABLE,
        "use_with_caution_count": CAUTION,
        "not_reliable_count": UNRELIABLE,
        "not_applicable_count": NOT_APPLICABLE,
    }
    return {
        "dropped_unparseable": F.count_if(F.col("estimate").isNull()),
        **{n: F.count_if(F.col("reliability") == value) for n, value in grades.items()},
    }


def estimate_metrics(silver: DataFrame) -> DataFrame:
    """Rows, rows without a number, and rows per grade, in one pass."""
    columns = {"row_count": F.count("*"), **metric_columns()}
    return silver.agg(*[c.alias(name) for name, c in columns.items()])


def estimate_duplicates(bronze: DataFrame) -> DataFrame:
    return duplicate_report(bronze, DATASETS["bronze.estimates"].key)


def load_summary(config: DataFrame, variables: DataFrame, bronze: DataFrame) -> DataFrame:
    return ingest_summary(config, variables, bronze)


def table_coverage(config: DataFrame, bronze: DataFrame) -> DataFrame:
    """Counts of configured, ingested, missing and extra tables."""
    return coverage_counts(config, bronze, ["table_id"])


def load_all(
    spark: SparkSession,
    root: str,
    config_path: str,
    variables_path: str,
    payload_path: str,
    year: int,
    whole_files: bool = True,
    fmt: str = "parquet",
    now: datetime | None = None,
) -> dict[str, str]:
    """Landed files to bronze, silver and gold; each layer reads the one written before.

    Reading back the written layer keeps the plans short, and a lost executor
    costs no more than the stage at hand. Responses and rows that can't be read are
    in ``bronze.rejects``. Estimates and facts of other years stand; those of ``year`` are
    replaced. The dimensions follow from all years. Counts of rows and grades are in the logs.
    """
    config = read_table_config(spark, config_path)
    payloads = read_payloads(spark, payload_path, whole_files)
    paths = {}

    def store(name: str, df: DataFrame, metrics: dict[str, Column] | None = None) -> DataFrame:
        paths[name] = write_dataset(df, root, name, fmt, metrics=metrics)
        return read_dataset(spark, root, name, fmt)

    variables = store(
        "bronze.variables", read_variable_labels(spark, variables_path, whole_files)
    )
    selected = store("bronze.selected_variables", selected_variables(config, variables))
    store("bronze.rejects", rejects(payloads))
    this_year = F.col("year") == year
    bronze = store("bronze.estimates", bronze_estimates(payloads, selected, year, now))
    silver = store(
        "silver.estimates", silver_estimates(bronze.filter(this_year), now=now), metric_columns()
    )
    store("gold.dim_variable", dim_variable(silver))
    store("gold.dim_tract", dim_tract(silver))
    store("gold.fact_estimates", fact_estimates(silver.filter(this_year)))
    return paths
