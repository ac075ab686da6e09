"""Checks on tables. Each is one lazy plan; none collects rows to the driver."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tractlake.functions.text import joined_or
from tractlake.operators.aggregates import distinct_with_null
from tractlake.operators.columns import quoted
from tractlake.sinks.commits import newest_commit
from tractlake.sources.files import read_path
from tractlake.sources.snapshots import find_latest_snapshot


class EmptyInputError(RuntimeError):
    """A step that must have rows got none."""


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """``df`` itself, or an error if it is empty.

    Meant for inputs, where one row is enough to know. Behind a shuffle the check
    would run the whole plan before it.
    """
    if df.isEmpty():
        raise EmptyInputError(f"{what}: no rows")
    return df


def duplicate_report(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """total_rows, distinct_keys and duplicate_rows in one row.

    Counts per key are made in each task first, so a hot key sends one number.
    """
    per_key = df.groupBy(*[F.col(quoted(k)) for k in keys]).agg(F.count("*").alias("n"))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
        F.count("*").alias("distinct_keys"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"),
    )


def coverage_counts(
    configured: DataFrame, ingested: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """configured, ingested, missing and extra keys in one row, by one exchange."""
    names = [quoted(k) for k in keys]
    tagged = configured.select(
        *names, F.lit(1).alias("wanted"), F.lit(0).alias("landed")
    ).unionAll(ingested.select(*names, F.lit(0).alias("wanted"), F.lit(1).alias("landed")))
    per_key = tagged.groupBy(*names).agg(
        F.max("wanted").alias("wanted"), F.max("landed").alias("landed")
    )
    return per_key.agg(
        F.count_if(F.col("wanted") == 1).alias("configured"),
        F.count_if(F.col("landed") == 1).alias("ingested"),
        F.count_if(F.col("landed") == 0).alias("missing"),
        F.count_if(F.col("wanted") == 0).alias("extra"),
    )


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """null_<column> for each column, in one pass."""
    return df.agg(*[F.count_if(F.col(quoted(c)).isNull()).alias(f"null_{c}") for c in columns])


def profile(
    df: DataFrame, null_columns: Sequence[str], distinct_columns: Sequence[str]
) -> DataFrame:
    """Nulls per column, and the distinct rows of a column list, null as a value."""
    return df.agg(
        F.count("*").alias("row_count"),
        *[F.count_if(F.col(quoted(c)).isNull()).alias(f"null_{c}") for c in null_columns],
        distinct_with_null(*distinct_columns).alias("distinct_count"),
    )


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, row_count) of several tables, as one job."""
    counted = [
        df.agg(F.count("*").alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count"
        )
        for name, df in tables.items()
    ]
    result, *others = counted
    for other in others:
        result = result.unionAll(other)
    return result


def reconcile(detail: DataFrame, grouped: DataFrame, count_column: str) -> DataFrame:
    """Rows of ``detail`` against the sum of ``count_column``: PASS or FAIL.

    Both sides are one-row aggregates that are stacked and summed, not joined.
    """
    zero = F.lit(0).cast("bigint")
    sides = detail.agg(F.count("*").alias("total_rows"), zero.alias("group_sum")).unionAll(
        grouped.agg(
            zero.alias("total_rows"),
            F.coalesce(F.sum(quoted(count_column)), zero).alias("group_sum"),
        )
    )
    return sides.agg(
        F.sum("total_rows").alias("total_rows"), F.sum("group_sum").alias("group_sum")
    ).withColumn(
        "status", F.when(F.col("total_rows") == F.col("group_sum"), "PASS").otherwise("FAIL")
    )


def schema_report(df: DataFrame, expected: T.StructType) -> DataFrame:
    """(column_name, expected_type, actual_type, ok, null_count), a row per column.

    Covers the columns of both schemas; null_count is null for an absent column.
    One pass gives one row of counters, which is then turned into rows.
    """
    actual_types = {f.name: f.dataType.simpleString() for f in df.schema}
    expected_types = {f.name: f.dataType.simpleString() for f in expected}
    names = sorted({*actual_types, *expected_types})
    place = {name: f"nulls_{i}" for i, name in enumerate(names) if name in actual_types}
    counted = df.agg(
        *[F.count_if(F.col(quoted(n)).isNull()).alias(alias) for n, alias in place.items()]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("column_name"),
                F.lit(expected_types.get(name)).cast("string").alias("expected_type"),
                F.lit(actual_types.get(name)).cast("string").alias("actual_type"),
                F.lit(expected_types.get(name) == actual_types.get(name)).alias("ok"),
                (F.col(place[name]) if name in place else F.lit(None))
                .cast("bigint")
                .alias("null_count"),
            )
            for name in names
        ]
    )
    return counted.select(F.inline(rows))


def load_status(
    configured: DataFrame, described: DataFrame, landed: DataFrame, key: str = "table_id"
) -> DataFrame:
    """(key, status) for each configured table: landed, empty or failed.

    ``described`` holds the ids the source lists variables for, ``landed`` those
    with rows. A table is *landed* if it has rows, *empty* if the source lists
    nothing for it, and *failed* otherwise. Landed rows collapse to one per table
    in each task, before the exchange.
    """

    def tagged(df: DataFrame, flag: str) -> DataFrame:
        flags = [F.lit(int(flag == f)).alias(f) for f in ("wanted", "described", "landed")]
        return df.select(F.col(quoted(key)), *flags)

    per_table = (
        tagged(configured, "wanted")
        .unionAll(tagged(described, "described"))
        .unionAll(tagged(landed, "landed"))
        .groupBy(quoted(key))
        .agg(*[F.max(flag).alias(flag) for flag in ("wanted", "described", "landed")])
    )
    status = (
        F.when(F.col("landed") == 1, "landed")
        .when(F.col("described") == 0, "empty")
        .otherwise("failed")
    )
    return per_table.filter("wanted = 1").select(quoted(key), status.alias("status"))


def ingest_summary(
    configured: DataFrame, described: DataFrame, landed: DataFrame, key: str = "table_id"
) -> DataFrame:
    """One row on a load: configured, landed, empty and failed tables.

    ``failed_ids`` names the failed ones, or is ``none``. It is one text, made for
    a survey's list of tables; take ``load_status`` where thousands may fail.
    """

    def count_of(status: str) -> Column:
        return F.count_if(F.col("status") == status)

    failed = F.when(F.col("status") == "failed", F.col(quoted(key)))
    return load_status(configured, described, landed, key).agg(
        F.count("*").alias("tables_configured"),
        count_of("landed").alias("tables_landed"),
        count_of("empty").alias("tables_empty"),
        count_of("failed").alias("tables_failed"),
        joined_or(F.collect_set(failed)).alias("failed_ids"),
    )


def layer_counts(
    spark: SparkSession, layers: Mapping[str, tuple[str, str, str]]
) -> DataFrame:
    """(layer, records) of the newest snapshot per layer; no snapshot counts 0.

    A committed snapshot's count is in the log of its directory, and isn't read again.

    ``layers`` maps a name to (directory, file pattern, format). Format ``json`` is
    one array of records per file (anything else is an error), ``jsonl`` one record per line.
    """
    counts = []
    for layer, (directory, pattern, fmt) in layers.items():
        committed = newest_commit(spark, directory)
        path = None if committed else find_latest_snapshot(spark, directory, pattern)
        if committed is not None:
            count = F.lit(committed.record_count).cast("bigint")
            counted = spark.range(1).select(count.alias("records"))
        elif path is None:
            counted = spark.range(1).select(F.lit(0).cast("bigint").alias("records"))
        elif fmt == "json":
            pages = spark.read.text(path, wholetext=True)
            wrong = F.raise_error(F.concat(F.lit("expected a JSON list, got: "), F.substring("value", 1, 80)))
            length = F.coalesce(F.json_array_length("value"), wrong.cast("int"))
            counted = pages.agg(
                F.coalesce(F.sum(length), F.lit(0))
                .cast("bigint")
                .alias("records")
            )
        elif fmt == "jsonl":
            lines = spark.read.text(path).filter(F.trim("value") != "")
            counted = lines.agg(F.count("*").alias("records"))
        else:
            counted = read_path(spark, path, fmt).agg(F.count("*").alias("records"))
        counts.append(counted.select(F.lit(layer).alias("layer"), "records"))
    result, *others = counts
    for other in others:
        result = result.unionAll(other)
    return result


def filter_with_dropped(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Rows where ``column`` is not null, and a one-row count of kept and dropped."""
    value = F.col(quoted(column))
    counts = df.agg(
        F.count_if(value.isNotNull()).alias("kept_rows"),
        F.count_if(value.isNull()).alias("dropped_rows"),
    )
    return df.filter(value.isNotNull()), counts
