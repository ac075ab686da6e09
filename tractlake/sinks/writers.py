"""Writers. But for ``append_rows`` without a token, every one replaces what it owns: a re-run gives the same table.

Replacing commits a new version (``commits.py``): each row is written once, and readers that go
through ``read_path``, ``read_dataset`` or the catalog see the old rows until the new ones are complete.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tractlake.functions.dates import snapshot_stamp
from tractlake.operators.columns import quoted
from tractlake.schemas import DATASETS
from tractlake.sinks.commits import ROWS, commit_version, commits, new_version, observed_write, record


def ensure_namespace(spark: SparkSession, namespace: str, location: str | None = None) -> None:
    """``catalog.namespace`` is a namespace of that catalog."""
    path = (location or "").replace("\\", "\\\\").replace("'", "\\'")
    where = f" LOCATION '{path}'" if location else ""
    name = ".".join(quoted(part) for part in namespace.split("."))
    spark.sql(f"CREATE NAMESPACE IF NOT EXISTS {name}{where}")


def ensure_table(
    spark: SparkSession, table: str, schema: T.StructType, fmt: str = "parquet"
) -> None:
    """Create an empty table of this schema unless there is one."""
    if not spark.catalog.tableExists(table):
        spark.createDataFrame([], schema).write.format(fmt).saveAsTable(table)


def conform(df: DataFrame, schema: T.StructType, keep_others: bool = False) -> DataFrame:
    """The columns and types of ``schema``; another column is an error, or comes after them."""
    others = [field for field in df.schema if field.name not in schema.fieldNames()]
    if others and not keep_others:
        names = ", ".join(sorted(field.name for field in others))
        raise ValueError(f"columns not in the schema: {names}")
    return df.to(T.StructType([*schema.fields, *others]))


def append_rows(
    df: DataFrame, table: str, schema: T.StructType, fmt: str = "parquet", token: str | None = None
) -> int:
    """Append under the fixed schema and give the number of rows; none is no change.

    With a ``token`` rows are added once: a load that is repeated with the same token adds nothing,
    if the first one came to its end. The tokens are in a log beside the table.
    """
    spark = df.sparkSession
    home = _home(spark, table) if token is not None else ""
    if token is not None:
        log = commits(spark, home)
        if log is not None and not log.filter(F.col("token") == token).isEmpty():
            return 0
    observation = Observation()
    counted = conform(df, schema).observe(observation, F.count(F.lit(1)).alias(ROWS))
    counted.write.format(fmt).mode("append").saveAsTable(table)
    if token is not None:
        record(spark, home, new_version(), table, fmt, observation.get, token=token, scopes=["append"])
    return observation.get[ROWS]


def _home(spark: SparkSession, table: str) -> str:
    """The folder that holds the versions and the log of a table of the session's catalog."""
    namespace, _, name = table.rpartition(".")
    found = spark.catalog.getDatabase(namespace or spark.catalog.currentDatabase())
    return f"{found.locationUri.rstrip('/')}/{name.strip('`')}_versions"


def replace_table(
    df: DataFrame,
    table: str,
    fmt: str = "parquet",
    partition_by: Sequence[str] = (),
) -> dict:
    """Clear and reload: rows are written once, to a new folder, and then the table points there.

    A load that fails, at any place, leaves the table as it was; it may be an input of ``df``. Where
    columns or partitions change, the table is defined anew, in two steps. Gives the observed
    counts. Tables of other catalogs are replaced by their own means.
    """
    spark = df.sparkSession
    if table.count(".") > 1:
        df.writeTo(table).using(fmt).partitionedBy(*map(F.col, partition_by)).createOrReplace()
        return {}
    home, version = _home(spark, table), new_version()
    data = f"{home}/_versions/{version}"
    observed = observed_write(df, data, fmt, partition_by)
    quoted_path = data.replace("\\", "\\\\").replace("'", "\\'")
    kinds = [(f.name, f.dataType) for f in df.schema]
    same = (
        not partition_by
        and spark.catalog.tableExists(table)
        and [(f.name, f.dataType) for f in spark.table(table).schema] == kinds
    )
    if same:
        spark.sql(f"ALTER TABLE {table} SET LOCATION '{quoted_path}'")
    else:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        spark.catalog.createTable(table, data, fmt)
        if partition_by:
            spark.catalog.recoverPartitions(table)
    record(spark, home, version, data, fmt, observed)
    return observed


def replace_path(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    partition_by: Sequence[str] = (),
) -> str:
    """Commit a new version of a folder and give the version's own folder.

    Rows are written once, brought together by partition. ``read_path`` reads the newest version.
    """
    return commit_version(df, path, fmt, partition_by)[0]


def replace_partitions(
    df: DataFrame, path: str, partition_by: Sequence[str], fmt: str = "parquet"
) -> None:
    """Replace only the partitions that ``df`` has rows for.

    Rows are brought together by partition first, or every task would write a file
    to every partition. The rebalance hint splits a partition that holds a large
    share of the rows over several tasks.
    """
    (
        df.hint("rebalance", *partition_by)
        .write.format(fmt)
        .mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_by)
        .save(path)
    )


def write_dataset(
    df: DataFrame,
    root: str,
    name: str,
    fmt: str = "parquet",
    keep_others: bool = False,
    metrics: Mapping[str, Column] | None = None,
) -> str:
    """Replace a registered table, under its registered schema and partitions.

    Of a table with partitions, those that ``df`` has rows for are replaced, the others stand.
    ``keep_others`` also stores columns that the schema doesn't name. The log has the number of rows, and
    ``metrics``. Gives the folder of the new version.
    """
    dataset = DATASETS[name]
    rows = conform(df, dataset.schema, keep_others)
    return commit_version(
        rows,
        dataset.location(root),
        fmt,
        dataset.partition_by,
        metrics,
        scoped=bool(dataset.partition_by),
    )[0]


# A gzip file doesn't split, and a reader packs files into a task by compressed size plus an
# open cost each: with a bound on records per file, a task reads a bounded number of records.
JSON_RECORDS_PER_FILE = 50_000
JSON_SNAPSHOT_OPTIONS = {"compression": "gzip", "maxRecordsPerFile": str(JSON_RECORDS_PER_FILE)}


def write_snapshot(
    df: DataFrame,
    directory: str,
    fmt: str = "json",
    now: datetime | None = None,
    metrics: Mapping[str, Column] | None = None,
) -> str | None:
    """Write ``snapshot=<UTC stamp>`` and commit it; stamps sort by time. None if there were no rows.

    JSON goes out as one record per line in gzip part files of at most ``JSON_RECORDS_PER_FILE``
    records, so a reading task gets a bounded share of a large snapshot however few tasks wrote
    it, and text that repeats every field name is written and read back at a fraction of its size. The write itself counts the rows: a snapshot without
    rows isn't committed, so the newest one always has some, and the plan runs once.
    """
    stamp = snapshot_stamp(now)
    path = f"{directory.rstrip('/')}/snapshot={stamp}"
    options = JSON_SNAPSHOT_OPTIONS if fmt == "json" else None
    observed = observed_write(df, path, fmt, metrics=metrics, mode="overwrite", options=options)
    if not observed[ROWS]:
        return None
    record(df.sparkSession, directory, stamp, path, fmt, observed)
    return path


def write_with_metrics(
    df: DataFrame, path: str, metrics: Mapping[str, Column], fmt: str = "parquet"
) -> dict:
    """Replace a path and return aggregates observed by the same pass."""
    observed = commit_version(df, path, fmt, metrics=metrics)[1]
    return {name: observed[name] for name in metrics}
