"""Committed versions of a folder: data first, then one small record that makes it the newest.

A version is written once, to a folder of its own, ``_versions/<version>``. Then a record with its
path, its rows and what else the write observed is appended to the log, ``_log/commits``. A
record is one file, which Spark's committer moves into place whole. Readers take the path of
the newest record, so they see the old rows until the new ones are complete, and what a failed
write has left is never read. The log is read, nothing is listed; it has a row for each commit.

A version may replace some partitions only: its record names them, as its scopes. The folder's rows
are then those of the newest whole version, without what later versions replace, and theirs. Or it may
replace the rows that have the keys of its own: readers merge such small versions (deltas) with the
whole one, and ``compact`` writes them together.

Versions sort by the UTC time of the driver that wrote them, to the microsecond. The log of a folder
has one writer at a time; of two at once, the one that began later counts.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tractlake.operators.columns import quoted
from tractlake.operators.dedup import concat_tables, first_per_key

COMMIT = T.StructType(
    [
        T.StructField("version", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("format", T.StringType()),
        T.StructField("record_count", T.LongType()),
        T.StructField("token", T.StringType()),
        T.StructField("schema", T.StringType()),
        T.StructField("partition_by", T.ArrayType(T.StringType())),
        T.StructField("keys", T.ArrayType(T.StringType())),
        T.StructField("scopes", T.ArrayType(T.StringType())),
        T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("expired", T.BooleanType()),
    ]
)
ROWS = "record_count"


def new_version() -> str:
    return f"{datetime.now(timezone.utc):%Y%m%d_%H%M%S_%f}-{uuid.uuid4().hex[:8]}"


def commits(spark: SparkSession, path: str) -> DataFrame | None:
    """The log of ``path``; None for a folder that has none."""
    try:
        return spark.read.schema(COMMIT).json(f"{path.rstrip('/')}/_log/commits")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def standing_commits(spark: SparkSession, path: str) -> list[Row]:
    """The records whose rows count, the newest first: partitions, and then one whole version."""
    log = commits(spark, path)
    if log is None:
        return []
    valid = log.filter("NOT expired AND path IS NOT NULL").coalesce(1)
    standing = []
    for row in valid.sortWithinPartitions(F.desc("version")).toLocalIterator():
        standing.append(row)
        if row.scopes is None and row.keys is None:
            break
    return standing


def newest_commit(spark: SparkSession, path: str) -> Row | None:
    """The newest record."""
    return next(iter(standing_commits(spark, path)), None)


def read_committed(
    spark: SparkSession, path: str, fmt: str, schema: T.StructType | None = None
) -> DataFrame:
    """The rows that stand in ``path``; of a folder without a log, all of them."""

    def load(folder: str, stored: T.StructType | None = None) -> DataFrame:
        reader, kind = spark.read.format(fmt), schema if schema is not None else stored
        return (reader.schema(kind) if kind is not None else reader).load(folder)

    standing = standing_commits(spark, path)
    if not standing:
        return load(path)
    parts, replaced = [], set()
    deltas = [row for row in standing if row.keys is not None]
    for row in (row for row in standing if row.keys is None):
        # Partition values of the folder names are read as they were written, not as they look.
        rows = load(row.path, _stored(row))
        if row.scopes is not None or replaced:
            # Of partition columns only, so other folders aren't read.
            names = row.partition_by or next(r.partition_by for r in standing if r.partition_by)
            scope = scope_of(names)
            if row.scopes is None:
                rows = rows.filter(~scope.isin(sorted(replaced)))
            else:
                rows = rows.filter(scope.isin(sorted(set(row.scopes) - replaced)))
                replaced.update(row.scopes)
        parts.append(rows)
    whole = concat_tables(*parts) if parts else None
    return _merged([load(row.path, _stored(row)) for row in deltas], deltas[0].keys, whole) if deltas else whole


def _stored(row: Row) -> T.StructType | None:
    return T.StructType.fromJson(json.loads(row.schema)) if row.schema else None


def _merged(deltas: list[DataFrame], keys: Sequence[str], whole: DataFrame | None) -> DataFrame:
    """The rows of ``deltas``, the newest of each key, and those of ``whole`` that have other keys.

    Deltas are small beside the whole, which is not shuffled if they are under the broadcast
    threshold. Null keys are keys.
    """
    newest, age = deltas[0], "__age"
    if len(deltas) > 1:
        aged = concat_tables(*[d.withColumn(age, F.lit(i)) for i, d in enumerate(deltas)])
        newest = first_per_key(aged, keys, [F.col(age)]).drop(age)
    if whole is None:
        return newest
    changed = newest.select(*[F.col(quoted(k)).alias(f"__key_{i}") for i, k in enumerate(keys)])
    same = [F.col(quoted(k)).eqNullSafe(F.col(f"__key_{i}")) for i, k in enumerate(keys)]
    return whole.join(changed, same, "left_anti").unionByName(newest)


def scope_of(partition_by: Sequence[str]) -> Column:
    """The partition of a row, as text."""
    return F.to_json(F.struct(*[F.col(name).cast("string").alias(name) for name in partition_by]))


def record(
    spark: SparkSession,
    path: str,
    version: str,
    data: str,
    fmt: str,
    observed: Mapping[str, float | None],
    token: str | None = None,
    partition_by: Sequence[str] = (),
    keys: Sequence[str] | None = None,
    scopes: Sequence[str] | None = None,
    schema: T.StructType | None = None,
    expired: bool = False,
) -> None:
    """Append one record; with it the version counts."""
    numbers = {k: v for k, v in observed.items() if k != ROWS and v is not None}
    metrics = F.create_map(*[x for k, v in numbers.items() for x in (F.lit(k), F.lit(float(v)))])
    values = {
        "version": F.lit(version),
        "path": F.lit(data),
        "format": F.lit(fmt),
        "record_count": F.lit(observed.get(ROWS)).cast("bigint"),
        "token": F.lit(token),
        "schema": F.lit(None if schema is None else schema.json()),
        "partition_by": F.array(*map(F.lit, partition_by)) if partition_by else F.lit(None),
        "keys": F.lit(None) if keys is None else F.array(*map(F.lit, keys)),
        "scopes": F.lit(None) if scopes is None else F.array(*map(F.lit, scopes)),
        "metrics": metrics if numbers else F.lit(None),
        "expired": F.lit(expired),
    }
    row = spark.range(0, 1, 1, 1).select(
        *[values[f.name].cast(f.dataType).alias(f.name) for f in COMMIT.fields]
    )
    row.write.mode("append").json(f"{path.rstrip('/')}/_log/commits")


def observed_write(
    df: DataFrame,
    path: str,
    fmt: str,
    partition_by: Sequence[str] = (),
    metrics: Mapping[str, Column] | None = None,
    mode: str = "errorifexists",
    options: Mapping[str, str] | None = None,
) -> dict:
    """Write ``df`` once and give its number of rows and other aggregates, from the same pass."""
    observation = Observation()
    counted = {ROWS: F.count(F.lit(1)), **(metrics or {})}
    # Observed above the exchange, which a plan without rows loses with all that is below it.
    dealt = df.hint("rebalance", *partition_by) if partition_by else df
    watched = dealt.observe(observation, *[c.alias(name) for name, c in counted.items()])
    writer = watched.write.format(fmt).mode(mode).options(**(options or {}))
    writer.option("partitionOverwriteMode", "static").partitionBy(
        *partition_by
    ).save(path)
    return observation.get


def commit_version(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    partition_by: Sequence[str] = (),
    metrics: Mapping[str, Column] | None = None,
    least_rows: int = 0,
    scoped: bool = False,
    keys: Sequence[str] | None = None,
    token: str | None = None,
) -> tuple[str | None, dict]:
    """Write a new version of ``path`` and commit it: its folder, and what the write observed.

    ``scoped``: it replaces the partitions that it has rows for, and no others. ``keys``: it replaces
    the rows with the keys that it has, each in one row. ``token`` names the load in the record.

    A version with fewer than ``least_rows`` rows isn't committed: the old one stays, the
    folder is None.
    """
    version = new_version()
    data = f"{path.rstrip('/')}/_versions/{version}"
    observed = observed_write(df, data, fmt, partition_by, metrics)
    if observed[ROWS] < least_rows:
        return None, observed
    spark, scopes = df.sparkSession, None
    if scoped:
        written = spark.read.format(fmt).schema(df.schema).load(data).select(scope_of(partition_by).alias("scope")).distinct()
        scopes = [row.scope for row in written.toLocalIterator()]  # one row a partition
    record(
        spark,
        path,
        version,
        data,
        fmt,
        observed,
        token=token,
        partition_by=partition_by,
        keys=keys,
        scopes=scopes,
        schema=df.schema,
    )
    return data, observed


def compact(
    spark: SparkSession, path: str, fmt: str = "parquet", most: int = 16, share: float = 0.2
) -> bool:
    """Write deltas and the whole together, if there are many deltas, or they hold a large share of the rows."""
    standing = standing_commits(spark, path)
    deltas = [row.record_count for row in standing if row.keys is not None]
    rows = sum(row.record_count for row in standing[len(deltas) :])
    if not deltas or (len(deltas) < most and sum(deltas) <= share * rows):
        return False
    commit_version(read_committed(spark, path, fmt), path, fmt)
    return True


def expire_versions(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Empty the versions that no rows are read from any more, but the ``keep`` newest; gives their number.

    Who still reads one of these fails. The records stay, with a second one that says so.
    """
    log = commits(spark, path)
    if log is None:
        return 0
    known = log.groupBy("version").agg(
        F.bool_or("expired").alias("gone"), F.max("path").alias("path"), F.max("format").alias("format")
    )
    gone, standing = 0, {row.version for row in standing_commits(spark, path)}
    # One row a commit, one at a time.
    for i, row in enumerate(known.filter("NOT gone").orderBy(F.desc("version")).toLocalIterator()):
        if i >= keep and row.version not in standing:
            spark.range(0).write.format(row.format).mode("overwrite").save(row.path)
            record(spark, path, row.version, row.path, row.format, {}, expired=True)
            gone += 1
    return gone


def run_metrics(spark: SparkSession, sources: Mapping[str, str]) -> DataFrame:
    """(source, run_at, records, metrics) of every committed load; ``sources`` maps names to folders.

    Both are as the loads' writes observed them; nothing is counted again.
    """
    runs = spark.createDataFrame([], "source string, run_at string, records bigint, metrics map<string,double>")
    for source, path in sources.items():
        log = commits(spark, path)
        if log is not None:
            each = log.filter("NOT expired").select(
                F.lit(source).alias("source"),
                F.col("version").alias("run_at"),
                F.col(ROWS).alias("records"),
                "metrics",
            )
            runs = runs.unionByName(each)
    return runs
