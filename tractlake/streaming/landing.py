"""Landing folder to an append-only log, and to a clean table with one row per key.

A checkpointed file stream gives each landed file to exactly one batch. A batch
writes its own ``batch_id`` folder of the log, and commits the newest row of each of its keys
as a delta of the clean table (``sinks/commits.py``): no other row is read or written. Readers
merge deltas with the rest, and see a batch whole or not at all. When deltas are many, or hold a
large share of the rows, they are written together with the rest, as a new version. A delta
carries its batch's number as token, so a batch that is repeated after a crash adds nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tractlake.functions.dates import run_timestamp
from tractlake.operators.dedup import keep_latest
from tractlake.sinks.commits import commit_version, commits, compact, observed_write, read_committed

BATCH = "batch_id"
INGESTED = "ingest_timestamp"


def log_schema(schema: T.StructType) -> T.StructType:
    return T.StructType(
        [
            *schema.fields,
            T.StructField(INGESTED, T.TimestampNTZType()),
            T.StructField(BATCH, T.LongType()),
        ]
    )


def read_log(spark: SparkSession, log_path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(log_schema(schema)).parquet(log_path)


def merge_batch(
    spark: SparkSession, batch: DataFrame, keys: Sequence[str], target_path: str, batch_id: int
) -> bool:
    """Commit the newest row of each key of ``batch``, unless that batch has been committed."""
    log, token = commits(spark, target_path), f"batch-{batch_id}"
    if log is not None and not log.filter(F.col("token") == token).isEmpty():
        return False
    newest = keep_latest(batch, keys, BATCH).drop("rn")
    commit_version(newest, target_path, keys=None if log is None else keys, token=token)
    compact(spark, target_path)
    return True


def ingest_new_files(
    spark: SparkSession,
    landing_dir: str,
    schema: T.StructType,
    keys: Sequence[str],
    log_path: str,
    target_path: str,
    checkpoint_path: str,
    fmt: str = "json",
    max_files_per_batch: int | None = None,
    now: datetime | None = None,
) -> int:
    """Take in the files landed since the last run, then stop; gives the batches run.

    ``checkpoint_path`` must lie in a folder that outlives the cluster.
    """
    batches = []

    def take_in(batch: DataFrame, batch_id: int) -> None:
        stamped = batch.withColumn(INGESTED, run_timestamp(now))
        batch_path = f"{log_path}/{BATCH}={batch_id}"
        # A batch's folder is its own, so a repeated batch overwrites it.
        observed_write(stamped, batch_path, "parquet", mode="overwrite")
        session = batch.sparkSession
        landed = (
            session.read.schema(stamped.schema)
            .parquet(batch_path)
            .withColumn(BATCH, F.lit(batch_id).cast("long"))
        )
        merge_batch(session, landed, keys, target_path, batch_id)
        batches.append(batch_id)

    reader = spark.readStream.format(fmt).schema(schema)
    if max_files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_batch)
    query = (
        reader.load(landing_dir)
        .writeStream.foreachBatch(take_in)
        .option("checkpointLocation", checkpoint_path)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return len(batches)


def clean_table(spark: SparkSession, target_path: str, schema: T.StructType) -> DataFrame:
    """The clean table, with the columns of ``schema`` and the time of ingest."""
    names = [*schema.fieldNames(), INGESTED]
    return read_committed(spark, target_path, "parquet", log_schema(schema)).select(*names)
