"""Pick the newest of the time-stamped snapshots in a directory."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tractlake.sinks.commits import newest_commit
from tractlake.sources.files import read_json, read_json_lines

SNAPSHOT_PREFIX = "snapshot="


def find_latest_snapshot(
    spark: SparkSession, directory: str, pattern: str = "*.json"
) -> str | None:
    """Path of the newest snapshot, or None if there is none.

    Where the directory has a log, the newest committed snapshot: nothing is listed, and a
    folder whose write never finished, or had no rows, doesn't count. Else the file that
    sorts last, as others land them: only the listing is read, and one path comes to the driver.
    """
    committed = newest_commit(spark, directory)
    if committed is not None:
        return committed.path
    listing = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True)
    )
    try:
        files = listing.load(directory).filter(~F.col("path").contains(f"/{SNAPSHOT_PREFIX}"))
        return files.agg(F.max("path")).first()[0]
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def latest_snapshot(spark: SparkSession, directory: str, pattern: str = "*.json") -> str:
    """As above, but a directory without snapshots is an error."""
    path = find_latest_snapshot(spark, directory, pattern)
    if path is None:
        raise FileNotFoundError(f"no snapshot {pattern} in {directory}")
    return path


def read_latest_json(
    spark: SparkSession,
    directory: str,
    schema: T.StructType | None = None,
) -> DataFrame:
    """Rows of the newest JSON snapshot.

    ``write_snapshot`` writes a record per line. A file that others landed may have records or
    arrays by line, or be one array: its first line tells.
    """
    committed = newest_commit(spark, directory)
    if committed is not None:
        return read_json_lines(spark, committed.path, schema)
    return read_json(spark, latest_snapshot(spark, directory), schema)
