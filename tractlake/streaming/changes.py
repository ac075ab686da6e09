"""Has a source changed since the last recorded run?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tractlake.operators.dedup import keep_first
from tractlake.operators.joins import left_lookup

NEVER_RUN = -1


def last_counts(run_metrics: DataFrame) -> DataFrame:
    """(source, previous): the count of the newest recorded run of each source.

    ``run_metrics`` has source, run_at and records.
    """
    newest = keep_first(run_metrics, ["source"], [F.col("run_at").desc_nulls_last()])
    return newest.select("source", F.col("records").cast("bigint").alias("previous"))


def change_check(current: DataFrame, run_metrics: DataFrame) -> DataFrame:
    """(source, current, previous, changed); a source never run counts as changed.

    ``current`` has one row per source: source and records.
    """
    counts = current.select("source", F.col("records").cast("bigint").alias("current"))
    return left_lookup(
        counts, last_counts(run_metrics), "source", {"previous": NEVER_RUN}
    ).withColumn("changed", F.col("current") != F.col("previous"))
