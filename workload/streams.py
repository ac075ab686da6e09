"""Runs that take in only what is new."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tractlake.streaming.changes import change_check
from tractlake.streaming.landing import clean_table, ingest_new_files
from tractlake.workspace import fresh_dir
from workload.landing import CLOCK
from workload.registry import query, table

EVENT = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("value", T.DoubleType()),
    ]
)


@query(
    "T1 W1",
    """
    SELECT event_id, event_type, user_id,
           CASE WHEN event_type IN ('click', 'error') THEN value * 2 ELSE value END AS value
    FROM events
    """,
)
def landed_stream(spark, sf_dir):
    """All events land, then a second drop with new values for two event types."""
    root = fresh_dir(spark, "stream")
    events = table(spark, sf_dir, "events").select(*EVENT.fieldNames())
    corrected = events.filter(F.col("event_type").isin("click", "error")).withColumn(
        "value", F.col("value") * 2
    )
    for drop in (events, corrected):
        drop.write.mode("append").json(f"{root}/landing")
        ingest_new_files(
            spark,
            f"{root}/landing",
            EVENT,
            ["event_type", "event_id"],
            f"{root}/log",
            f"{root}/clean",
            f"{root}/checkpoint",
            now=CLOCK,
        )
    return clean_table(spark, f"{root}/clean", EVENT).select(*EVENT.fieldNames())


@query(
    "T1",
    """
    WITH runs AS (
        SELECT event_type AS source, user_id, max(ts) AS run_at, count(*) AS records
        FROM events GROUP BY 1, 2),
    newest AS (
        SELECT source, records FROM (
            SELECT *, row_number() OVER (PARTITION BY source
                ORDER BY run_at DESC, user_id DESC, records DESC) AS rn FROM runs)
        WHERE rn = 1),
    now AS (SELECT event_type AS source, count(*) AS records FROM events GROUP BY 1)
    SELECT now.source, now.records AS current, coalesce(newest.records, -1) AS previous,
           now.records <> coalesce(newest.records, -1) AS changed
    FROM now LEFT JOIN newest USING (source)
    """,
)
def changed_sources(spark, sf_dir):
    """Event types as sources, and the activity of each user as an earlier run."""
    events = table(spark, sf_dir, "events")
    current = events.groupBy(F.col("event_type").alias("source")).agg(
        F.count("*").alias("records")
    )
    runs = events.groupBy(F.col("event_type").alias("source"), "user_id").agg(
        F.max("ts").alias("run_at"), F.count("*").alias("records")
    )
    return change_check(current, runs)
