"""Session settings the pipelines are tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Adaptive execution does the run-time work: it merges small shuffle partitions,
# splits skewed ones and turns a join into a broadcast only after it has measured
# the side. So the shuffle width can be set for the largest stage.
CLUSTER_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.autoBroadcastJoinThreshold": "64m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
}

# About 128 MB per shuffle partition for a 2.5 TB exchange; adaptive execution
# merges partitions that turn out smaller.
CLUSTER_SHUFFLE_PARTITIONS = 20_000


def build_session(
    app_name: str = "tractlake",
    master: str | None = None,
    shuffle_partitions: int = CLUSTER_SHUFFLE_PARTITIONS,
    conf: dict[str, str] | None = None,
) -> SparkSession:
    """A session with the cluster settings; ``conf`` entries win over them."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        **CLUSTER_CONF,
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        **(conf or {}),
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
