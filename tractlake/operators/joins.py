"""Lookups, existence tests and two-way coverage.

No join here carries a broadcast hint. Spark broadcasts a side when its measured
size is below ``spark.sql.autoBroadcastJoinThreshold`` and sort-merges otherwise,
with skewed partitions split at run time, so a dimension may outgrow a broadcast.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tractlake.operators.columns import quoted

_SALT = "__salt"


def left_lookup(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str] | str,
    defaults: Mapping[str, object] | None = None,
    salts: int = 1,
) -> DataFrame:
    """Left join to a table unique on ``on``; ``defaults`` fill the columns of a miss.

    With ``salts`` above 1 a hot key is cut into that many parts: each left row
    takes a salt from a hash of the whole row, and the right side is repeated once
    per salt. The hash is stable, so a re-run task sends the same rows. Use it when
    the right side is too large to broadcast and one key holds a large share.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if salts > 1:
        left = left.withColumn(
            _SALT, F.pmod(F.xxhash64(*[F.col(quoted(c)) for c in left.columns]), F.lit(salts))
        )
        right = right.withColumn(
            _SALT, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint")))
        )
        joined = left.join(right, [*keys, _SALT], "left").drop(_SALT)
    else:
        joined = left.join(right, keys, "left")
    for name, value in (defaults or {}).items():
        joined = joined.withColumn(name, F.coalesce(F.col(quoted(name)), F.lit(value)))
    return joined


def star_join(fact: DataFrame, dimensions: Mapping[str, DataFrame], salts: int = 1) -> DataFrame:
    """Fact rows with the columns of each dimension, ``{key: dimension}``."""
    for key, dimension in dimensions.items():
        fact = left_lookup(fact, dimension, key, salts=salts)
    return fact


def with_match(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str
) -> DataFrame:
    """Rows of ``left`` that have a match in ``right``.

    The right keys are made distinct first: a key that holds many right rows
    collapses in each task before it is sent.
    """
    keys = right.select(F.col(quoted(right_key)).alias(left_key)).distinct()
    return left.join(keys, left_key, "left_semi")


def coverage(
    configured: DataFrame,
    ingested: DataFrame,
    keys: Sequence[str],
    missing: str = "missing",
    extra: str = "extra",
) -> DataFrame:
    """Keys of one side only, with ``status``: missing (not ingested) or extra.

    One tagged union and one grouping do both differences: a single exchange with
    partial aggregation, no join, and a null key counts as a key.
    """
    names = [quoted(k) for k in keys]
    tagged = configured.select(
        *names, F.lit(1).alias("wanted"), F.lit(0).alias("landed")
    ).unionAll(ingested.select(*names, F.lit(0).alias("wanted"), F.lit(1).alias("landed")))
    return (
        tagged.groupBy(*names)
        .agg(F.max("wanted").alias("wanted"), F.max("landed").alias("landed"))
        .filter(F.col("wanted") != F.col("landed"))
        .select(
            *names, F.when(F.col("wanted") == 1, missing).otherwise(extra).alias("status")
        )
    )
