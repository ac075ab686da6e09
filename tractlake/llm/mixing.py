"""Operator 6: mixing sources to target weights by pivotal dependent rounding.

Each source has a target in words. Every row of it gets the expected number of copies
``target / source size``; the whole part is certain and the fraction is to be rounded to 0
or 1. Two rows with fractions a and b and sizes s and t trade: one gains, the other loses the same number
of words, until one of the fractions is 0 or 1. Which one gains is drawn so that both
expectations stay. A trade keeps ``a*s + b*t``, so a whole source ends within one row's size
of its target, while every row keeps its own chance.

Groups of rows of one source trade until one fraction is left in each; the rows that are
left over trade in larger groups, level by level, in a tree that ends with one row for each
source. Its fraction is rounded at random. Only the rows left over move between levels.

Draws are hashed from the rows and a seed, and the rows of a group are sorted, so reruns agree,
however the input is split.

Equal rows are one item with a count: the whole part of ``count * fraction`` is certain, the
rest is rounded once, and the item's rows share the copies. So a row that is repeated
without end is not a group of any size. Null or empty texts have size 0 and are taken once or
not by the same law; they add no words. Null sources are a source, the last one. Empty tables
give empty tables. Input columns with an output's name are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tractlake.llm.base import WORD, Query, materialize, replace_columns, table, utf8

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
GROUP = 2_000
KEY = ("doc_id", "source", "size", "__text_hash")


def word_count(text: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")


def source_targets(
    sized: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
) -> DataFrame:
    """(source, source_size, items, target) from (source, size, ...).

    Sources in order of code points, null last, take ``weights`` in turn and share
    ``share`` of all words by them, but none gets over ``most`` times its own words; what is
    over goes to the others by weight. That is ``min(most * size, weight * level)`` with one
    level for all: sources reach their limit in order of ``most * size / weight``, and the
    level follows from the sums on both sides of the last one that does. One row per source.
    """
    if not 0 < share <= most:
        raise ValueError("share must be above 0 and no more than most")
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_limit = Window.orderBy("__limit", F.col("source").asc_nulls_last())
    up_to = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    everywhere = Window.partitionBy(F.lit(1))
    sums = sized.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count("*").alias("items")
    )
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1)
    cap = F.lit(float(most)) * F.col("source_size")
    left = F.lit(float(share)) * F.sum("source_size").over(everywhere) - F.coalesce(
        F.sum(cap).over(up_to), F.lit(0.0)
    )
    open_weight = F.sum("__weight").over(everywhere) - F.coalesce(
        F.sum("__weight").over(up_to), F.lit(0.0)
    )
    leveled = (
        sums.withColumn("__weight", weight)
        .withColumn("__limit", cap / F.col("__weight"))
        .withColumn("__level", left / open_weight)
        # The level if this source and those after it stay below their limits.
        .withColumn("__open", F.col("__level") < F.col("__limit"))
        .withColumn(
            "__level", F.min(F.when(F.col("__open"), F.struct("__limit", "__level"))).over(everywhere)
        )
    )
    target = F.least(cap, F.coalesce(F.col("__weight") * F.col("__level.__level"), cap))
    return leveled.select("source", "source_size", "items", target.alias("target"))


def _trade(size: np.ndarray, part: np.ndarray, draw: np.ndarray) -> tuple[np.ndarray, int]:
    """Rounds the fractions ``part``; all but one, whose place is returned (-1: none is left)."""
    part, left = part.copy(), -1
    for i in range(len(part)):
        if not 1e-9 < part[i] < 1 - 1e-9:
            part[i] = round(part[i])
            continue
        if left < 0:
            left = i
            continue
        j, s, t = left, float(size[left]), float(size[i])
        # Words that can go from j to i, and from i to j, before a fraction is 0 or 1.
        forth = min(part[j] * s, (1 - part[i]) * t)
        back = min((1 - part[j]) * s, part[i] * t)
        # A draw in proportion to the other amount keeps both expectations.
        moved = forth if draw[i] * (forth + back) < back else -back
        part[j] -= moved / s
        part[i] += moved / t
        open_j, open_i = (1e-9 < x < 1 - 1e-9 for x in (part[j], part[i]))
        for k, is_open in ((j, open_j), (i, open_i)):
            if not is_open:
                part[k] = round(part[k])
        left = j if open_j else i if open_i else -1
    return part, left


def _level(items: DataFrame, last: bool) -> DataFrame:
    """One level: ``extra`` is 0 or 1 where decided; null where a row is left over."""

    def run(rows: pa.Table) -> pa.Table:
        draw, ties, size, part, draw2, draw3 = (
            rows.column(c).to_numpy()
            for c in ("draw", "__text_hash", "size", "part", "draw2", "draw3")
        )
        order = np.lexsort((ties, draw))
        rounded, left = _trade(size[order], part[order], draw2[order])
        if left >= 0 and last:
            rounded[left] = float(draw3[order[left]] < rounded[left])
            left = -1
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        open_row = back == left
        at = rows.schema.get_field_index("part")
        rows = rows.set_column(at, "part", pa.array(rounded[back]))
        return rows.append_column("extra", pa.array(rounded[back], mask=open_row))

    schema = T.StructType([*items.schema.fields, T.StructField("extra", T.DoubleType())])
    return items.groupBy("__source", "bucket").applyInArrow(run, schema)


def _uniform(seed: int, *columns: str) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11)
    return (bits.cast("double") + F.lit(0.5)) * F.lit(2.0**-53)


def decide(
    sized: DataFrame,
    seed: int = 7,
    group: int = GROUP,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
) -> DataFrame:
    """One row per distinct (doc_id, source, size, __text_hash) of ``sized``.

    Adds ``rows`` (how many are equal), ``copies`` (of all of them together), ``source_size``
    and ``target``. ``sized`` is read twice: pass a stored one.
    """
    targets = materialize(source_targets(sized, weights, share, most), "targets")
    ratio = F.when(
        F.col("source_size") > 0, F.col("target") / F.col("source_size")
    ).otherwise(F.lit(0.0))
    rate = F.least(F.lit(float(most)), ratio)
    items = (
        sized.groupBy(*KEY)
        .agg(F.count("*").alias("rows"))
        .join(targets.withColumnRenamed("source", "__t"), F.col("source").eqNullSafe(F.col("__t")))
        .withColumn("rate", rate)
        .withColumn("__whole", F.floor(F.col("rate")) * F.col("rows"))
        .withColumn("__more", (F.col("rate") - F.floor("rate")) * F.col("rows"))
        .withColumn("sure", F.col("__whole") + F.floor("__more"))
        .withColumn("part", F.col("__more") - F.floor("__more"))
        .withColumn("__source", F.xxhash64(F.col("source").isNull(), "source"))
        .withColumn("__groups", F.ceil(F.col("items") / F.lit(float(group))))
        .withColumn("draw", _uniform(seed, *KEY))
        .withColumn("draw2", _uniform(seed + 1, *KEY))
        .withColumn("draw3", _uniform(seed + 2, *KEY))
    )
    # Empty texts have nothing to trade: each is rounded by itself.
    columns = [
        *KEY, "rows", "sure", "part", "source_size", "target", "__source", "draw", "draw2", "draw3",
    ]
    alone = items.filter("size = 0").select(
        *columns, (F.col("draw3") < F.col("part")).cast("double").alias("extra")
    )
    most_items = targets.agg(F.max("items")).first()[0] or 0
    levels = math.ceil(math.log(max(1, most_items / group), group))
    bucket = F.pmod(F.xxhash64(F.lit(seed), *KEY), F.col("__groups")).cast("long")
    open_items = items.filter("size > 0").select(*columns, bucket.alias("bucket"))
    done = [alone]
    for level in range(levels + 1):
        last = level == levels
        if level:
            step = F.lit(0) if last else F.floor(F.col("bucket") / F.lit(group))
            open_items = open_items.withColumn("bucket", step.cast("long"))
            open_items = open_items.drop("extra")
        # Draws of a level are its own: what was drawn before has led here.
        open_items = open_items.withColumn("draw2", _uniform(seed + 10 + level, *KEY))
        result = materialize(_level(open_items, last), f"rounding-{level}")
        done.append(result.filter("extra IS NOT NULL").select(*columns, "extra"))
        open_items = result.filter("extra IS NULL")
    union = done[0]
    for one in done[1:]:
        union = union.unionByName(one)
    copies = (F.col("sure") + F.col("extra")).cast("long")
    return union.select(*KEY, "rows", "source_size", "target", copies.alias("copies"))


def _share_out(rows: str, copies: str, number: Column) -> Column:
    """Copies of one of ``rows`` equal rows, by its number from 0."""
    whole = F.floor(F.col(copies) / F.col(rows))
    over = F.col(copies) - whole * F.col(rows)
    return (whole + (number < over).cast("long")).cast("long")


def sized_rows(docs: DataFrame) -> DataFrame:
    """The metadata that the rounding needs, one row per document."""
    return docs.select(
        F.col("doc_id"),
        F.col("source"),
        word_count().alias("size"),
        F.xxhash64(utf8(), F.col("text").isNull()).alias("__text_hash"),
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it.

    Rows find their copies by an equi-join on id, source and text hash, whose skew Spark can
    split; the numbering of equal rows reuses the order of the join.
    """
    own = docs.columns
    decided = materialize(decide(materialize(sized_rows(docs), "sized"), **options), "copies")
    keyed = replace_columns(
        docs.select(F.struct(*[F.col(c) for c in own]).alias("__row")),
        {
            "__id": F.col("__row.doc_id"),
            "__src": F.col("__row.source"),
            "__hash": F.xxhash64(
                F.coalesce(F.col("__row.text"), F.lit("")).cast("binary"),
                F.col("__row.text").isNull(),
            ),
        },
    )
    chosen = decided.select(
        F.col("doc_id").alias("__of_id"),
        F.col("source").alias("__of_src"),
        F.col("__text_hash").alias("__of_hash"),
        F.col("rows").alias("__rows"),
        F.col("copies").alias("__copies"),
    ).filter("__copies > 0")
    same = (
        F.col("__id").eqNullSafe(F.col("__of_id"))
        & F.col("__src").eqNullSafe(F.col("__of_src"))
        & (F.col("__hash") == F.col("__of_hash"))
    )
    joined = keyed.join(chosen, same)
    numbered = Window.partitionBy("__id", "__src", "__hash").orderBy("__hash")
    each = _share_out("__rows", "__copies", F.row_number().over(numbered) - 1)
    return (
        joined.select("__row", each.alias("__n"))
        .filter("__n > 0")
        .select("__row", F.explode(F.sequence(F.lit(1), F.col("__n").cast("int"))))
        .select([F.col(f"__row.`{c}`") for c in own])
    )


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = materialize(sized_rows(table(spark, sf_dir, "documents")), "sized")
    decided = decide(sized)
    each = decided.withColumn("__number", F.explode(F.sequence(F.lit(1), F.col("rows")))).withColumn(
        "__number", F.col("__number") - 1
    )
    return each.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("size") * _share_out("rows", "copies", F.col("__number"))).alias("taken"),
    )


QUERIES = [Query("op6_mixing", op6_mixing)]
