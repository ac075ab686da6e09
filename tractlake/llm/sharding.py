"""Operator 1: placing rows in a tree of regions, racks and shards by weighted hash draws.

A row descends from the root. At each level every child draws ``-ln(u) / weight``, with
``u`` a uniform number hashed from the row's key and the child's name; the smallest draw
wins. A child wins in proportion to its weight, which is the sum of the leaves below it.
A draw depends on nothing but key, child and weight. So when weights change, a row moves
only into a child whose weight rose or out of one whose weight fell, and everything under
the other children stays where it is.

A shard that joins as a region of its own changes no other weight: it takes its
share of rows, and no row moves between two older shards.

Null keys: all draw alike and share a place. Equal keys share a place. Empty tables give
empty tables. Columns of the input with the name of an output column are replaced.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tractlake.llm.base import Query, materialize, replace_columns, table, utf8, width


@dataclass(frozen=True)
class Shard:
    number: int
    region: str
    rack: str
    weight: float = 1.0


def build_out(
    shards: int, settled: int | None = None, racks: int = 2, per_rack: int = 4
) -> list[Shard]:
    """Shards 0 to ``shards - 1``, of equal weight.

    The first ``settled`` (default: all) fill racks of ``per_rack`` and regions of ``racks``;
    each later one is a region of its own. With ``settled`` kept, every further shard
    takes rows only into itself.
    """
    settled = shards if settled is None else min(settled, shards)
    first = [
        Shard(n, f"region{n // per_rack // racks}", f"rack{n // per_rack % racks}")
        for n in range(settled)
    ]
    return first + [Shard(n, f"added{n}", "rack0") for n in range(settled, shards)]


def _draw(key: list[Column], child: str, weight: float) -> Column:
    """Exponential with rate ``weight``: the smallest of several wins by weight."""
    bits = F.shiftrightunsigned(F.xxhash64(*key, F.lit(child)), 11)
    uniform = (bits.cast("double") + F.lit(0.5)) * F.lit(2.0**-53)
    return -F.log(uniform) / F.lit(float(weight))


def _choose(key: list[Column], path: str, weights: dict[str, float], values: dict) -> Column:
    """The value of the child with the smallest draw; ties go to the first by name."""
    if len(weights) == 1:
        return F.lit(values[next(iter(weights))])
    draws = F.array(
        *[
            F.struct(
                _draw(key, f"{path}/{name}", weight).alias("draw"),
                F.lit(order).alias("order"),
                F.lit(values[name]).alias("value"),
            )
            for order, (name, weight) in enumerate(sorted(weights.items()))
        ]
    )
    return F.array_min(draws)["value"]


def _among(column: str, choices: dict[object, Column]) -> Column:
    """The choice that belongs to the value of ``column``; the others aren't evaluated."""
    chosen = None
    for value, choice in choices.items():
        test = F.col(column) == F.lit(value)
        chosen = F.when(test, choice) if chosen is None else chosen.when(test, choice)
    return chosen


def place(
    df: DataFrame, shards: list[Shard], key: str = "doc_id", name: str = "shard"
) -> DataFrame:
    """``df`` with the shard each row belongs to; shards of weight 0 take nothing."""
    tree: dict[str, dict[str, dict[int, float]]] = defaultdict(lambda: defaultdict(dict))
    for shard in shards:
        if shard.weight < 0 or shard.number in tree[shard.region][shard.rack]:
            raise ValueError(f"{shard}: negative weight, or listed twice")
        if shard.weight > 0:
            tree[shard.region][shard.rack][shard.number] = shard.weight
    tree = {
        region: {rack: leaves for rack, leaves in racks.items() if leaves}
        for region, racks in tree.items()
        if any(racks.values())
    }
    if not tree:
        raise ValueError("no shard has a weight above 0")
    keys = [F.col(key)]
    regions = {r: sum(sum(x.values()) for x in racks.values()) for r, racks in tree.items()}
    region, rack = f"__{name}_region", f"__{name}_rack"
    at_rack, at_shard = {}, {}
    for r, racks in tree.items():
        weights = {f"{r}/{k}": sum(leaves.values()) for k, leaves in racks.items()}
        at_rack[r] = _choose(keys, r, weights, {path: path for path in weights})
        for k, leaves in racks.items():
            path = f"{r}/{k}"
            by_name = {f"{n:09d}": weight for n, weight in leaves.items()}
            at_shard[path] = _choose(keys, path, by_name, {x: int(x) for x in by_name})
    out = df.drop(name).withColumn(region, _choose(keys, "", regions, {r: r for r in regions}))
    out = out.withColumn(rack, _among(region, at_rack))
    return out.withColumn(name, _among(rack, at_shard)).drop(region, rack)


def slots(df: DataFrame, order: list[str], shard: str = "shard", name: str = "slot") -> DataFrame:
    """``df`` with a number for each row of a shard: 0, 1, 2 and so on without a gap.

    A shard is numbered in parts, chosen by a hash of ``order``; each part starts
    where the ones before it end. The parts' counts are the only rows that meet, so a shard of any size
    is numbered by many tasks. Rows that are equal in ``order`` may swap numbers.
    ``df`` is read twice: pass a stored one.
    """
    part, before = f"__{name}_part", f"__{name}_before"
    parts = df.drop(name).withColumn(
        part, F.pmod(F.xxhash64(*order), F.lit(width(df.sparkSession))).cast("int")
    )
    earlier = Window.partitionBy(shard).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        parts.groupBy(shard, part)
        .agg(F.count("*").alias(before))
        .withColumn(before, F.coalesce(F.sum(before).over(earlier), F.lit(0)))
    )
    within = Window.partitionBy(shard, part).orderBy(*order)
    return (
        parts.withColumn(name, F.row_number().over(within) - F.lit(1))
        .join(starts, [shard, part])
        .withColumn(name, F.col(name) + F.col(before))
        .drop(part, before)
    )


def write_shards(df: DataFrame, path: str, shard: str = "shard") -> None:
    """One folder per shard. A shard is written by several tasks, whatever its size."""
    df.hint("rebalance", F.col(shard)).write.mode("overwrite").partitionBy(shard).parquet(path)


SHARDS = 24


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = utf8()
    digest = replace_columns(
        table(spark, sf_dir, "documents").select("doc_id", "text"),
        {
            "size": F.octet_length(text).cast("long") + F.lit(8),
            "text_crc32": F.crc32(text),
            "law": F.lit("key"),
        },
    ).drop("text")
    placed = place(digest, build_out(SHARDS))
    grown = place(placed, build_out(SHARDS + 1, settled=SHARDS), name="grown_shard")
    stored = materialize(grown, "shards")
    columns = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    return slots(stored, ["doc_id", "size", "text_crc32"]).select(
        *[F.col(c).cast("long") if c == "slot" else F.col(c) for c in columns]
    )


QUERIES = [Query("op1_sharding", op1_sharding)]
