"""Name -> query, the operators it covers and its SQL twin."""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(covers: str, sql: str | None = None):
    """Register a ``(spark, sf_dir) -> DataFrame`` function under its own name."""

    def register(run: Callable[[SparkSession, str], DataFrame]):
        name = run.__name__
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(name, tuple(covers.split()), run, sql)
        return run

    return register


def once_per_session(make: Callable):
    """Keep the result of ``make(spark, sf_dir)`` for the life of the Spark session.

    For inputs: a raw file is landed once and then read by every query on it.
    """
    kept = {}

    @functools.wraps(make)
    def wrapper(spark: SparkSession, sf_dir: str):
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in kept:
            kept[key] = make(spark, sf_dir)
        return kept[key]

    return wrapper


_SCHEMAS = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; its footer is read for the schema the first time only."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)
