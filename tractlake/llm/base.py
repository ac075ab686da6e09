"""Shared by the corpus operators: words, widths, stored intermediates, the query list."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tractlake.workspace import fresh_dir, materialize

__all__ = ["fresh_dir", "materialize"]

# The white space between words; ``bytes.split()`` splits at the same six bytes.
SPACE = b" \t\n\v\f\r"
WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def width(spark: SparkSession) -> int:
    """Shuffle partitions of the session, which the cluster sets by the size of its data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def replace_columns(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Append ``columns``; columns of ``df`` that have one of their names go."""
    return df.drop(*columns).select("*", *[c.alias(name) for name, c in columns.items()])


def utf8(text: str = "text") -> Column:
    """The text's bytes, as tasks in Python read them; null becomes empty."""
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def word_numbers(texts: list[list[bytes]]):
    """Numbers of all texts' words, one after the other, and the different words in the order of their numbers."""
    import numpy as np

    known: defaultdict[bytes, int] = defaultdict()
    known.default_factory = known.__len__
    total = sum(map(len, texts))
    return np.fromiter(map(known.__getitem__, chain.from_iterable(texts)), np.int64, total), list(known)


def in_parts(batches: Iterator, column: str, most: int) -> Iterator:
    """Arrow batches cut into rows whose ``column`` holds about ``most`` bytes, one row at least."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if batch.num_rows:
            sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
            part = (np.cumsum(sizes, dtype=np.int64) - 1) // most
            cuts = np.r_[0, np.flatnonzero(np.diff(part)) + 1, batch.num_rows].tolist()
            for a, b in zip(cuts, cuts[1:]):
                yield batch.slice(a, b - a)


def folder_of(path: str):
    """The file system of ``path`` and the path in it, for files that tasks write themselves."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))
