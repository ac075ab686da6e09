"""Keep one row per key, and whole-row sets.

A key may hold a large part of all rows. ``row_number() = 1`` is planned as a
group limit on each side of the exchange, so every task sends at most one row per
key and no task sees a whole hot group. Ties are broken by all remaining columns,
so the survivor does not depend on row order or on a lost executor.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tractlake.operators.columns import quoted

RANK = "rn"


def _tie_break(df: DataFrame, used: Sequence[str], descending: bool) -> list[Column]:
    order = []
    for field in df.schema:
        if field.name in used or isinstance(field.dataType, (T.MapType, T.VariantType)):
            continue
        column = F.col(quoted(field.name))
        order.append(column.desc_nulls_last() if descending else column.asc_nulls_first())
    return order


def _keep_first(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    ties: Sequence[Column],
    nearly_unique: bool,
) -> DataFrame:
    columns = [F.col(quoted(k)) for k in keys]
    if nearly_unique and columns:
        df = df.repartition(*columns)
    window = Window.partitionBy(*columns).orderBy(*order, *ties)
    return df.withColumn(RANK, F.row_number().over(window)).filter(F.col(RANK) == 1)


def keep_first(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column] = (),
    descending_ties: bool = True,
    nearly_unique: bool = False,
) -> DataFrame:
    """One row per key, the first by ``order``; null keys form one group.

    The rank stays in the output as ``rn``. With ``nearly_unique`` rows are sorted once,
    after the exchange: right if no key has many rows, as all of a key's rows then meet in
    one task. The result is the same either way.
    """
    return _keep_first(df, keys, order, _tie_break(df, keys, descending_ties), nearly_unique)


def keep_latest(
    df: DataFrame, keys: Sequence[str], time_column: str, nearly_unique: bool = False
) -> DataFrame:
    """One row per key, the newest by ``time_column``, then the greatest row.

    For ``nearly_unique`` see ``keep_first``.
    """
    newest = F.col(quoted(time_column)).desc_nulls_last()
    ties = _tie_break(df, [*keys, time_column], True)
    return _keep_first(df, keys, [newest], ties, nearly_unique)


def first_per_key(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column] = (),
    nearly_unique: bool = False,
) -> DataFrame:
    """One row per key with the columns of ``df``, smallest values on ties."""
    return keep_first(df, keys, order, False, nearly_unique).drop(RANK)


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """Whole-row de-duplication; repeats collapse in each task before the exchange."""
    return df.dropDuplicates()


def distinct_values(df: DataFrame, *columns: str, ordered: bool = False) -> DataFrame:
    found = df.select(*columns).distinct()
    return found.orderBy(*columns) if ordered else found


def concat_tables(*tables: DataFrame) -> DataFrame:
    """Bag union by column name; columns a table lacks are null."""
    result, *others = tables
    for other in others:
        result = result.unionByName(other, allowMissingColumns=True)
    return result
