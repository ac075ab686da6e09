"""Names, projections and constant columns. All of it is plain projection."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tractlake.functions.casts import money, strict_cast
from tractlake.functions.dates import lenient_timestamp, run_date


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def trimmed_lower(name: str) -> str:
    return name.lower().strip()


def snake_case(name: str) -> str:
    return name.lower().replace(" ", "_").replace("-", "_")


def snake_case_no_dollar(name: str) -> str:
    return snake_case(name).replace("$", "")


def normalize_names(df: DataFrame, rule: Callable[[str], str] = snake_case) -> DataFrame:
    """Rename every column by ``rule``; two columns may not end up with one name."""
    names = [rule(name) for name in df.columns]
    repeated = sorted({name for name in names if names.count(name) > 1})
    if repeated:
        raise ValueError(f"columns collide after renaming: {', '.join(repeated)}")
    return df.toDF(*names)


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename by map; names that are absent are ignored."""
    return df.withColumnsRenamed(dict(names))


def cast_and_alias(
    df: DataFrame, spec: Mapping[str, str], type_name: str = "string"
) -> list[Column]:
    """Projection items ``source -> alias``, each strictly cast to one type."""
    return [
        strict_cast(F.col(quoted(source)), type_name, source).alias(alias)
        for source, alias in spec.items()
    ]


def drop_columns(
    df: DataFrame, names: Iterable[str] = (), prefixes: Iterable[str] = ()
) -> DataFrame:
    """Drop by name or by name prefix; absent ones are ignored."""
    starts = tuple(prefixes)
    doomed = set(names) | {c for c in df.columns if starts and c.startswith(starts)}
    return df.select(*[F.col(quoted(c)) for c in df.columns if c not in doomed])


def flatten(df: DataFrame, separator: str = ".") -> DataFrame:
    """One column per leaf of nested structs, named by its path; arrays stay whole."""

    def leaves(schema: T.StructType, path: tuple[str, ...]) -> Iterable[Column]:
        for field in schema.fields:
            here = (*path, field.name)
            if isinstance(field.dataType, T.StructType):
                yield from leaves(field.dataType, here)
            else:
                yield F.col(".".join(quoted(p) for p in here)).alias(separator.join(here))

    return df.select(*leaves(df.schema, ()))


def with_lineage(
    df: DataFrame, source: str, domain: str, now: datetime | None = None
) -> DataFrame:
    """Add ingestion_date, data_source and data_domain."""
    return df.withColumns(
        {
            "ingestion_date": run_date(now),
            "data_source": F.lit(source),
            "data_domain": F.lit(domain),
        }
    )


def cast_by_name(
    df: DataFrame,
    date_words: Iterable[str] = ("date",),
    money_words: Iterable[str] = ("amount", "cost"),
) -> DataFrame:
    """Columns with a date word become timestamps, those with a money word doubles.

    Dates are lenient (bad text is null), money is strict (bad text ends the run).
    """
    dates, amounts = tuple(date_words), tuple(money_words)

    def typed(name: str) -> Column:
        column = F.col(quoted(name))
        if any(word in name for word in dates):
            return lenient_timestamp(column.cast("string")).alias(name)
        if any(word in name for word in amounts):
            return money(column, name).alias(name)
        return column

    return df.select(*[typed(name) for name in df.columns])
