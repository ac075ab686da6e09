"""Wide survey rows to long rows with paired measures."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tractlake.functions.keys import (
    geoid,
    is_estimate_code,
    margin_code,
    table_of,
    without_last_char,
)
from tractlake.operators.columns import quoted
from tractlake.sources.census import fits_header, header_of, split_payloads

# The geography columns of a survey response.
NAME_COLUMN = "NAME"
GEOGRAPHY_COLUMNS = ("state", "county", "tract")


def melt_pairs(
    df: DataFrame,
    ids: Sequence[str],
    pairs: Mapping[str, tuple[str, str]],
    variable: str = "variable",
    estimate: str = "estimate",
    moe: str = "moe",
) -> DataFrame:
    """``{name: (estimate column, margin column)}`` to one row per id and name.

    One ``stack``: the input is read once and nothing is shuffled.
    """
    stacked = ", ".join(
        f"'{name}', cast({quoted(e)} as double), cast({quoted(m)} as double)"
        for name, (e, m) in pairs.items()
    )
    return df.select(
        *ids, F.expr(f"stack({len(pairs)}, {stacked}) as ({variable}, {estimate}, {moe})")
    )


def _from_record(name: str) -> Column:
    return F.try_element_at("record", F.lit(name))


def melt_records(records: DataFrame) -> DataFrame:
    """Name -> value maps to (tract, variable) rows with estimate and margin.

    A margin that is not in the record is null. The pairs are built inside the
    map's row and only they are exploded, so the map is not copied per variable.
    """
    pairs = F.transform(
        F.filter(F.map_keys("record"), is_estimate_code),
        lambda code: F.struct(
            table_of(code).alias("table_id"),
            without_last_char(code).alias("variable"),
            F.try_element_at("record", code).alias("estimate"),
            F.try_element_at("record", margin_code(without_last_char(code))).alias("moe"),
        ),
    )
    name = F.when(
        F.map_contains_key("record", NAME_COLUMN), _from_record(NAME_COLUMN)
    ).otherwise("")
    return records.select(
        geoid(*[_from_record(part) for part in GEOGRAPHY_COLUMNS]).alias("tract_fips"),
        name.alias("tract_name"),
        F.inline(pairs),
    )


def _place(header: Column, name: Column) -> Column:
    """Zero-based place in the header, -1 if it is not there."""
    return (F.array_position(header, name) - 1).cast("int")


def melt_payloads(payloads: DataFrame) -> DataFrame:
    """``melt_records`` straight from header-row payloads.

    Where each variable and its margin stand is worked out once per payload, from
    the header. A row then reads its values by position, so its cost grows with
    the number of variables and not with its square.
    """
    header = header_of()
    positions = F.filter(
        F.transform(
            header,
            lambda code, at: F.named_struct(
                F.lit("code"),
                code,
                F.lit("estimate_at"),
                at,
                F.lit("moe_at"),
                _place(header, margin_code(without_last_char(code))),
            ),
        ),
        lambda pair: is_estimate_code(pair["code"]),
    )
    places = {
        f"{name}_at": _place(header, F.lit(name)) for name in (NAME_COLUMN, *GEOGRAPHY_COLUMNS)
    }
    rows = split_payloads(payloads, pairs=positions, **places).filter(fits_header())
    name = F.when(F.col(f"{NAME_COLUMN}_at") >= 0, F.get("row", f"{NAME_COLUMN}_at")).otherwise("")
    values = F.transform(
        "pairs",
        lambda pair: F.named_struct(
            F.lit("code"),
            pair["code"],
            F.lit("estimate"),
            F.get("row", pair["estimate_at"]),
            F.lit("moe"),
            F.get("row", pair["moe_at"]),
        ),
    )
    melted = rows.select(
        geoid(*[F.get("row", f"{part}_at") for part in GEOGRAPHY_COLUMNS]).alias("tract_fips"),
        name.alias("tract_name"),
        F.inline(values),
    )
    return melted.select(
        "tract_fips",
        "tract_name",
        table_of("code").alias("table_id"),
        without_last_char("code").alias("variable"),
        "estimate",
        "moe",
    )
