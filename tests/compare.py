"""Compare a Spark result with its SQL twin: columns, types, rows and values."""

from __future__ import annotations

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

SQL_TYPE = {
    "string": "VARCHAR",
    "int": "INTEGER",
    "bigint": "BIGINT",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
    "date": "DATE",
    "timestamp": "TIMESTAMP",
    "timestamp_ntz": "TIMESTAMP",
}


def connect(sf_dir: str):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')"
        )
    return connection


def _sortable(row):
    return tuple((value is None, str(type(value)), repr(value)) for value in row)


def differences(df, connection, sql: str) -> list[str]:
    """What differs; an empty list when the two agree exactly."""
    names = sorted(df.columns)
    types = {f.name: SQL_TYPE.get(f.dataType.simpleString()) for f in df.schema}
    described = {row[0]: row[1] for row in connection.execute(f"DESCRIBE {sql}").fetchall()}
    problems = []
    if sorted(described) != names:
        return [f"columns: {names} against {sorted(described)}"]
    for name in names:
        if types[name] != described[name]:
            problems.append(f"type of {name}: {types[name]} against {described[name]}")
    columns = ", ".join(f'"{name}"' for name in names)
    wanted = connection.execute(f"SELECT {columns} FROM ({sql})").fetchall()
    got = [tuple(row[name] for name in names) for row in df.collect()]
    if len(wanted) != len(got):
        problems.append(f"rows: {len(got)} against {len(wanted)}")
    else:
        pairs = zip(sorted(got, key=_sortable), sorted(wanted, key=_sortable), strict=True)
        unequal = [(a, b) for a, b in pairs if _sortable(a) != _sortable(b)]
        if unequal:
            problems.append(f"{len(unequal)} rows differ, first {unequal[0]}")
    return problems
