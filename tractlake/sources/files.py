"""Delimited text, JSON, columnar files and catalog tables.

Every reader takes a schema where one is known: inference is a second pass over
the data. A JSON file read whole is one task, so large feeds should be landed as
many pages or as one record or page per line, which Spark can split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tractlake.functions.text import strip
from tractlake.operators.columns import quoted
from tractlake.schemas import DATASETS, TABLE_CONFIG
from tractlake.sinks.commits import read_committed


def read_delimited(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    separator: str = ",",
    header: bool = True,
) -> DataFrame:
    """Typed rows of the file; a bad number becomes null.

    With a header, columns are found by name: their order is free, others are left
    out, and a missing one is an error. Without one they are found by place.
    """
    reader = spark.read.option("sep", separator).option("mode", "PERMISSIVE")
    if not header:
        return reader.schema(schema).csv(path)
    # Only the first line is read for the names; files with other headers are refused.
    rows = reader.option("header", True).option("enforceSchema", False).csv(path)
    present = {name.strip().lower(): name for name in rows.columns}
    missing = [name for name in schema.fieldNames() if name.lower() not in present]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    return rows.select(
        *[
            F.col(quoted(present[f.name.lower()])).try_cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def read_table_config(spark: SparkSession, path: str) -> DataFrame:
    """The list of survey tables: tab-separated in spite of a ``.csv`` name."""
    rows = read_delimited(spark, path, TABLE_CONFIG, separator="\t")
    return rows.withColumn("table_id", strip("table_id"))


def read_json_records(
    spark: SparkSession, path: str | list[str], schema: T.StructType | None = None
) -> DataFrame:
    """Whole-file JSON arrays of records, nested objects kept as structs.

    Without a schema the columns are the union of the keys of all records.
    """
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def read_json_lines(
    spark: SparkSession, path: str | list[str], schema: T.StructType | None = None
) -> DataFrame:
    """One record, or one array of records, per line; files split across tasks."""
    reader = spark.read
    return (reader.schema(schema) if schema is not None else reader).json(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Records of a JSON file or folder, whichever way they are written.

    If the first line that isn't blank is JSON by itself, every line is: a record, or an array of records.
    Else each file is one array or record over many lines. One line is looked at, in a task.
    """
    lines = spark.read.text(path).filter(F.trim("value") != "")
    first = lines.select(F.get_json_object("value", "$").isNotNull().alias("whole")).first()
    by_line = first is None or first.whole
    return (read_json_lines if by_line else read_json_records)(spark, path, schema)


def read_json_pages(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType,
    whole_files: bool = True,
    text: str | None = None,
) -> DataFrame:
    """Union of landed pages, each a JSON list; an empty page adds no rows.

    A page that is not a list ends the run, in the same pass that reads it: an
    object payload is an error message of the source, not data. ``whole_files``
    reads one page per file, else one page per line. ``text`` names a column for
    the record as it was written.
    """
    pages = spark.read.text(path, wholetext=whole_files)
    if not whole_files:
        pages = pages.filter(F.trim("value") != "")
    is_list = F.startswith(strip("value"), F.lit("["))
    kind = T.ArrayType(T.StringType() if text else schema)
    parsed = F.from_json("value", kind, {"mode": "FAILFAST"})
    checked = F.when(is_list, parsed).otherwise(
        F.raise_error(
            F.concat(F.lit("expected a JSON list, got: "), F.substring(F.col("value"), 1, 80))
        ).cast(kind)
    )
    # An inner explode would get a not-empty filter, and the page a second parse.
    records = pages.select(F.explode_outer(checked).alias("record"))
    records = records.filter(F.col("record").isNotNull())
    if not text:
        return records.select("record.*")
    typed = records.select(
        F.from_json("record", schema, {"mode": "FAILFAST"}).alias("typed"), "record"
    )
    return typed.select("typed.*", F.col("record").alias(text))


def read_path(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    schema: T.StructType | None = None,
) -> DataFrame:
    """A table directory; ``fmt`` is any format the session has a source for.

    Of a folder with committed versions, the rows that stand.
    """
    return read_committed(spark, path, fmt, schema)


def read_table(
    spark: SparkSession, table: str, columns: Sequence[str] | None = None
) -> DataFrame:
    """A catalog table; with ``columns`` only these are scanned."""
    df = spark.table(table)
    return df.select(*columns) if columns else df


def read_dataset(
    spark: SparkSession, root: str, name: str, fmt: str = "parquet"
) -> DataFrame:
    """A registered table, with its registered schema."""
    dataset = DATASETS[name]
    return read_path(spark, dataset.location(root), fmt, dataset.schema).select(
        *dataset.schema.fieldNames()
    )
