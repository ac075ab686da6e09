"""Survey API payloads: header-row tables and the list of variables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tractlake.functions.keys import is_estimate_code, table_of, without_last_char
from tractlake.operators.dedup import first_per_key

PAYLOAD_TYPE = "array<array<string>>"
VARIABLES_TYPE = "struct<variables:map<string,struct<label:string>>>"


def read_payloads(spark: SparkSession, path: str | list[str], whole_files: bool = True) -> DataFrame:
    """Landed responses ``[[header], [row], ...]``: the text and its ``payload``.

    ``whole_files`` reads one response per file. Large loads should be landed as
    one response per line, so that files split and tasks stay even. Text that is
    no such payload gives a null, see ``rejected_payloads``.
    """
    text = spark.read.text(path, wholetext=whole_files)
    return text.withColumn("payload", F.from_json("value", PAYLOAD_TYPE))


def rejected_payloads(payloads: DataFrame) -> DataFrame:
    """Responses without a header, as text."""
    return payloads.filter(F.coalesce(F.size("payload"), F.lit(0)) < 1).select("value")


def header_of(payload: str = "payload") -> Column:
    return F.try_element_at(payload, F.lit(1))


def split_payloads(payloads: DataFrame, **of_header: Column) -> DataFrame:
    """One row per data row: ``row``, ``width`` and the ``of_header`` columns.

    ``of_header`` is worked out once per payload. ``width`` is the number of columns
    a row must have, null under a header that repeats a name.

    The shape of this plan is on purpose. All that needs the payload is projected
    before the explode, so that the rows do not carry the payload along. And the
    explode is an outer one: for an inner one Spark adds a not-empty filter, which
    it pushes below the parsing of the text, and so parses the text again.
    """
    header = header_of()
    unique = F.size(F.array_distinct(header)) == F.size(header)
    split = payloads.select(
        F.when(unique, F.size(header)).alias("width"),
        F.slice("payload", F.lit(2), F.size("payload")).alias("rows"),
        *[column.alias(name) for name, column in of_header.items()],
    )
    return split.select("width", *of_header, F.explode_outer("rows").alias("row"))


def fits_header() -> Column:
    """A row of ``split_payloads`` has the width of its header; never null.

    The coalesce also keeps Spark from deriving a filter on ``width`` alone.
    """
    return F.coalesce(F.size("row") == F.col("width"), F.lit(False))


def payload_records(payloads: DataFrame) -> DataFrame:
    """Each data row zipped with its header to a name -> value map."""
    rows = split_payloads(payloads, header=header_of()).filter(fits_header())
    return rows.select(F.map_from_arrays("header", "row").alias("record"))


def rejected_rows(payloads: DataFrame) -> DataFrame:
    """The rows ``payload_records`` leaves out, whole, for a reject table."""
    rows = split_payloads(payloads, header=header_of())
    return rows.filter(F.col("row").isNotNull() & ~fits_header()).select("header", "row")


def rejects(payloads: DataFrame) -> DataFrame:
    """(reason, content): what the melt leaves out, whole, as text; one scan, one parse.

    A response without a header comes out of the explode as one row without values. The reason
    is found after it from both, so that no filter goes below the parsing.
    """
    unread = F.coalesce(F.size("payload"), F.lit(0)) < 1
    rows = split_payloads(
        payloads, header=header_of(), unread=unread, text=F.when(unread, F.col("value"))
    )
    ragged = F.col("row").isNotNull() & ~fits_header()
    reason = F.when(ragged, "row does not fit its header").when(
        F.col("unread"), "response without a header"
    )
    content = F.when(ragged, F.to_json(F.struct("header", "row"))).otherwise(F.col("text"))
    return rows.select(reason.alias("reason"), content.alias("content")).filter("reason IS NOT NULL")


def variable_labels(metadata: DataFrame, text: str = "value") -> DataFrame:
    """``{"variables": {code: {label}}}`` to table, variable root and label.

    Only estimate codes count. A variable without a label gets empty text.
    """
    parsed = F.from_json(text, VARIABLES_TYPE)["variables"]
    return (
        metadata.select(F.explode_outer(parsed).alias("code", "info"))
        .filter(is_estimate_code("code"))
        .select(
            table_of("code").alias("table_id"),
            without_last_char("code").alias("variable"),
            F.coalesce(F.col("info.label"), F.lit("")).alias("variable_label"),
        )
    )


def read_variable_labels(
    spark: SparkSession, path: str | list[str], whole_files: bool = True
) -> DataFrame:
    """One row per variable: listed twice, the smallest table and label count."""
    listed = variable_labels(spark.read.text(path, wholetext=whole_files))
    return first_per_key(listed, ["variable"]).select("table_id", "variable", "variable_label")
