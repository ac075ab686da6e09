"""Readers of landed files."""

from __future__ import annotations

from pyspark.sql import functions as F

from tractlake.operators.quality import layer_counts
from tractlake.operators.reshape import melt_payloads, melt_records
from tractlake.schemas import PIT_SPEC, schema_from_spec
from tractlake.sources.census import payload_records, read_payloads, read_variable_labels
from tractlake.sources.files import (
    read_delimited,
    read_json_lines,
    read_json_pages,
    read_json_records,
    read_table_config,
)
from tractlake.sources.snapshots import find_latest_snapshot, read_latest_json
from tractlake.workspace import fresh_dir
from workload import landing
from workload.registry import query, table

ORDER_RECORD = schema_from_spec(
    [{"name": n, "type": "string"} for n in ("doc_id", "state", "amount", "priority")]
)
ORDER_RECORD_SQL = """
    SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, o_orderstatus AS state,
           CAST(o_totalprice AS DOUBLE) AS amount,
           CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS priority
    FROM orders
"""


@query("S1", "SELECT 'B' || CAST(p_partkey AS VARCHAR) AS table_id, p_brand AS series FROM part")
def config_scan(spark, sf_dir):
    return read_table_config(spark, landing.table_config(spark, sf_dir))


@query(
    "S2 R2 F15",
    """
    SELECT c_name AS name, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS estimate,
           CAST(c_custkey AS VARCHAR) AS second_estimate,
           lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS tract, CAST(12 AS INTEGER) AS width
    FROM customer
    """,
)
def header_row_records(spark, sf_dir):
    records = payload_records(
        read_payloads(spark, landing.survey_payloads(spark, sf_dir), whole_files=False)
    )
    return records.select(
        F.col("record")["NAME"].alias("name"),
        F.col("record")["B01_001E"].try_cast("double").alias("estimate"),
        F.col("record")["B01_002E"].alias("second_estimate"),
        F.col("record")["tract"].alias("tract"),
        F.size("record").alias("width"),
    )


_TRACT_SQL = """
    lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || '037' || lpad(CAST(c_custkey AS VARCHAR), 9, '0')
    AS tract_fips, c_name AS tract_name
"""
_MELTED_SQL = f"""
    SELECT 'B01' AS table_id, 'B01_001' AS variable, {_TRACT_SQL},
           CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS estimate,
           CAST(c_nationkey AS DOUBLE) AS moe FROM customer
    UNION ALL SELECT 'B01', 'B01_002', {_TRACT_SQL}, CAST(c_custkey AS DOUBLE), NULL FROM customer
    UNION ALL SELECT 'B02', 'B02_001', {_TRACT_SQL},
        CASE WHEN c_mktsegment <> 'BUILDING' THEN CAST(c_nationkey AS DOUBLE) END, 2.5 FROM customer
    UNION ALL SELECT 'C01', 'C01_001', {_TRACT_SQL}, c_acctbal, 164.5 FROM customer
    UNION ALL SELECT 'B99', 'B99_001', {_TRACT_SQL}, 1, NULL FROM customer
"""


def _numbers(melted):
    return melted.select(
        "table_id",
        "variable",
        "tract_fips",
        "tract_name",
        F.col("estimate").try_cast("double").alias("estimate"),
        F.col("moe").try_cast("double").alias("moe"),
    )


@query("R1 J2 F7 F8 P10 S2", _MELTED_SQL)
def melted_payloads(spark, sf_dir):
    path = landing.survey_payloads(spark, sf_dir)
    return _numbers(melt_payloads(read_payloads(spark, path, whole_files=False)))


@query("R1 J2 R2", _MELTED_SQL)
def melted_records(spark, sf_dir):
    path = landing.survey_payloads(spark, sf_dir)
    records = payload_records(read_payloads(spark, path, whole_files=False))
    return _numbers(melt_records(records))


@query(
    "S3 F8 P10",
    """
    SELECT 'P' || CAST(p_partkey AS VARCHAR) AS table_id,
           'P' || CAST(p_partkey AS VARCHAR) || '_001' AS variable,
           CASE p_type WHEN 'SMALL' THEN '' ELSE 'Estimate!!' || p_name END AS variable_label
    FROM part
    UNION ALL
    SELECT left(code, 3), left(code, 7), 'Label of ' || code
    FROM (VALUES ('B01_001E'), ('B01_002E'), ('B02_001E'), ('C01_001E')) AS t(code)
    """,
)
def variable_list(spark, sf_dir):
    return read_variable_labels(
        spark, landing.survey_variables(spark, sf_dir), whole_files=False
    )


def _amounts(df):
    return df.select("doc_id", "state", F.col("amount").cast("double").alias("amount"), "priority")


@query("S4 S5 U1 F15", ORDER_RECORD_SQL)
def json_pages(spark, sf_dir):
    path = landing.order_pages(spark, sf_dir)
    return _amounts(read_json_pages(spark, path, ORDER_RECORD, whole_files=False))


@query("S6 S8", ORDER_RECORD_SQL)
def json_arrays(spark, sf_dir):
    path = landing.order_page_files(spark, sf_dir)
    return _amounts(read_json_records(spark, path, ORDER_RECORD))


@query("S7 S8", ORDER_RECORD_SQL)
def json_inferred(spark, sf_dir):
    return _amounts(read_json_lines(spark, landing.order_pages(spark, sf_dir)))


@query(
    "S11 S12 S17",
    """
    SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority AS spa,
           o_orderstatus AS population_type,
           CASE WHEN o_orderstatus <> 'P' THEN CAST(floor(o_totalprice) AS INTEGER) END AS count
    FROM orders
    """,
)
def typed_csv(spark, sf_dir):
    return read_delimited(spark, landing.pit_csv(spark, sf_dir), schema_from_spec(PIT_SPEC))


@query("S16 O3 K6", "SELECT o_orderkey, o_totalprice FROM orders")
def newest_snapshot(spark, sf_dir):
    schema = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").schema
    return read_latest_json(spark, landing.order_snapshots(spark, sf_dir), schema)


@query(
    "A1 S16",
    """
    SELECT 'bronze' AS layer, count(*) AS records FROM orders
    UNION ALL SELECT 'silver', count(*) FROM lineitem
    UNION ALL SELECT 'gold', CAST(0 AS BIGINT)
    """,
)
def counts_per_layer(spark, sf_dir):
    bronze = landing.order_snapshots(spark, sf_dir)
    silver = landing.line_snapshots(spark, sf_dir)
    return layer_counts(
        spark,
        {
            "bronze": (bronze, "*.json", "jsonl"),
            "silver": (silver, "*.parquet", "parquet"),
            "gold": (fresh_dir(spark, "gold"), "*.parquet", "parquet"),
        },
    )


@query("S16 A1", "SELECT count(*) AS records, true AS is_newest FROM orders")
def snapshot_listing(spark, sf_dir):
    path = find_latest_snapshot(spark, landing.order_snapshots(spark, sf_dir))
    return spark.read.text(path).agg(
        F.count("*").alias("records"), F.lit("20240102" in path).alias("is_newest")
    )
