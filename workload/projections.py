"""Casts, dates, names and other row-by-row operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tractlake.functions.casts import clean_numeric_columns, money, strict_cast
from tractlake.functions.dates import (
    iso_text,
    iso_timestamp,
    lenient_timestamp,
    run_timestamp,
    strict_date,
)
from tractlake.functions.keys import geoid, without_last_char
from tractlake.functions.reliability import with_reliability
from tractlake.functions.text import has_prefix_and_suffix, strip
from tractlake.operators.columns import (
    cast_and_alias,
    cast_by_name,
    drop_columns,
    flatten,
    normalize_names,
    rename,
    snake_case,
    snake_case_no_dollar,
    trimmed_lower,
    with_lineage,
)
from tractlake.operators.reshape import melt_pairs
from workload import landing
from workload.landing import CLOCK
from workload.registry import query, table

def estimate_rows(spark, sf_dir):
    return spark.read.schema(
        "event_id bigint, variable string, tract bigint, estimate string, moe string"
    ).parquet(landing.estimate_text(spark, sf_dir))


def priced_lines(spark, sf_dir):
    return spark.read.schema(
        "l_orderkey bigint, l_linenumber int, l_partkey bigint, trans_date string, "
        "total_amount string, unit_cost string, memo string"
    ).parquet(landing.priced_lines(spark, sf_dir))


def dated_orders(spark, sf_dir):
    return spark.read.schema(
        "o_orderkey bigint, strict_text string, lenient_text string"
    ).parquet(landing.dated_orders(spark, sf_dir))


ESTIMATE_SQL = """
    SELECT event_id, variable, tract, estimate, moe, moe / 1.645 AS standard_error,
           CASE WHEN estimate <> 0 THEN abs((moe / 1.645) / estimate) * 100 END AS cv_pct
    FROM (
        SELECT event_id, event_type AS variable, user_id AS tract,
               TRY_CAST(CASE WHEN event_type = 'error' THEN '-'
                             WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) = 0 THEN '0'
                             ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS estimate,
               value * CAST(json_extract_string(props, '$.k') AS INTEGER) / 100 AS moe
        FROM events
    )
"""
GRADE_SQL = """
    CASE WHEN cv_pct IS NULL THEN 'not applicable'
         WHEN cv_pct <= 12 THEN 'reliable'
         WHEN cv_pct <= 40 THEN 'use with caution'
         ELSE 'not reliable' END
"""


@query(
    "P12 F9 F10 F11 S10",
    f"SELECT *, {GRADE_SQL} AS reliability FROM ({ESTIMATE_SQL})",
)
def cv_reliability(spark, sf_dir):
    return with_reliability(estimate_rows(spark, sf_dir))


@query(
    "P1 P8",
    f"""
    SELECT tract, variable, estimate, moe, standard_error, cv_pct, {GRADE_SQL} AS reliability
    FROM ({ESTIMATE_SQL}) WHERE estimate IS NOT NULL
    """,
)
def fact_rows(spark, sf_dir):
    graded = with_reliability(estimate_rows(spark, sf_dir))
    return graded.filter(F.col("estimate").isNotNull()).select(
        "tract", "variable", "estimate", "moe", "standard_error", "cv_pct", "reliability"
    )


@query(
    "R1 J2",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'PRICE' AS variable,
           l_extendedprice AS estimate, l_discount AS moe FROM lineitem
    UNION ALL
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'QTY',
           l_quantity, l_tax FROM lineitem
    """,
)
def melted_pairs(spark, sf_dir):
    return melt_pairs(
        table(spark, sf_dir, "lineitem"),
        ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"],
        {"PRICE": ("l_extendedprice", "l_discount"), "QTY": ("l_quantity", "l_tax")},
    )


@query(
    "F3",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice AS amount FROM lineitem",
)
def money_text(spark, sf_dir):
    return priced_lines(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", "l_partkey", money("total_amount").alias("amount")
    )


@query(
    "F4",
    """
    SELECT o_orderkey,
           strptime(strftime(o_orderdate, '%m/%d/%Y'), '%m/%d/%Y') AS transaction_date
    FROM orders
    """,
)
def strict_dates(spark, sf_dir):
    return dated_orders(spark, sf_dir).select(
        "o_orderkey", strict_date("strict_text").alias("transaction_date")
    )


@query(
    "F5",
    """
    SELECT o_orderkey,
           try_strptime(CASE o_orderstatus WHEN 'P' THEN 'n/a'
                        ELSE strftime(o_orderdate, '%m/%d/%Y') END, '%m/%d/%Y') AS order_date
    FROM orders
    """,
)
def lenient_dates(spark, sf_dir):
    return dated_orders(spark, sf_dir).select(
        "o_orderkey", lenient_timestamp("lenient_text").alias("order_date")
    )


@query("F6", "SELECT event_id, ts AS seen_at FROM events")
def iso_timestamps(spark, sf_dir):
    shown = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("shown")
    return (
        table(spark, sf_dir, "events")
        .select("event_id", shown)
        .select("event_id", iso_timestamp("shown").alias("seen_at"))
    )


@query(
    "F7 F8",
    """
    SELECT c_custkey,
           lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || CASE c_mktsegment WHEN 'BUILDING' THEN ''
               ELSE '037' END || lpad(CAST(c_custkey AS VARCHAR), 12, '0') AS tract_fips,
           left(c_mktsegment, length(c_mktsegment) - 1) AS variable
    FROM customer
    """,
)
def geoid_codes(spark, sf_dir):
    county = F.when(F.col("c_mktsegment") != "BUILDING", "037")
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        geoid(
            F.lpad(F.col("c_nationkey").cast("string"), 2, "0"),
            county,
            F.lpad(F.col("c_custkey").cast("string"), 12, "0"),
        ).alias("tract_fips"),
        without_last_char("c_mktsegment").alias("variable"),
    )


@query(
    "P2 P4 P5 F2",
    """
    SELECT c_custkey AS account_no, c_name AS vendor, c_acctbal AS total_balance,
           c_nationkey AS district FROM customer
    """,
)
def named_columns(spark, sf_dir):
    raw = table(spark, sf_dir, "customer").toDF(
        "Account-No", "Vendor Name", "DISTRICT", "Total Balance$", "@computed_region_1"
    )
    renamed = rename(
        normalize_names(raw, snake_case_no_dollar), {"vendor_name": "vendor", "absent": "nothing"}
    )
    return drop_columns(renamed, ["not_there"], ["@computed_region_"])


@query(
    "P4",
    "SELECT s_suppkey AS supplier_key, s_name AS full_name, s_acctbal AS balance FROM supplier",
)
def name_rules(spark, sf_dir):
    suppliers = table(spark, sf_dir, "supplier")
    lowered = normalize_names(
        suppliers.toDF("Supplier-Key", " FULL NAME ", "nation", "Balance").drop("nation"),
        trimmed_lower,
    )
    return normalize_names(lowered, snake_case)


@query(
    "P3 P11",
    """
    SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, CAST(l_linenumber AS VARCHAR) AS doc_line,
           l_returnflag AS doc_cd, l_extendedprice AS amount
    FROM lineitem
    """,
)
def cast_projection(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    spec = {"l_orderkey": "doc_id", "l_linenumber": "doc_line", "l_returnflag": "doc_cd"}
    price = F.col("l_extendedprice").cast("string")
    return lines.select(
        *cast_and_alias(lines, spec), strict_cast(price, "double").alias("amount")
    )


@query(
    "P6 P14",
    """
    SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN NULL ELSE c_acctbal END AS latitude,
           CASE c_mktsegment WHEN 'HOUSEHOLD' THEN NULL ELSE c_nationkey END AS council_district
    FROM customer
    """,
)
def nested_fields(spark, sf_dir):
    place = F.struct(F.col("c_acctbal").cast("string").alias("latitude"))
    raw = table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.when(F.col("c_mktsegment") != "BUILDING", place).alias("location_1"),
        F.when(F.col("c_mktsegment") == "HOUSEHOLD", "x")
        .otherwise(F.col("c_nationkey").cast("string"))
        .alias("council_district"),
    )
    return raw.select(
        "c_custkey",
        F.col("location_1.latitude").try_cast("double").alias("latitude"),
        F.col("council_district").try_cast("int").alias("council_district"),
    )


@query(
    "S9 R3",
    """
    SELECT o_orderkey AS id, o_totalprice AS price_total, o_orderstatus AS price_state_code,
           o_orderpriority AS price_state_rank
    FROM orders
    """,
)
def flattened(spark, sf_dir):
    nested = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.struct(
            F.col("o_totalprice").alias("total"),
            F.struct(
                F.col("o_orderstatus").alias("code"), F.col("o_orderpriority").alias("rank")
            ).alias("state"),
        ).alias("price"),
    )
    return flatten(nested, separator="_")


@query(
    "P7 F13",
    """
    SELECT c_custkey, c_name, DATE '2024-01-31' AS ingestion_date, 'Registry' AS data_source,
           'business' AS data_domain, '2024-01-31T12:30:00+00:00' AS processed_at,
           TIMESTAMP '2024-01-31 12:30:00' AS ingest_timestamp, 2024 AS year
    FROM customer
    """,
)
def lineage_columns(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return with_lineage(rows, "Registry", "business", CLOCK).withColumns(
        {
            "processed_at": iso_text(CLOCK),
            "ingest_timestamp": run_timestamp(CLOCK),
            "year": F.lit(2024),
        }
    )


@query(
    "P15",
    """
    SELECT l_orderkey, l_shipdate AS trans_date, l_extendedprice AS total_amount,
           CASE WHEN l_returnflag <> 'R' THEN l_quantity END AS unit_cost, l_returnflag AS memo
    FROM lineitem
    """,
)
def typed_by_name(spark, sf_dir):
    return cast_by_name(priced_lines(spark, sf_dir).drop("l_linenumber", "l_partkey"))


@query(
    "P13",
    """
    SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS tent_count, c_acctbal AS mean_count,
           CASE c_mktsegment WHEN 'BUILDING' THEN '12A'
                ELSE CAST(c_nationkey AS VARCHAR) END AS site_number
    FROM customer
    """,
)
def numeric_by_suffix(spark, sf_dir):
    nation = F.col("c_nationkey").cast("string")
    raw = table(spark, sf_dir, "customer").select(
        "c_custkey",
        nation.alias("tent_count"),
        F.col("c_acctbal").cast("string").alias("mean_count"),
        F.when(F.col("c_mktsegment") == "BUILDING", "12A").otherwise(nation).alias("site_number"),
    )
    return clean_numeric_columns(raw)


@query("F1", "SELECT p_partkey, p_name AS spaces, p_brand AS white_space FROM part")
def trimmed_text(spark, sf_dir):
    raw = table(spark, sf_dir, "part").select(
        "p_partkey",
        F.concat(F.lit("  "), "p_name", F.lit(" ")).alias("spaces"),
        F.concat(F.lit("\t "), "p_brand", F.lit("\r\n")).alias("white_space"),
    )
    return raw.withColumns({"spaces": F.trim("spaces"), "white_space": strip("white_space")})


@query(
    "P10",
    """
    SELECT p_partkey, p_name, starts_with(p_name, 'red') AND ends_with(p_name, 't') AS by_text,
           starts_with(p_name, lower(left(p_type, 1))) AND ends_with(p_name, 't') AS by_column
    FROM part
    """,
)
def prefix_and_suffix(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        "p_name",
        has_prefix_and_suffix("p_name", "red", "t").alias("by_text"),
        has_prefix_and_suffix("p_name", F.lower(F.left("p_type", F.lit(1))), "t").alias(
            "by_column"
        ),
    )
