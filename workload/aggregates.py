"""Grouped aggregates, windows over them, and de-duplication."""

from __future__ import annotations

from pyspark.sql import functions as F

from tractlake.functions.reliability import GRADES, with_reliability
from tractlake.functions.text import joined_or
from tractlake.operators.aggregates import category_counts, metric_table, sum_numeric_by
from tractlake.operators.dedup import (
    concat_tables,
    distinct_values,
    drop_duplicate_rows,
    first_per_key,
    keep_latest,
)
from tractlake.operators.windows import ratio, with_change
from tractlake.plans.acs import estimate_metrics
from tractlake.plans.business import district_summary
from workload.projections import ESTIMATE_SQL, GRADE_SQL, estimate_rows
from workload.registry import query, table


@query(
    "A2 Q9",
    f"""
    SELECT c.reliability, CAST(count(g.reliability) AS BIGINT) AS row_count
    FROM (VALUES ('reliable'), ('use with caution'), ('not reliable'), ('not applicable'))
         AS c(reliability)
    LEFT JOIN (SELECT {GRADE_SQL} AS reliability FROM ({ESTIMATE_SQL})) g USING (reliability)
    GROUP BY c.reliability
    """,
)
def reliability_counts(spark, sf_dir):
    graded = with_reliability(estimate_rows(spark, sf_dir))
    return category_counts(graded, "reliability", GRADES)


@query(
    "Q9 P8 A2",
    f"""
    SELECT count(*) AS row_count,
           count(*) FILTER (WHERE estimate IS NULL) AS dropped_unparseable,
           count(*) FILTER (WHERE reliability = 'reliable') AS reliable_count,
           count(*) FILTER (WHERE reliability = 'use with caution') AS use_with_caution_count,
           count(*) FILTER (WHERE reliability = 'not reliable') AS not_reliable_count,
           count(*) FILTER (WHERE reliability = 'not applicable') AS not_applicable_count
    FROM (SELECT *, {GRADE_SQL} AS reliability FROM ({ESTIMATE_SQL}))
    """,
)
def run_metrics(spark, sf_dir):
    return estimate_metrics(with_reliability(estimate_rows(spark, sf_dir)))


@query(
    "A3 O1",
    """
    SELECT c_nationkey AS council_district, count(*) AS business_count,
           count(DISTINCT c_mktsegment) AS unique_categories,
           round(avg(c_acctbal), 4) AS avg_latitude, round(avg(c_custkey), 4) AS avg_longitude
    FROM customer GROUP BY c_nationkey ORDER BY c_nationkey
    """,
)
def district_totals(spark, sf_dir):
    summary = district_summary(
        table(spark, sf_dir, "customer"), "c_nationkey", "c_mktsegment", "c_acctbal", "c_custkey"
    )
    return summary.withColumns(
        {c: F.round(c, 4) for c in ("avg_latitude", "avg_longitude")}
    )


@query(
    "A4",
    """
    SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority AS spa,
           CAST(sum(CAST(floor(o_totalprice) AS INTEGER)) AS BIGINT) AS total_count
    FROM orders GROUP BY ALL
    """,
)
def sum_by_two_keys(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").select(
        F.year("o_orderdate").alias("year"),
        F.col("o_orderpriority").alias("spa"),
        F.floor("o_totalprice").cast("int").alias("count"),
    )
    return counts.groupBy("year", "spa").agg(F.sum("count").alias("total_count"))


@query(
    "A6",
    """
    SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS volume_l_quantity,
           max(l_extendedprice) AS volume_l_extendedprice,
           count(DISTINCT l_suppkey) AS volume_l_suppkey
    FROM lineitem GROUP BY ALL
    """,
)
def declared_metric(spark, sf_dir):
    spec = {
        "group_by": ["l_returnflag", "l_linestatus"],
        "aggregation": {
            "l_quantity": "sum",
            "l_extendedprice": "max",
            "l_suppkey": "count_distinct",
        },
    }
    metric = metric_table(table(spark, sf_dir, "lineitem"), "volume", spec)
    return metric.withColumn("volume_l_quantity", F.round("volume_l_quantity", 2))


@query(
    "A5",
    """
    SELECT CAST(year(l_shipdate) AS INTEGER) AS year,
           CAST(sum(l_orderkey) AS BIGINT) AS l_orderkey,
           CAST(sum(l_linenumber) AS BIGINT) AS l_linenumber,
           round(sum(l_quantity), 2) AS l_quantity, round(sum(l_tax), 2) AS l_tax,
           CAST(0 AS BIGINT) AS never_set
    FROM lineitem GROUP BY 1
    """,
)
def numeric_sums(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        F.year("l_shipdate").alias("year"),
        "l_orderkey",
        "l_linenumber",
        "l_quantity",
        "l_tax",
        "l_returnflag",
        F.lit(None).cast("int").alias("never_set"),
    )
    return sum_numeric_by(lines, ["year"]).withColumns(
        {c: F.round(c, 2) for c in ("l_quantity", "l_tax")}
    )


@query(
    "A5 F12 W2",
    """
    SELECT year, round(unsheltered, 2) AS unsheltered, round(total_homeless, 2) AS total_homeless,
           round(unsheltered / total_homeless, 6) AS pct_unsheltered,
           round(total_homeless / lag(total_homeless) OVER (ORDER BY year) - 1, 6)
               AS pct_change_total
    FROM (
        SELECT CAST(year(o_orderdate) AS INTEGER) AS year, sum(o_totalprice) AS total_homeless,
               sum(CASE o_orderstatus WHEN 'F' THEN o_totalprice ELSE 0 END) AS unsheltered
        FROM orders GROUP BY 1
    )
    """,
)
def yearly_change(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").select(
        F.year("o_orderdate").alias("year"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))
        .otherwise(0.0)
        .alias("unsheltered"),
        F.col("o_totalprice").alias("total_homeless"),
    )
    yearly = sum_numeric_by(counts, ["year"]).withColumn(
        "pct_unsheltered", ratio("unsheltered", "total_homeless")
    )
    changed = with_change(yearly, "total_homeless", "year", "pct_change_total")
    return changed.select(
        "year",
        F.round("unsheltered", 2).alias("unsheltered"),
        F.round("total_homeless", 2).alias("total_homeless"),
        F.round("pct_unsheltered", 6).alias("pct_unsheltered"),
        F.round("pct_change_total", 6).alias("pct_change_total"),
    )


@query(
    "F14",
    """
    SELECT c_nationkey,
           coalesce(nullif(string_agg(DISTINCT CASE WHEN c_nationkey % 4 > 0 THEN c_mktsegment END,
               ', ' ORDER BY CASE WHEN c_nationkey % 4 > 0 THEN c_mktsegment END), ''), 'none')
               AS segments
    FROM customer GROUP BY c_nationkey
    """,
)
def text_lists(spark, sf_dir):
    named = F.when(F.col("c_nationkey") % 4 > 0, F.col("c_mktsegment"))
    return (
        table(spark, sf_dir, "customer")
        .groupBy("c_nationkey")
        .agg(joined_or(F.collect_set(named)).alias("segments"))
    )


@query(
    "W1 O4",
    """
    SELECT * EXCLUDE (rn), CAST(rn AS INTEGER) AS rn FROM (
        SELECT *, row_number() OVER (
            PARTITION BY l_orderkey, l_linenumber
            ORDER BY l_shipdate DESC NULLS LAST, l_partkey DESC NULLS LAST,
                     l_suppkey DESC NULLS LAST, l_quantity DESC NULLS LAST,
                     l_extendedprice DESC NULLS LAST, l_discount DESC NULLS LAST,
                     l_tax DESC NULLS LAST, l_returnflag DESC NULLS LAST,
                     l_linestatus DESC NULLS LAST) AS rn
        FROM lineitem
    ) WHERE rn = 1
    """,
)
def newest_per_key(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return keep_latest(lines, ["l_orderkey", "l_linenumber"], "l_shipdate", nearly_unique=True)


@query(
    "U4",
    """
    SELECT user_id, event_type, event_id, ts, value, props FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
        FROM events
    ) WHERE rn = 1
    """,
)
def first_event_per_user(spark, sf_dir):
    return first_per_key(
        table(spark, sf_dir, "events"), ["user_id"], [F.col("ts").asc(), F.col("event_id").asc()]
    )


@query(
    "U5",
    """
    SELECT l_suppkey, l_returnflag, l_linestatus, l_linenumber, l_orderkey, l_partkey FROM (
        SELECT *, row_number() OVER (
            PARTITION BY l_suppkey, l_returnflag, l_linestatus, l_linenumber
            ORDER BY l_orderkey, l_partkey) AS rn
        FROM lineitem
    ) WHERE rn = 1
    """,
)
def unique_by_four_columns(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_linenumber"
    )
    return first_per_key(lines, ["l_suppkey", "l_returnflag", "l_linestatus", "l_linenumber"])


@query(
    "U3",
    "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber, l_suppkey FROM lineitem",
)
def whole_row_distinct(spark, sf_dir):
    return drop_duplicate_rows(
        table(spark, sf_dir, "lineitem").select(
            "l_returnflag", "l_linestatus", "l_linenumber", "l_suppkey"
        )
    )


@query(
    "U6 A8 O2 Q4",
    "SELECT DISTINCT c_nationkey, c_mktsegment FROM customer ORDER BY ALL",
)
def sorted_distinct(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    return distinct_values(customers, "c_nationkey", "c_mktsegment", ordered=True)


@query(
    "U1",
    """
    SELECT c_custkey AS key, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment
    FROM customer
    UNION ALL
    SELECT s_suppkey, s_name, s_acctbal, NULL FROM supplier
    UNION ALL
    SELECT p_partkey, p_name, NULL, p_type FROM part
    """,
)
def bag_union(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey as key", "c_name as name", "c_acctbal as balance", "c_mktsegment as segment"
    )
    suppliers = table(spark, sf_dir, "supplier").selectExpr(
        "s_acctbal as balance", "s_name as name", "s_suppkey as key"
    )
    parts = table(spark, sf_dir, "part").selectExpr(
        "p_partkey as key", "p_name as name", "p_type as segment"
    )
    return concat_tables(customers, suppliers, parts)
