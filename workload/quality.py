"""Data-quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tractlake.operators.quality import (
    duplicate_report,
    filter_with_dropped,
    ingest_summary,
    null_counts,
    profile,
    reconcile,
    require_rows,
    row_counts,
    schema_report,
)
from tractlake.functions.reliability import with_reliability
from workload.projections import ESTIMATE_SQL, estimate_rows
from workload.registry import query, table


@query(
    "A9 Q8",
    """
    SELECT CAST(sum(n) AS BIGINT) AS total_rows, count(*) AS distinct_keys,
           CAST(sum(n - 1) AS BIGINT) AS duplicate_rows
    FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)
    """,
)
def duplicate_keys(spark, sf_dir):
    return duplicate_report(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


def _labelled(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return documents.join(table(spark, sf_dir, "labels"), "doc_id", "left")


@query(
    "A7 A10 Q3 Q5",
    """
    SELECT count(*) AS row_count, count(*) FILTER (WHERE quality IS NULL) AS null_quality,
           count(*) FILTER (WHERE toxic IS NULL) AS null_toxic,
           (SELECT count(*) FROM (SELECT DISTINCT quality, toxic
                                  FROM documents LEFT JOIN labels USING (doc_id)))
               AS distinct_count
    FROM documents LEFT JOIN labels USING (doc_id)
    """,
)
def null_and_distinct_profile(spark, sf_dir):
    return profile(_labelled(spark, sf_dir), ["quality", "toxic"], ["quality", "toxic"])


@query(
    "A10 P9",
    """
    SELECT count(*) FILTER (WHERE lang IS NULL) AS null_lang,
           count(*) FILTER (WHERE quality IS NULL) AS null_quality
    FROM documents LEFT JOIN labels USING (doc_id)
    """,
)
def nulls_per_column(spark, sf_dir):
    return null_counts(_labelled(spark, sf_dir), ["lang", "quality"])


@query(
    "Q1",
    """
    SELECT 'orders' AS table_name, count(*) AS row_count FROM orders
    UNION ALL SELECT 'lineitem', count(*) FROM lineitem
    UNION ALL SELECT 'customer', count(*) FROM customer
    """,
)
def table_row_counts(spark, sf_dir):
    return row_counts(
        {name: table(spark, sf_dir, name) for name in ("orders", "lineitem", "customer")}
    )


@query(
    "Q2",
    """
    SELECT t.total_rows, g.group_sum,
           CASE WHEN t.total_rows = g.group_sum THEN 'PASS' ELSE 'FAIL' END AS status
    FROM (SELECT count(*) AS total_rows FROM lineitem) t,
         (SELECT CAST(sum(n) AS BIGINT) AS group_sum
          FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_suppkey)) g
    """,
)
def reconciled_counts(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    groups = lines.groupBy("l_suppkey").agg(F.count("*").alias("business_count"))
    return reconcile(lines, groups, "business_count")


@query(
    "Q6",
    """
    SELECT * FROM (VALUES
        ('l_orderkey', 'bigint', 'bigint', true, 0::BIGINT),
        ('l_linenumber', 'bigint', 'int', false, 0),
        ('l_discount', NULL, 'double', false, 0),
        ('l_comment', 'string', NULL, false, NULL),
        ('returned', 'string', 'string', true,
         (SELECT count(*) FROM lineitem WHERE l_returnflag <> 'R')))
        AS t(column_name, expected_type, actual_type, ok, null_count)
    """,
)
def schema_check(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_discount",
        F.when(F.col("l_returnflag") == "R", F.col("l_returnflag")).alias("returned"),
    )
    expected = T.StructType(
        [
            T.StructField("l_orderkey", T.LongType()),
            T.StructField("l_linenumber", T.LongType()),
            T.StructField("l_comment", T.StringType()),
            T.StructField("returned", T.StringType()),
        ]
    )
    return schema_report(lines, expected)


@query(
    "A11",
    """
    WITH c AS (
        SELECT n_name AS table_id, n_nationkey IN (SELECT s_nationkey FROM supplier) AS described,
               n_nationkey IN (SELECT c_nationkey FROM customer GROUP BY c_nationkey
                               HAVING sum(c_custkey) % 3 = 0) AS landed
        FROM nation)
    SELECT count(*) AS tables_configured, count(*) FILTER (WHERE landed) AS tables_landed,
           count(*) FILTER (WHERE NOT landed AND NOT described) AS tables_empty,
           count(*) FILTER (WHERE NOT landed AND described) AS tables_failed,
           coalesce(string_agg(CASE WHEN NOT landed AND described THEN table_id END, ', '
                    ORDER BY table_id), 'none') AS failed_ids
    FROM c
    """,
)
def load_outcome(spark, sf_dir):
    """Nations as configured tables: suppliers describe them, the sums of customers land them."""
    nations = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("table_id"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_nationkey"))
    sums = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey"))
    customers = sums.agg(F.sum("c_custkey").alias("sum")).filter("sum % 3 = 0").select("n_nationkey")
    return ingest_summary(
        nations, suppliers.join(nations, "n_nationkey"), customers.join(nations, "n_nationkey")
    )


@query(
    "Q9 P8",
    f"""
    SELECT count(*) FILTER (WHERE estimate IS NOT NULL) AS kept_rows,
           count(*) FILTER (WHERE estimate IS NULL) AS dropped_rows
    FROM ({ESTIMATE_SQL})
    """,
)
def dropped_rows(spark, sf_dir):
    _, counts = filter_with_dropped(with_reliability(estimate_rows(spark, sf_dir)), "estimate")
    return counts


@query("Q10", "SELECT p_partkey, p_brand FROM part")
def guarded_input(spark, sf_dir):
    return require_rows(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "parts")
