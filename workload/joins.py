"""Lookups, existence tests and coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from tractlake.operators.joins import coverage, left_lookup, star_join, with_match
from tractlake.operators.quality import coverage_counts
from tractlake.plans.acs import collapsed_tables
from workload.registry import query, table

_LABEL_SQL = """
    SELECT d.doc_id, d.lang, d.source, coalesce(l.variable_label, '') AS variable_label
    FROM documents d LEFT JOIN (
        SELECT doc_id, 'quality ' || CAST(quality AS VARCHAR) AS variable_label FROM labels
    ) l USING (doc_id)
"""


def _labelled(spark, sf_dir, salts):
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    labels = table(spark, sf_dir, "labels").select(
        "doc_id",
        F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("variable_label"),
    )
    return left_lookup(documents, labels, "doc_id", {"variable_label": ""}, salts)


@query("J1", _LABEL_SQL)
def label_lookup(spark, sf_dir):
    return _labelled(spark, sf_dir, 1)


_SOURCE_SQL = """
    SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, coalesce(f.label, '') AS label
    FROM lineitem l LEFT JOIN (
        SELECT l_returnflag, 'flag of ' || CAST(count(*) AS VARCHAR) AS label
        FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1
    ) f USING (l_returnflag)
"""


@query("J1", _SOURCE_SQL)
def salted_lookup(spark, sf_dir):
    """Three keys, each with about a third of all rows."""
    lines = table(spark, sf_dir, "lineitem")
    labels = (
        lines.filter(F.col("l_returnflag") != "N")
        .groupBy("l_returnflag")
        .agg(F.concat(F.lit("flag of "), F.count("*").cast("string")).alias("label"))
    )
    rows = lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    return left_lookup(rows, labels, "l_returnflag", {"label": ""}, salts=16).drop("l_returnflag")


@query(
    "J5",
    """
    SELECT o_orderkey, o_totalprice, c_name, c_mktsegment, n_name
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey
    LEFT JOIN nation ON c_nationkey = n_nationkey
    """,
)
def star(spark, sf_dir):
    facts = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_totalprice", F.col("o_custkey").alias("c_custkey")
    )
    customers = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", "c_mktsegment", "c_nationkey"
    )
    nations = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("c_nationkey"), "n_name"
    )
    joined = star_join(facts, {"c_custkey": customers, "c_nationkey": nations})
    return joined.drop("c_custkey", "c_nationkey")


@query(
    "J4",
    """
    SELECT p_partkey, p_name FROM part
    WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey)
    """,
)
def existing_matches(spark, sf_dir):
    large = table(spark, sf_dir, "lineitem")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return with_match(parts, large, "p_partkey", "l_partkey")


@query(
    "J4 F8",
    """
    SELECT DISTINCT 'C' || CAST(p_partkey AS VARCHAR) AS table_id FROM part
    WHERE p_partkey IN (SELECT o_custkey FROM orders)
      AND p_partkey IN (SELECT c_custkey FROM customer)
    """,
)
def collapsed_twins(spark, sf_dir):
    """Parts as configured tables, orders name known tables, customers collapsed ones."""
    config = table(spark, sf_dir, "part").select(
        F.concat(F.lit("B"), F.col("p_partkey").cast("string")).alias("table_id")
    )
    plain = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("B"), F.col("o_custkey").cast("string")).alias("table_id")
    )
    collapsed = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("table_id")
    )
    return collapsed_tables(config, plain.unionAll(collapsed))


def _sides(spark, sf_dir):
    configured = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("state")
    )
    ingested = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("key"), F.col("l_linestatus").alias("state")
    )
    return configured, ingested


@query(
    "J3 U2 Q7",
    """
    SELECT key, state, 'missing' AS status FROM (
        SELECT o_orderkey AS key, o_orderstatus AS state FROM orders
        EXCEPT SELECT l_orderkey, l_linestatus FROM lineitem)
    UNION ALL
    SELECT key, state, 'extra' FROM (
        SELECT l_orderkey AS key, l_linestatus AS state FROM lineitem
        EXCEPT SELECT o_orderkey, o_orderstatus FROM orders)
    """,
)
def two_way_coverage(spark, sf_dir):
    return coverage(*_sides(spark, sf_dir), ["key", "state"])


@query(
    "Q7 A8",
    """
    WITH wanted AS (SELECT DISTINCT o_orderkey AS key, o_orderstatus AS state FROM orders),
         landed AS (SELECT DISTINCT l_orderkey AS key, l_linestatus AS state FROM lineitem)
    SELECT (SELECT count(*) FROM wanted) AS configured, (SELECT count(*) FROM landed) AS ingested,
           (SELECT count(*) FROM (FROM wanted EXCEPT FROM landed)) AS missing,
           (SELECT count(*) FROM (FROM landed EXCEPT FROM wanted)) AS extra
    """,
)
def coverage_totals(spark, sf_dir):
    return coverage_counts(*_sides(spark, sf_dir), ["key", "state"])
