"""Writers, each read back."""

from __future__ import annotations

import uuid

from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tractlake.operators.quality import layer_counts
from tractlake.sinks.commits import commit_version, run_metrics
from tractlake.sinks.writers import (
    append_rows,
    ensure_namespace,
    ensure_table,
    replace_partitions,
    replace_path,
    replace_table,
    write_snapshot,
    write_with_metrics,
)
from tractlake.sources.files import read_path, read_table
from tractlake.sources.snapshots import read_latest_json
from tractlake.streaming.changes import change_check
from tractlake.workspace import fresh_dir
from workload.landing import CLOCK, NEWER, OLDER
from workload.registry import query, table


def _namespace(spark) -> str:
    name = f"tractlake_{uuid.uuid4().hex[:12]}"
    ensure_namespace(spark, name, fresh_dir(spark, name))
    return name


@query(
    "K1 K2 S14",
    """
    SELECT s_suppkey AS key, s_name AS name, s_acctbal AS balance FROM supplier
    UNION ALL SELECT c_custkey, c_name, c_acctbal FROM customer
    """,
)
def appended_table(spark, sf_dir):
    target = f"{_namespace(spark)}.parties"
    suppliers = table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey as key", "s_name as name", "s_acctbal as balance"
    )
    customers = table(spark, sf_dir, "customer").selectExpr(
        "c_acctbal as balance", "c_custkey as key", "c_name as name"
    )
    ensure_table(spark, target, suppliers.schema)
    append_rows(suppliers, target, suppliers.schema)
    append_rows(suppliers.filter("key is null"), target, suppliers.schema)
    append_rows(customers, target, suppliers.schema)
    return read_table(spark, target)


@query("K1 K3 K4 S14 S15", "SELECT o_orderkey, o_totalprice * 2 AS o_totalprice FROM orders")
def replaced_table(spark, sf_dir):
    target = f"{_namespace(spark)}.orders"
    orders = table(spark, sf_dir, "orders")
    replace_table(orders, target)
    replace_table(orders.withColumn("o_totalprice", F.col("o_totalprice") * 2), target)
    return read_table(spark, target, ["o_orderkey", "o_totalprice"])


@query("K5 S10", "SELECT p_partkey, p_name, p_retailprice FROM part")
def replaced_parquet(spark, sf_dir):
    path = fresh_dir(spark, "parquet")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice")
    replace_path(parts.withColumn("p_name", F.lit("old")), path)
    replace_path(parts, path)
    return read_path(spark, path)


@query("K7 S13", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def other_format(spark, sf_dir):
    """The format is a parameter; ORC stands in for formats that need a package."""
    path = fresh_dir(spark, "orc")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    replace_path(orders, path, "orc")
    return read_path(spark, path, "orc", orders.schema)


@query(
    "K4 K5",
    """
    SELECT o_orderkey, o_totalprice, o_orderstatus,
           CASE o_orderstatus WHEN 'F' THEN 'second' ELSE 'first' END AS load FROM orders
    """,
)
def replaced_partitions(spark, sf_dir):
    path = fresh_dir(spark, "partitions")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    first = orders.withColumn("load", F.lit("first"))
    replace_partitions(first, path, ["o_orderstatus"])
    changed = orders.filter(F.col("o_orderstatus") == "F").withColumn("load", F.lit("second"))
    replace_partitions(changed, path, ["o_orderstatus"])
    return read_path(spark, path, schema=first.schema)


@query(
    "Q9 K5 A2",
    """
    SELECT o_orderstatus, count(*) AS row_count,
           (SELECT count(*) FROM orders) AS observed_rows,
           (SELECT count(*) FILTER (WHERE o_orderpriority = '1-URGENT') FROM orders)
               AS observed_urgent
    FROM orders GROUP BY o_orderstatus
    """,
)
def observed_write(spark, sf_dir):
    path = fresh_dir(spark, "observed")
    orders = table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority")
    metrics = write_with_metrics(
        orders,
        path,
        {
            "rows": F.count("*"),
            "urgent": F.count_if(F.col("o_orderpriority") == "1-URGENT"),
        },
    )
    return (
        read_path(spark, path)
        .groupBy("o_orderstatus")
        .agg(F.count("*").alias("row_count"))
        .withColumns(
            {
                "observed_rows": F.lit(metrics["rows"]).cast("bigint"),
                "observed_urgent": F.lit(metrics["urgent"]).cast("bigint"),
            }
        )
    )


@query(
    "K3 K4 K5",
    """
    SELECT place, o_orderkey, o_totalprice
    FROM orders, (VALUES ('table'), ('folder')) AS places(place)
    """,
)
def failed_copy(spark, sf_dir):
    """Replacements that break off after some rows are written; both keep their old rows."""
    target, path = f"{_namespace(spark)}.orders", fresh_dir(spark, "orders")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    broken = orders.withColumn(
        "o_totalprice",
        F.when(F.col("o_totalprice") > 0, F.raise_error(F.lit("broken"))).cast("double"),
    )
    replace_table(orders, target)
    replace_path(orders, path)
    for attempt in (lambda: replace_table(broken, target), lambda: replace_path(broken, path)):
        try:
            attempt()
        except PySparkException:
            continue
        raise AssertionError("the load should have failed")
    kept = read_table(spark, target).withColumn("place", F.lit("table"))
    return kept.unionByName(read_path(spark, path).withColumn("place", F.lit("folder")))


@query(
    "S16 O3 A1 K6",
    """
    SELECT c_custkey, c_acctbal, (SELECT count(*) FROM customer) AS records FROM customer
    """,
)
def committed_snapshot(spark, sf_dir):
    """Two committed snapshots, then a newer one that never ended and a newer one without rows."""
    directory = fresh_dir(spark, "customers")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    zeros = customers.withColumn("c_acctbal", F.lit(0.0))
    write_snapshot(zeros, directory, "json", OLDER)
    write_snapshot(customers, directory, "json", NEWER)
    zeros.write.json(f"{directory}/snapshot=20240115_000000")
    write_snapshot(zeros.filter("c_custkey < 0"), directory, "json", CLOCK)
    counts = layer_counts(spark, {"bronze": (directory, "*.json", "json")})
    newest = read_latest_json(spark, directory, customers.schema)
    return newest.withColumn("records", F.lit(counts.first().records).cast("bigint"))


@query("K1 K2", "SELECT c_custkey AS key, c_acctbal AS balance FROM customer")
def appended_once(spark, sf_dir):
    """Each half is appended under a token of its own, and the second one again."""
    target = f"{_namespace(spark)}.balances"
    customers = table(spark, sf_dir, "customer").selectExpr("c_custkey as key", "c_acctbal as balance")
    ensure_table(spark, target, customers.schema)
    for token in ("0", "1", "1"):
        half = customers.filter(F.col("key") % 2 == int(token))
        append_rows(half, target, customers.schema, token=f"load-{token}")
    return read_table(spark, target)


@query(
    "T1 Q9 A11",
    """
    SELECT 'orders' AS source, count(*) AS current, count(*) AS previous, false AS changed FROM orders
    UNION ALL
    SELECT 'customer', count(*), count(*) FILTER (WHERE c_acctbal > 0),
           count(*) <> count(*) FILTER (WHERE c_acctbal > 0) FROM customer
    UNION ALL
    SELECT 'part', count(*), -1, true FROM part
    """,
)
def repeated_load(spark, sf_dir):
    """What the loads' own logs say against the sources: one loaded twice, one in part, one never."""
    root = fresh_dir(spark, "loads")
    sources = {name: f"{root}/{name}" for name in ("orders", "customer", "part")}
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    replace_path(orders, sources["orders"])
    replace_path(orders, sources["orders"])
    rich = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select("c_custkey")
    replace_path(rich, sources["customer"])
    counted = [
        table(spark, sf_dir, name).agg(F.lit(name).alias("source"), F.count("*").alias("records"))
        for name in sources
    ]
    current = counted[0].unionAll(counted[1]).unionAll(counted[2])
    return change_check(current, run_metrics(spark, sources))


@query(
    "K3 K4 K5",
    """
    SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year,
           CASE year(o_orderdate) WHEN 1995 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice
    FROM orders
    """,
)
def years_side_by_side(spark, sf_dir):
    """Loads of different years stand side by side; loading a year again replaces that year."""
    path = fresh_dir(spark, "years")
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.year("o_orderdate").alias("year"), "o_totalprice"
    )
    again = orders.filter("year = 1995").withColumn("o_totalprice", F.col("o_totalprice") * 2)
    for load in (orders.filter("year < 1998"), orders.filter("year >= 1998"), again):
        commit_version(load, path, partition_by=["year"], scoped=True)
    return read_path(spark, path)
