"""Raw files as a source would land them, written by Spark from the test tables.

All go to the shared folder, once per session. Groups that become one JSON page
are ranges of a unique key, so a page has a fixed greatest size and the number of
pages grows with the data.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tractlake.sinks.writers import write_snapshot
from tractlake.workspace import fresh_dir
from workload.registry import once_per_session, table


# A test table is one file with one row group; a feed lands as several files.
RECORDS_PER_FILE = 50_000

OLDER = datetime(2024, 1, 1, tzinfo=timezone.utc)
NEWER = datetime(2024, 1, 2, tzinfo=timezone.utc)
CLOCK = datetime(2024, 1, 31, 12, 30, 0, tzinfo=timezone.utc)


def text_of(name: str) -> Column:
    return F.col(name).cast("string")


def _write_lines(df: DataFrame, name: str, one_file_per_line: bool = False) -> str:
    path = fresh_dir(df.sparkSession, name)
    writer = df.write
    if one_file_per_line:
        writer = writer.option("maxRecordsPerFile", 1)
    writer.text(path)
    return path


@once_per_session
def table_config(spark, sf_dir) -> str:
    """Parts as a tab-separated list of tables, with white space around the ids."""
    path = fresh_dir(spark, "config")
    (
        table(spark, sf_dir, "part")
        .select(
            F.concat(F.lit(" B"), text_of("p_partkey"), F.lit("  ")).alias("table_id"),
            F.col("p_brand").alias("series"),
        )
        .write.option("sep", "\t")
        .option("header", True)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
    return path


SURVEY_HEADER = (
    "NAME",
    "B01_001E",
    "B01_001M",
    "B01_002E",
    "B02_001E",
    "B02_001M",
    "C01_001E",
    "C01_001M",
    "B99_001E",
    "state",
    "county",
    "tract",
)


@once_per_session
def survey_payloads(spark, sf_dir) -> str:
    """Customers as survey responses, one per line: header, then a row per tract."""
    row = F.array(
        F.col("c_name"),
        F.when(F.col("c_acctbal") >= 0, text_of("c_acctbal")).otherwise("-"),
        text_of("c_nationkey"),
        text_of("c_custkey"),
        F.when(F.col("c_mktsegment") != "BUILDING", text_of("c_nationkey")),
        F.lit("2.5"),
        text_of("c_acctbal"),
        F.lit("164.5"),
        F.lit("1"),
        F.lpad(text_of("c_nationkey"), 2, "0"),
        F.lit("037"),
        F.lpad(text_of("c_custkey"), 9, "0"),
    )
    header = F.array(F.array(*[F.lit(name) for name in SURVEY_HEADER]))
    pages = (
        table(spark, sf_dir, "customer")
        .groupBy(F.floor(F.col("c_custkey") / 500).alias("page"))
        .agg(F.collect_list(row).alias("rows"))
        .select(F.to_json(F.concat(header, "rows")).alias("value"))
    )
    return _write_lines(pages, "payloads")


@once_per_session
def survey_variables(spark, sf_dir) -> str:
    """The list of variables that goes with these responses, and one per part."""
    fixed = ("B01_001E", "B01_001M", "B01_002E", "B02_001E", "C01_001E", "NAME", "state")
    described = F.struct(F.concat(F.lit("Estimate!!"), "p_name").alias("label"))
    pages = (
        table(spark, sf_dir, "part")
        .groupBy(F.floor(F.col("p_partkey") / 100).alias("page"))
        .agg(
            F.map_from_entries(
                F.collect_list(
                    F.struct(
                        F.concat(F.lit("P"), text_of("p_partkey"), F.lit("_001E")),
                        F.when(F.col("p_type") != "SMALL", described).otherwise(
                            F.struct(F.lit(None).cast("string").alias("label"))
                        ),
                    )
                )
            ).alias("by_part")
        )
    )
    shared = F.map_from_entries(
        F.array(
            *[
                F.struct(F.lit(c), F.struct(F.concat(F.lit("Label of "), F.lit(c)).alias("label")))
                for c in fixed
            ]
        )
    )
    codes = F.when(F.col("page") == 0, F.map_concat("by_part", shared)).otherwise(F.col("by_part"))
    return _write_lines(
        pages.select(F.to_json(F.struct(codes.alias("variables"))).alias("value")), "variables"
    )


def _pages(spark, sf_dir, record: Column, page_size: int, one_file_per_page: bool) -> str:
    """Orders as JSON lists of ``record``, and one empty list at the end."""
    pages = (
        table(spark, sf_dir, "orders")
        .groupBy(F.floor(F.col("o_orderkey") / page_size).alias("page"))
        .agg(F.to_json(F.collect_list(record)).alias("value"))
    )
    last = pages.agg((F.max("page") + 1).alias("page")).select(F.lit("[]").alias("value"))
    return _write_lines(pages.select("value").unionAll(last), "pages", one_file_per_page)


def _order_record() -> Column:
    return F.struct(
        text_of("o_orderkey").alias("doc_id"),
        F.col("o_orderstatus").alias("state"),
        text_of("o_totalprice").alias("amount"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("priority"),
    )


@once_per_session
def expense_pages(spark, sf_dir) -> str:
    """Orders as pages of raw expense records, a page per line."""
    record = F.struct(
        text_of("o_orderkey").alias("doc_id"),
        F.col("o_orderstatus").alias("doc_cd"),
        text_of("o_totalprice").alias("pstng_am"),
        F.date_format("o_orderdate", "MM/dd/yyyy").alias("transaction_date"),
    )
    return _pages(spark, sf_dir, record, 500, False)


@once_per_session
def order_pages(spark, sf_dir) -> str:
    """Orders as JSON pages, a list of records per line, and one empty page at the end."""
    return _pages(spark, sf_dir, _order_record(), 500, False)


@once_per_session
def order_page_files(spark, sf_dir) -> str:
    """The same in pages of 5000, each a file of its own."""
    return _pages(spark, sf_dir, _order_record(), 5000, True)


@once_per_session
def business_records(spark, sf_dir) -> str:
    """Customers as nested licence records, one per line."""
    segment = F.col("c_mktsegment")
    place = F.struct(
        (F.lit(34) + F.col("c_nationkey") / 100).cast("string").alias("latitude"),
        (F.lit(-118) - F.col("c_nationkey") / 100).cast("string").alias("longitude"),
    )
    path = fresh_dir(spark, "business")
    table(spark, sf_dir, "customer").select(
        F.concat(F.lit("  "), text_of("c_custkey"), F.lit(" ")).alias("location_account"),
        F.concat("c_name", F.lit(" ")).alias("business_name"),
        F.concat(F.lit(" "), segment, F.lit(" STREET")).alias("street_address"),
        F.concat(F.lit("CITY "), text_of("c_nationkey")).alias("city"),
        F.lpad(text_of("c_nationkey"), 5, "0").alias("zip_code"),
        F.lit("AT HOME").alias("location_description"),
        segment.alias("primary_naics_description"),
        F.when(segment == "HOUSEHOLD", "x")
        .when(segment != "MACHINERY", F.concat(text_of("c_nationkey"), F.lit("11")))
        .alias("naics"),
        F.when(F.col("c_nationkey") > 0, text_of("c_nationkey")).alias("council_district"),
        F.date_format(
            F.date_add(F.lit("2015-01-01").cast("date"), F.col("c_nationkey")),
            "yyyy-MM-dd'T'00:00:00.000",
        ).alias("location_start_date"),
        F.when(segment != "BUILDING", place).alias("location_1"),
        F.lit("9").alias("@computed_region_a1b2"),
    ).write.json(path)
    return path


def _expense_records(spark, sf_dir) -> DataFrame:
    """Line items as raw expense records, all text, repeated under their key."""
    line = table(spark, sf_dir, "lineitem")
    empty = F.lit(None).cast("string")
    return line.select(
        F.year("l_shipdate").cast("string").alias("fiscal_year"),
        F.concat(F.lit("Dept "), "l_returnflag").alias("dept_nm"),
        F.lit("General").alias("fund_nm"),
        text_of("l_partkey").alias("mjr_project_code"),
        F.concat(F.lit("Project "), text_of("l_partkey")).alias("mjr_project_name"),
        empty.alias("business_type"),
        F.col("l_linestatus").alias("payment_type"),
        F.concat(F.lit("Supplier "), text_of("l_suppkey")).alias("vendor_name"),
        empty.alias("payment_description"),
        empty.alias("work_order_nm"),
        text_of("l_tax").alias("work_order"),
        empty.alias("appr_nm"),
        text_of("l_orderkey").alias("doc_id"),
        F.lit("PO").alias("doc_cd"),
        F.col("l_returnflag").alias("dept_cd"),
        empty.alias("appr_cd"),
        text_of("l_linenumber").alias("doc_actg_ln_no"),
        F.lit("100").alias("fund_cd"),
        F.lit("Y").alias("transaction_closed"),
        F.when(F.col("l_linestatus") == "O", "V1").alias("vend_cust_cd"),
        text_of("l_extendedprice").alias("pstng_am"),
        F.date_format("l_shipdate", "MM/dd/yyyy").alias("transaction_date"),
    )


@once_per_session
def expense_snapshots(spark, sf_dir) -> str:
    """A directory with one JSON snapshot of these records."""
    directory = fresh_dir(spark, "expenses")
    write_snapshot(_expense_records(spark, sf_dir), directory, "json", CLOCK)
    return directory


def _text_table(df: DataFrame, name: str) -> str:
    path = fresh_dir(df.sparkSession, name)
    df.write.option("maxRecordsPerFile", RECORDS_PER_FILE).parquet(path)
    return path


@once_per_session
def estimate_text(spark, sf_dir) -> str:
    """Events as survey estimates in text: errors are '-', k is the margin in percent."""
    k = F.get_json_object("props", "$.k").cast("int")
    estimates = table(spark, sf_dir, "events").select(
        "event_id",
        F.col("event_type").alias("variable"),
        F.col("user_id").alias("tract"),
        F.when(F.col("event_type") == "error", "-")
        .when(k == 0, "0")
        .otherwise(text_of("value"))
        .alias("estimate"),
        (F.col("value") * k / 100).cast("string").alias("moe"),
    )
    return _text_table(estimates, "estimates")


@once_per_session
def priced_lines(spark, sf_dir) -> str:
    """Line items with dates and prices in text, as a loose expense feed has them."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.date_format("l_shipdate", "M/d/yyyy").alias("trans_date"),
        F.concat(F.lit("$"), F.format_number("l_extendedprice", 2)).alias("total_amount"),
        F.when(F.col("l_returnflag") != "R", text_of("l_quantity")).alias("unit_cost"),
        F.col("l_returnflag").alias("memo"),
    )
    return _text_table(lines, "priced-lines")


@once_per_session
def loose_expenses(spark, sf_dir) -> str:
    """One JSON snapshot of these lines with headings as names; every line is in it twice."""
    lines = spark.read.parquet(priced_lines(spark, sf_dir)).select(
        text_of("l_orderkey").alias("Doc ID"),
        F.col("trans_date").alias("Trans Date"),
        F.col("total_amount").alias("Total-Amount$"),
        F.col("unit_cost").alias("Unit Cost"),
        F.col("memo").alias("Memo"),
    )
    directory = fresh_dir(spark, "loose-expenses")
    write_snapshot(lines.unionAll(lines), directory, "json", CLOCK)
    return directory


@once_per_session
def pit_records(spark, sf_dir) -> str:
    """Line items as nested records of yearly totals, one per line."""
    path = fresh_dir(spark, "pit-records")
    table(spark, sf_dir, "lineitem").select(
        F.year("l_shipdate").alias("Year"),
        F.struct(text_of("l_linenumber").alias("Tent-Count")).alias("Site"),
        F.concat(F.lit("No. "), text_of("l_suppkey")).alias("Site-Number"),
        F.col("l_tax").alias("Unsheltered"),
        F.col("l_quantity").alias("Total Homeless"),
    ).write.option("maxRecordsPerFile", RECORDS_PER_FILE).json(path)
    return path


@once_per_session
def dated_orders(spark, sf_dir) -> str:
    """Order dates in text; a pending order has none."""
    shown = F.date_format("o_orderdate", "MM/dd/yyyy")
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        shown.alias("strict_text"),
        F.when(F.col("o_orderstatus") == "P", "n/a").otherwise(shown).alias("lenient_text"),
    )
    return _text_table(orders, "dated-orders")


@once_per_session
def order_snapshots(spark, sf_dir) -> str:
    """Two JSON snapshots of the orders; the older one has no prices."""
    directory = fresh_dir(spark, "snapshots")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    write_snapshot(orders.withColumn("o_totalprice", F.lit(0.0)), directory, "json", OLDER)
    write_snapshot(orders, directory, "json", NEWER)
    return directory


@once_per_session
def line_snapshots(spark, sf_dir) -> str:
    directory = fresh_dir(spark, "line-snapshots")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey")
    write_snapshot(lines, directory, "parquet", OLDER)
    return directory


@once_per_session
def pit_csv(spark, sf_dir) -> str:
    """Orders as point-in-time counts; the count of a pending order is not a number."""
    path = fresh_dir(spark, "pit")
    table(spark, sf_dir, "orders").select(
        F.year("o_orderdate").alias("year"),
        F.col("o_orderpriority").alias("spa"),
        F.col("o_orderstatus").alias("population_type"),
        F.when(F.col("o_orderstatus") == "P", "x")
        .otherwise(F.floor("o_totalprice").cast("string"))
        .alias("count"),
    ).write.option("header", True).csv(path)
    return path
