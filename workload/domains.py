"""The four domains from landed files to gold."""

from __future__ import annotations

from pyspark.sql import functions as F

from tractlake.plans import acs, business, expenses, pit, validation
from tractlake.schemas import RAW_BUSINESS, RAW_EXPENSES
from tractlake.sources.census import read_payloads, read_variable_labels
from tractlake.sources.files import read_json_lines, read_path
from tractlake.sources.snapshots import read_latest_json
from tractlake.workspace import fresh_dir, materialize
from workload import landing
from workload.landing import CLOCK
from workload.projections import GRADE_SQL, priced_lines
from workload.registry import once_per_session, query, table

# --- survey estimates -----------------------------------------------------

YEAR = 2023


def _survey_config(spark, sf_dir):
    """Every part as a configured table that never lands, and the two that do."""
    parts = table(spark, sf_dir, "part").select(
        F.concat(F.lit("X"), F.col("p_partkey").cast("string")).alias("table_id"),
        F.col("p_brand").alias("series"),
    )
    landed = parts.select(
        F.explode(F.array(F.lit("B01"), F.lit("B02"))).alias("table_id"), F.lit("s").alias("series")
    ).distinct()
    return parts.unionAll(landed)


@once_per_session
def _variables(spark, sf_dir):
    """The list of variables as the load stores it."""
    path = landing.survey_variables(spark, sf_dir)
    return materialize(read_variable_labels(spark, path, whole_files=False), "variables")


def _bronze(spark, sf_dir):
    payloads = read_payloads(spark, landing.survey_payloads(spark, sf_dir), whole_files=False)
    selected = materialize(
        acs.selected_variables(_survey_config(spark, sf_dir), _variables(spark, sf_dir)),
        "selected-variables",
    )
    return acs.bronze_estimates(payloads, selected, YEAR, CLOCK)


@once_per_session
def _stored_bronze(spark, sf_dir):
    """The bronze table as the load writes it."""
    return materialize(_bronze(spark, sf_dir), "bronze-estimates")


@once_per_session
def _stored_silver(spark, sf_dir):
    """The silver table as the load writes it."""
    bronze = _stored_bronze(spark, sf_dir)
    return materialize(acs.silver_estimates(bronze, now=CLOCK), "silver-estimates")


_TRACT_SQL = """
    lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || '037' || lpad(CAST(c_custkey AS VARCHAR), 9, '0')
    AS tract_fips, c_name AS tract_name, 2023 AS year
"""
_LONG_SQL = f"""
    SELECT 'B01' AS table_id, 'B01_001' AS variable, 'Label of B01_001E' AS variable_label,
           {_TRACT_SQL}, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS estimate,
           CAST(c_nationkey AS DOUBLE) AS moe FROM customer
    UNION ALL SELECT 'B01', 'B01_002', 'Label of B01_002E', {_TRACT_SQL},
        CAST(c_custkey AS DOUBLE), NULL FROM customer
    UNION ALL SELECT 'B02', 'B02_001', 'Label of B02_001E', {_TRACT_SQL},
        CASE WHEN c_mktsegment <> 'BUILDING' THEN CAST(c_nationkey AS DOUBLE) END, 2.5 FROM customer
    UNION ALL SELECT 'C01', 'C01_001', 'Label of C01_001E', {_TRACT_SQL}, c_acctbal, 164.5
        FROM customer
"""
_SILVER_SQL = f"""
    SELECT *, {GRADE_SQL} AS reliability, '2024-01-31T12:30:00+00:00' AS processed_at FROM (
        SELECT *, CASE WHEN estimate <> 0 THEN abs(standard_error / estimate) * 100 END AS cv_pct
        FROM (SELECT *, moe / 1.645 AS standard_error FROM ({_LONG_SQL})))
"""


@query(
    "R1 J1 J2 J4 F7 U1 P7 S2 S3",
    f"""
    SELECT table_id, variable, variable_label, tract_fips, tract_name, year, estimate, moe,
           '2024-01-31T12:30:00+00:00' AS ingested_at FROM ({_LONG_SQL})
    """,
)
def survey_bronze(spark, sf_dir):
    return _bronze(spark, sf_dir).withColumns(
        {c: F.col(c).try_cast("double") for c in ("estimate", "moe")}
    )


@query("P12 F9 F10 F11 P1 F13", _SILVER_SQL)
def survey_silver(spark, sf_dir):
    return acs.silver_estimates(_stored_bronze(spark, sf_dir), now=CLOCK)


@query(
    "U4 P1",
    """
    SELECT left(code, 7) AS variable, 'Label of ' || code AS variable_label,
           left(code, 3) AS table_id
    FROM (VALUES ('B01_001E'), ('B01_002E'), ('B02_001E'), ('C01_001E')) AS t(code)
    WHERE (SELECT count(*) FROM customer) > 0
    """,
)
def survey_variables(spark, sf_dir):
    return acs.dim_variable(_stored_silver(spark, sf_dir))


@query("U4 P1", f"SELECT DISTINCT tract_fips, tract_name FROM (SELECT {_TRACT_SQL} FROM customer)")
def survey_tracts(spark, sf_dir):
    return acs.dim_tract(_stored_silver(spark, sf_dir))


@query(
    "P8 P1 J5",
    f"""
    SELECT tract_fips, variable, year, estimate, moe, standard_error, cv_pct, reliability,
           variable_label, table_id, tract_name
    FROM ({_SILVER_SQL}) WHERE estimate IS NOT NULL
    """,
)
def survey_facts(spark, sf_dir):
    """Facts joined to the written dimensions, whose sizes Spark then knows."""
    silver = _stored_silver(spark, sf_dir)
    return acs.labelled_facts(
        acs.fact_estimates(silver),
        materialize(acs.dim_variable(silver), "dim-variable"),
        materialize(acs.dim_tract(silver), "dim-tract"),
    )


@query(
    "A11 J3 F14",
    """
    SELECT count(*) + 2 AS tables_configured, CAST(2 AS BIGINT) AS tables_landed,
           count(*) AS tables_empty, CAST(0 AS BIGINT) AS tables_failed, 'none' AS failed_ids
    FROM part
    """,
)
def survey_load_summary(spark, sf_dir):
    return acs.load_summary(
        _survey_config(spark, sf_dir), _variables(spark, sf_dir), _stored_bronze(spark, sf_dir)
    )


# --- expenses ----------------------------------------------------------------

_TYPED_EXPENSES_SQL = """
    SELECT CAST(year(l_shipdate) AS VARCHAR) AS fiscal_year, 'Dept ' || l_returnflag AS dept_name,
           'General' AS fund_nm, CAST(l_partkey AS VARCHAR) AS mjr_project_code,
           'Project ' || CAST(l_partkey AS VARCHAR) AS mjr_project_name,
           CAST(NULL AS VARCHAR) AS business_type, l_linestatus AS payment_type,
           'Supplier ' || CAST(l_suppkey AS VARCHAR) AS vendor_name,
           CAST(NULL AS VARCHAR) AS payment_description, CAST(NULL AS VARCHAR) AS work_order_name,
           CAST(l_tax AS VARCHAR) AS work_order, CAST(NULL AS VARCHAR) AS appr_name,
           CAST(l_orderkey AS VARCHAR) AS doc_id, 'PO' AS doc_cd, l_returnflag AS dept_cd,
           CAST(NULL AS VARCHAR) AS appr_cd, CAST(l_linenumber AS VARCHAR) AS doc_actg_ln_no,
           '100' AS fund_cd, 'Y' AS transaction_closed,
           CASE WHEN l_linestatus = 'O' THEN 'V1' END AS vend_cust_cd,
           l_extendedprice AS amount, l_shipdate AS transaction_date,
           TIMESTAMP '2024-01-31 12:30:00' AS ingest_timestamp
    FROM lineitem
"""
_SILVER_EXPENSES_SQL = f"""
    SELECT * EXCLUDE (rn), CAST(rn AS INTEGER) AS rn FROM (
        SELECT *, row_number() OVER (
            PARTITION BY doc_id, doc_cd, dept_cd, vend_cust_cd, fiscal_year, doc_actg_ln_no
            ORDER BY ingest_timestamp DESC, dept_name DESC, mjr_project_code DESC,
                     mjr_project_name DESC, payment_type DESC, vendor_name DESC,
                     work_order DESC, amount DESC, transaction_date DESC) AS rn
        FROM ({_TYPED_EXPENSES_SQL}))
    WHERE rn = 1
"""


@query(
    "S4 S5 U1 K6 Q10 S16",
    """
    SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, o_orderstatus AS doc_cd,
           CAST(o_totalprice AS DOUBLE) AS pstng_am,
           strftime(o_orderdate, '%m/%d/%Y') AS transaction_date
    FROM orders
    """,
)
def expense_bronze(spark, sf_dir):
    directory = fresh_dir(spark, "expense-bronze")
    pages = landing.expense_pages(spark, sf_dir)
    expenses.land_pages(spark, pages, directory, whole_files=False, now=CLOCK)
    raw = read_latest_json(spark, directory, RAW_EXPENSES)
    return raw.select(
        "doc_id", "doc_cd", F.col("pstng_am").cast("double").alias("pstng_am"), "transaction_date"
    )


@query("P3 P11 F4 W1 S16 K6", _SILVER_EXPENSES_SQL)
def expense_silver(spark, sf_dir):
    directory = landing.expense_snapshots(spark, sf_dir)
    raw = read_latest_json(spark, directory, RAW_EXPENSES)
    return expenses.silver_expenses(raw, CLOCK)


@query(
    "P2 K5 S10",
    f"""
    SELECT * RENAME (dept_name AS department, vendor_name AS vendor, fund_nm AS fund,
                     mjr_project_code AS project_code, mjr_project_name AS project_name,
                     amount AS expense_amount)
    FROM ({_SILVER_EXPENSES_SQL})
    """,
)
def expense_gold(spark, sf_dir):
    bronze = landing.expense_snapshots(spark, sf_dir)
    silver, gold = (fresh_dir(spark, f"expenses-{layer}") for layer in ("silver", "gold"))
    paths = expenses.load_all(spark, bronze, silver, gold, now=CLOCK)
    return read_path(spark, paths["gold"])


@query(
    "P4 P15 F3 F5 U3",
    """
    SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS doc_id, l_shipdate AS trans_date,
           l_extendedprice AS total_amount,
           CASE l_returnflag WHEN 'R' THEN NULL ELSE l_quantity END AS unit_cost,
           l_returnflag AS memo
    FROM lineitem
    """,
)
def expense_silver_by_name(spark, sf_dir):
    raw = priced_lines(spark, sf_dir).select(
        F.col("l_orderkey").cast("string").alias("Doc ID"),
        F.col("trans_date").alias("Trans Date"),
        F.col("total_amount").alias("Total-Amount$"),
        F.col("unit_cost").alias("Unit Cost"),
        F.col("memo").alias("Memo"),
    )
    return expenses.silver_expenses_by_name(raw)


@query(
    "S8 S16 P4 P15 F3 F5 U3 K6",
    """
    SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS doc_id, l_shipdate AS trans_date,
           l_extendedprice AS total_amount,
           CASE l_returnflag WHEN 'R' THEN NULL ELSE l_quantity END AS unit_cost,
           l_returnflag AS memo
    FROM lineitem
    """,
)
def expense_load_by_name(spark, sf_dir):
    bronze = landing.loose_expenses(spark, sf_dir)
    path = expenses.load_by_name(spark, bronze, fresh_dir(spark, "loose-silver"), CLOCK)
    return read_path(spark, path)


# --- business licences ---------------------------------------------------------

_SILVER_BUSINESS_SQL = """
    SELECT CAST(c_custkey AS VARCHAR) AS location_account, c_name AS business_name,
           c_mktsegment || ' STREET' AS street_address,
           'CITY ' || CAST(c_nationkey AS VARCHAR) AS city,
           lpad(CAST(c_nationkey AS VARCHAR), 5, '0') AS zip_code,
           'AT HOME' AS location_description, c_mktsegment AS primary_naics_description,
           CASE WHEN c_mktsegment NOT IN ('HOUSEHOLD', 'MACHINERY')
                THEN CAST(CAST(c_nationkey AS VARCHAR) || '11' AS INTEGER) END AS naics,
           nullif(c_nationkey, 0) AS council_district,
           TIMESTAMP '2015-01-01' + to_days(c_nationkey) AS location_start_date,
           CASE WHEN c_mktsegment <> 'BUILDING' THEN 34 + c_nationkey / 100 END AS latitude,
           CASE WHEN c_mktsegment <> 'BUILDING' THEN -118 - c_nationkey / 100 END AS longitude
    FROM customer
"""


def _silver_business(spark, sf_dir):
    raw = read_json_lines(spark, landing.business_records(spark, sf_dir), RAW_BUSINESS)
    return business.silver_business(raw)


@query("S6 P5 P6 P14 F1 F6", _SILVER_BUSINESS_SQL)
def business_silver(spark, sf_dir):
    return _silver_business(spark, sf_dir)


@query(
    "P1",
    f"""
    SELECT business_name, location_account, naics, primary_naics_description, council_district,
           location_start_date, latitude, longitude, zip_code, city
    FROM ({_SILVER_BUSINESS_SQL})
    """,
)
def business_gold(spark, sf_dir):
    return business.gold_business(_silver_business(spark, sf_dir))


@query(
    "U5 P4 P7",
    f"""
    SELECT min(location_account) AS location_account, street_address, min(city) AS city, zip_code,
           min(council_district) AS council_district, latitude, longitude,
           DATE '2024-01-31' AS ingestion_date, 'LA City Business Dataset' AS data_source,
           'geography' AS data_domain
    FROM ({_SILVER_BUSINESS_SQL}) GROUP BY street_address, zip_code, latitude, longitude
    """,
)
def business_geography(spark, sf_dir):
    return business.gold_geography(_silver_business(spark, sf_dir), CLOCK)


@query(
    "A3 O1 P7",
    f"""
    SELECT council_district, count(*) AS business_count,
           count(DISTINCT naics) AS unique_categories,
           round(avg(latitude), 6) AS avg_latitude, round(avg(longitude), 6) AS avg_longitude,
           DATE '2024-01-31' AS ingestion_date, 'LA City Business Dataset' AS data_source,
           'business_by_district' AS data_domain
    FROM ({_SILVER_BUSINESS_SQL}) GROUP BY council_district
    """,
)
def business_districts(spark, sf_dir):
    districts = business.gold_districts(
        business.gold_business(_silver_business(spark, sf_dir)), CLOCK
    )
    return districts.withColumns(
        {c: F.round(c, 6) for c in ("avg_latitude", "avg_longitude")}
    )


@query(
    "Q1 Q2 Q3 Q4 Q5 K5",
    f"""
    WITH b AS ({_SILVER_BUSINESS_SQL}),
         g AS (SELECT DISTINCT street_address, zip_code, latitude, longitude FROM b)
    SELECT (SELECT count(*) FROM b) AS total_rows, (SELECT count(*) FROM b) AS group_sum,
           'PASS' AS status, (SELECT count(*) FROM g) AS places,
           (SELECT count(*) FROM g WHERE latitude IS NULL) AS null_latitude,
           (SELECT count(*) FROM (SELECT DISTINCT latitude, longitude FROM g)) AS distinct_places,
           (SELECT count(*) FROM (SELECT DISTINCT council_district FROM b)) AS districts,
           (SELECT count(*) FROM b WHERE naics IS NULL) AS null_naics,
           (SELECT count(*) FROM (SELECT DISTINCT naics FROM b)) AS distinct_naics
    """,
)
def business_checks(spark, sf_dir):
    """The checks on the written gold tables, as one row."""
    root = fresh_dir(spark, "business-lake")
    raw = read_json_lines(spark, landing.business_records(spark, sf_dir), RAW_BUSINESS)
    paths = business.load_all(spark, root, raw, now=CLOCK)
    gold = {name: read_path(spark, path) for name, path in paths.items()}
    checks = validation.validate_gold(
        gold["gold.business"], gold["gold.geography"], gold["gold.business_by_district"]
    )
    facts = [
        checks["reconciliation"].withColumn("part", F.lit("reconciliation")),
        checks["geography"].selectExpr(
            "row_count as places", "null_latitude", "distinct_count as distinct_places"
        ),
        checks["districts"].agg(F.count("*").alias("districts")),
        checks["naics"].selectExpr("null_naics", "distinct_count as distinct_naics"),
    ]
    stacked = facts[0]
    for fact in facts[1:]:
        stacked = stacked.unionByName(fact, allowMissingColumns=True)
    return stacked.agg(
        *[F.max(c).alias(c) for c in stacked.columns if c != "part"]
    )


# --- point-in-time counts ------------------------------------------------------

_PIT_SQL = """
    SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority AS spa,
           CASE WHEN o_orderstatus <> 'P' THEN CAST(floor(o_totalprice) AS INTEGER) END AS count
    FROM orders
"""


@query(
    "S11 S12 P14 A4 A6 K7 S13",
    f"SELECT year, spa, CAST(sum(count) AS BIGINT) AS total_count FROM ({_PIT_SQL}) GROUP BY ALL",
)
def pit_metrics(spark, sf_dir):
    paths = pit.load_all(spark, fresh_dir(spark, "pit-lake"), landing.pit_csv(spark, sf_dir))
    return read_path(spark, paths["gold.pit_metrics"])


_YEARLY_SQL = """
    SELECT year, CAST(tent_count AS BIGINT) AS tent_count, round(unsheltered, 2) AS unsheltered,
           round(total_homeless, 2) AS total_homeless,
           round(unsheltered / total_homeless, 6) AS pct_unsheltered,
           round(total_homeless / lag(total_homeless) OVER (ORDER BY year) - 1, 6)
               AS pct_change_total
    FROM (SELECT CAST(year(l_shipdate) AS INTEGER) AS year, sum(l_linenumber) AS tent_count,
                 sum(l_tax) AS unsheltered, sum(l_quantity) AS total_homeless
          FROM lineitem GROUP BY 1)
"""


@query("S9 P4 P13 A5 F12 W2", _YEARLY_SQL)
def pit_yearly(spark, sf_dir):
    raw = table(spark, sf_dir, "lineitem").select(
        F.year("l_shipdate").alias("Year"),
        F.struct(F.col("l_linenumber").cast("string").alias("Tent-Count")).alias("Site"),
        F.concat(F.lit("No. "), F.col("l_suppkey").cast("string")).alias("Site-Number"),
        F.col("l_tax").alias("Unsheltered"),
        F.col("l_quantity").alias("Total Homeless"),
    )
    return _rounded_totals(pit.yearly_totals(pit.clean_totals(raw)))


# JSON numbers without a point are long by inference.
@query(
    "S7 S9 P4 P13 A5 F12 W2 K5",
    f"SELECT * REPLACE (CAST(year AS BIGINT) AS year) FROM ({_YEARLY_SQL})",
)
def pit_totals_load(spark, sf_dir):
    records = landing.pit_records(spark, sf_dir)
    paths = pit.load_totals(spark, fresh_dir(spark, "pit-totals"), records)
    return _rounded_totals(read_path(spark, paths["gold.pit_yearly"]))


def _rounded_totals(yearly):
    rounded = {"unsheltered": 2, "total_homeless": 2, "pct_unsheltered": 6, "pct_change_total": 6}
    return yearly.withColumnRenamed("site.tent_count", "tent_count").withColumns(
        {c: F.round(c, n) for c, n in rounded.items()}
    )
