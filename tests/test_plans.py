import json
from datetime import date, datetime, timezone

import pytest
from pyspark.errors import PySparkException

from tractlake.plans import acs, business, expenses, pit, validation
from tractlake.schemas import DATASETS, RAW_BUSINESS, RAW_EXPENSES
from tractlake.sinks.commits import run_metrics
from tractlake.sources.files import read_dataset, read_json_records, read_path
from tractlake.sources.snapshots import latest_snapshot

NOW = datetime(2024, 1, 31, 12, 0, tzinfo=timezone.utc)

PAYLOADS = [
    [
        ["NAME", "B19013_001E", "B19013_001M", "B19013_002E", "state", "county", "tract"],
        ["Tract 1", "1000", "164.5", "5", "06", "037", "000100"],
        ["Tract 2", "-", "12", "6", "06", "037", "000200"],
        ["Tract 3", "0", "12", None, "06", "037", "000300"],
    ],
    [
        ["NAME", "C19013_001E", "C19013_001M", "state", "county", "tract"],
        ["Tract 1", "1000", "658", "06", "037", "000100"],
    ],
    [
        ["NAME", "B77777_001E", "state", "county", "tract"],
        ["Tract 1", "1", "06", "037", "000100"],
    ],
]
VARIABLES = {
    "variables": {
        "B19013_001E": {"label": "Median"},
        "B19013_002E": {},
        "C19013_001E": {"label": "Collapsed"},
        "C25064_001E": {"label": "Twin of a table without variables"},
        "B77777_001E": {"label": "Not configured"},
    }
}
CONFIG = "table_id\tseries\nB19013\tIncome\n B25064 \tHousing\n"


def as_set(df):
    return {tuple(r) for r in df.collect()}


@pytest.fixture
def survey(place):
    files = {f"payloads/{i}.json": json.dumps(p) for i, p in enumerate(PAYLOADS)}
    return place({**files, "config.csv": CONFIG, "variables.json": json.dumps(VARIABLES)})


def load_survey(spark, survey):
    root = f"{survey}/lake"
    acs.load_all(
        spark,
        root,
        f"{survey}/config.csv",
        f"{survey}/variables.json",
        f"{survey}/payloads",
        2023,
        now=NOW,
    )
    return {
        name: read_dataset(spark, root, name)
        for name in DATASETS
        if "estimates" in name or "dim" in name or "variables" in name
    }


def test_survey_from_files_to_star(spark, survey):
    lake = load_survey(spark, survey)
    assert lake["bronze.variables"].count() == 5
    assert as_set(lake["bronze.selected_variables"]) == {
        ("B19013", "B19013_001", "Median"),
        ("B19013", "B19013_002", ""),
        ("C19013", "C19013_001", "Collapsed"),
    }
    assert lake["bronze.estimates"].count() == 7
    silver = lake["silver.estimates"]
    assert silver.count() == 7
    grades = {(r.variable, r.tract_fips): r.reliability for r in silver.collect()}
    assert grades["B19013_001", "06037000100"] == "reliable"
    assert grades["C19013_001", "06037000100"] == "use with caution"
    assert grades["B19013_001", "06037000300"] == "not applicable"
    assert as_set(lake["gold.dim_variable"]) == {
        ("B19013_001", "Median", "B19013"),
        ("B19013_002", "", "B19013"),
        ("C19013_001", "Collapsed", "C19013"),
    }
    assert lake["gold.dim_tract"].count() == 3
    fact = lake["gold.fact_estimates"]
    metrics = acs.estimate_metrics(silver).first()
    assert fact.count() == silver.count() - metrics.dropped_unparseable == 5
    labelled = acs.labelled_facts(fact, lake["gold.dim_variable"], lake["gold.dim_tract"])
    assert {(r.variable, r.tract_name, r.variable_label) for r in labelled.collect()} >= {
        ("B19013_001", "Tract 3", "Median")
    }
    assert labelled.count() == fact.count()


def test_rejects_are_kept_and_a_variable_counts_once(spark, place):
    header = ["NAME", "B19013_001E", "state", "county", "tract"]
    payloads = [
        json.dumps([header, ["T1", "1", "06", "037", "000100"]]),
        json.dumps([[*header, "state"], ["T2", "2", "06", "037", "000200", "06"]]),
        json.dumps([header, ["T3", "3", "06", "037"]]),
        "<html>limit</html>",
    ]
    label = {"variables": {"B19013_001E": {"label": "b"}}}
    root = place(
        {
            **{f"payloads/{i}.json": p for i, p in enumerate(payloads)},
            "config.csv": "series\tother\ttable_id\nIncome\tx\tB19013\n",
            "variables/0.json": json.dumps(label),
            "variables/1.json": json.dumps(label).replace('"b"', '"a"'),
        }
    )
    paths = acs.load_all(
        spark, f"{root}/lake", f"{root}/config.csv", f"{root}/variables", f"{root}/payloads", 2023, now=NOW
    )
    facts = spark.read.parquet(paths["bronze.estimates"]).collect()
    assert [(r.tract_name, r.variable_label) for r in facts] == [("T1", "a")]
    reasons = [r.reason for r in read_dataset(spark, f"{root}/lake", "bronze.rejects").collect()]
    assert sorted(reasons) == ["response without a header", *["row does not fit its header"] * 2]


def test_second_load_gives_the_same_tables(spark, survey):
    first = {name: as_set(df) for name, df in load_survey(spark, survey).items()}
    assert {name: as_set(df) for name, df in load_survey(spark, survey).items()} == first


def test_years_stand_side_by_side(spark, place):
    """Loads of two years, and a second load of the first."""
    header = ["NAME", "B19013_001E", "state", "county", "tract"]
    root = place(
        {
            **{f"payloads/{y}/0.json": json.dumps([header, ["T1", str(y), "06", "037", "000100"]]) for y in (1, 2, 3)},
            "config.csv": "table_id\tseries\nB19013\tIncome\n",
            "variables/0.json": json.dumps({"variables": {"B19013_001E": {"label": "b"}}}),
        }
    )
    for year, payload in ((2022, 1), (2023, 2), (2022, 3)):
        acs.load_all(
            spark, f"{root}/lake", f"{root}/config.csv", f"{root}/variables", f"{root}/payloads/{payload}", year, now=NOW
        )
    for name in ("bronze.estimates", "silver.estimates", "gold.fact_estimates"):
        rows = read_dataset(spark, f"{root}/lake", name).collect()
        assert sorted((r.year, float(r.estimate)) for r in rows) == [(2022, 3.0), (2023, 2.0)]
    assert read_dataset(spark, f"{root}/lake", "gold.dim_tract").count() == 1
    runs = run_metrics(spark, {"silver": f"{root}/lake/silver/estimates"}).collect()
    assert [r.records for r in runs] == [1, 1, 1] and {r.metrics["reliable_count"] for r in runs} == {0.0}


def test_survey_checks(spark, survey, rows):
    lake = load_survey(spark, survey)
    bronze = lake["bronze.estimates"]
    assert tuple(acs.estimate_duplicates(bronze.unionAll(bronze)).first()) == (14, 7, 7)
    config = rows("table_id string", ("B19013",), ("B25064",))
    assert tuple(acs.table_coverage(config, bronze).first()) == (2, 2, 1, 1)
    summary = acs.load_summary(config, lake["bronze.variables"], bronze).first()
    assert tuple(summary) == (2, 1, 1, 0, "none")


def test_dim_variable_takes_the_latest_label(rows):
    silver = rows(
        "variable string, variable_label string, table_id string, year int",
        ("v", "old", "t", 2021),
        ("v", "new b", "t", 2022),
        ("v", "new a", "t", 2022),
    )
    assert as_set(acs.dim_variable(silver)) == {("v", "new a", "t")}


EXPENSE = {
    "fiscal_year": "2024",
    "dept_nm": "Housing",
    "doc_id": "1",
    "doc_cd": "PO",
    "dept_cd": "9",
    "vend_cust_cd": "V",
    "doc_actg_ln_no": "1",
    "vendor_name": "A",
    "pstng_am": "1234.50",
    "transaction_date": "01/05/2024",
}


def raw_expenses(spark, *changes):
    records = [{**EXPENSE, **change} for change in changes]
    data = [tuple(r.get(n) for n in RAW_EXPENSES.fieldNames()) for r in records]
    return spark.createDataFrame(data, RAW_EXPENSES)


def test_silver_expenses(spark):
    raw = raw_expenses(
        spark,
        {},
        {"vendor_name": "B", "transaction_date": "1/5/2024"},
        {"doc_id": "2", "vend_cust_cd": None, "pstng_am": "1"},
        {"doc_id": "2", "vend_cust_cd": None, "pstng_am": "2"},
    )
    out = expenses.silver_expenses(raw, NOW)
    assert out.columns == DATASETS["silver.expenses"].schema.fieldNames()
    assert [f.dataType for f in out.schema] == [
        f.dataType for f in DATASETS["silver.expenses"].schema
    ]
    got = {(r.doc_id, r.vendor_name, r.amount, r.transaction_date) for r in out.collect()}
    assert got == {
        ("1", "B", 1234.5, datetime(2024, 1, 5)),
        ("2", "A", 2.0, datetime(2024, 1, 5)),
    }
    gold = expenses.gold_expenses(out)
    assert {"department", "vendor", "fund", "project_code", "project_name", "expense_amount"} <= set(
        gold.columns
    )


def test_bad_amount_ends_the_run(spark):
    with pytest.raises(PySparkException, match="abc"):
        expenses.silver_expenses(raw_expenses(spark, {"pstng_am": "abc"}), NOW).collect()


def test_silver_expenses_by_name(rows):
    raw = rows(
        "`Trans Date` string, `Total-Amount$` string, `Unit Cost` string, Memo string",
        ("2024-01-05", "$1,234.50", None, "m"),
        ("2024-01-05", "$1,234.50", None, "m"),
        ("n/a", "1", "2", "m"),
    )
    out = expenses.silver_expenses_by_name(raw)
    assert out.columns == ["trans_date", "total_amount", "unit_cost", "memo"]
    assert as_set(out) == {
        (datetime(2024, 1, 5), 1234.5, None, "m"),
        (None, 1.0, 2.0, "m"),
    }


def test_loose_expenses_load_from_the_newest_snapshot(spark, place):
    line = {"Trans Date": "1/5/2024", "Total-Amount$": "$1,234.50", "Memo": "m"}
    root = place(
        {
            "bronze/x_20240101_000000.json": json.dumps([{**line, "Memo": "old"}]),
            "bronze/x_20240102_000000.json": json.dumps([line, line, {**line, "Unit Cost": 2}]),
        }
    )
    path = expenses.load_by_name(spark, f"{root}/bronze", f"{root}/silver", NOW)
    assert path == latest_snapshot(spark, f"{root}/silver").removeprefix("file:")
    out = spark.read.parquet(path).select("trans_date", "total_amount", "unit_cost", "memo")
    assert as_set(out) == {
        (datetime(2024, 1, 5), 1234.5, None, "m"),
        (datetime(2024, 1, 5), 1234.5, 2.0, "m"),
    }
    with pytest.raises(FileNotFoundError):
        expenses.load_by_name(spark, f"{root}/nothing", f"{root}/silver", NOW)


def test_pages_become_one_snapshot(spark, place):
    root = place(
        {
            "pages/0.json": json.dumps([EXPENSE, {**EXPENSE, "doc_id": "2"}], indent=2),
            "pages/1.json": json.dumps([{**EXPENSE, "doc_id": "3"}]),
            "pages/2.json": "[]",
            "none/0.json": "[]",
            "wrong/0.json": json.dumps({"error": "limit"}),
        }
    )
    path = expenses.land_pages(spark, f"{root}/pages", f"{root}/bronze", now=NOW)
    assert path == latest_snapshot(spark, f"{root}/bronze").removeprefix("file:")
    paths = expenses.load_all(
        spark, f"{root}/bronze", f"{root}/silver", f"{root}/gold", now=NOW
    )
    assert spark.read.parquet(paths["gold"]).count() == 3
    assert expenses.land_pages(spark, f"{root}/none", f"{root}/bronze2", now=NOW) is None
    with pytest.raises(Exception, match="expected a JSON list"):
        expenses.land_pages(spark, f"{root}/wrong", f"{root}/bronze2", now=NOW)


def test_bronze_keeps_every_field(spark, place):
    pages = json.dumps([{**EXPENSE, "doc_id": str(i), "memo": f"m{i}"} for i in range(100)])
    root = place({"pages/0.json": pages})
    path = expenses.land_pages(spark, f"{root}/pages", f"{root}/bronze", now=NOW)
    records = [json.loads(r.record) for r in spark.read.json(path).collect()]
    assert sorted(r["memo"] for r in records) == sorted(f"m{i}" for i in range(100))
    paths = expenses.load_all(spark, f"{root}/bronze", f"{root}/silver", f"{root}/gold", now=NOW)
    assert spark.read.parquet(paths["gold"]).count() == 100


def test_expense_load_takes_the_newest_snapshot(spark, place):
    root = place(
        {
            "bronze/x_20240101_000000.json": json.dumps([EXPENSE, {**EXPENSE, "doc_id": "2"}]),
            "bronze/x_20240102_000000.json": json.dumps([EXPENSE]),
        }
    )
    paths = expenses.load_all(
        spark, f"{root}/bronze", f"{root}/silver", f"{root}/gold", now=NOW
    )
    assert paths["gold"].endswith("snapshot=20240131_120000")
    gold = spark.read.parquet(latest_snapshot(spark, f"{root}/gold", "*.parquet"))
    assert [r.expense_amount for r in gold.collect()] == [1234.5]


BUSINESSES = [
    {
        "location_account": " 1 ",
        "business_name": " SHOP ",
        "street_address": "1 MAIN ST ",
        "city": "LOS ANGELES",
        "zip_code": "90001",
        "naics": "441110",
        "council_district": "9",
        "location_start_date": "2015-01-01T00:00:00.000",
        "location_1": {"latitude": "34.1", "longitude": "-118.2"},
        "@computed_region_abcd": "1",
        "extra": "kept",
    },
    {
        "location_account": "2",
        "business_name": "SHOP 2",
        "street_address": "1 MAIN ST",
        "city": "LOS ANGELES",
        "zip_code": "90001",
        "naics": "x",
        "council_district": "9",
        "location_1": {"latitude": "34.1", "longitude": "-118.2"},
    },
    {"location_account": "3", "business_name": "NOWHERE", "naics": None},
]


@pytest.fixture
def raw_business(spark, place):
    return read_json_records(spark, place({"business.json": json.dumps(BUSINESSES)}))


def test_silver_business(raw_business):
    # These columns are in no record here, so inference has not found them.
    from pyspark.sql import functions as F

    raw = raw_business.withColumns(
        {c: F.lit(None).cast("string") for c in RAW_BUSINESS.fieldNames() if c not in raw_business.columns}
    )
    out = business.silver_business(raw)
    assert "extra" in out.columns
    assert not {"location_1", "@computed_region_abcd"} & set(out.columns)
    got = {r.location_account: r for r in out.collect()}
    assert got["1"].business_name == "SHOP"
    assert (got["1"].latitude, got["1"].longitude, got["1"].naics) == (34.1, -118.2, 441110)
    assert got["1"].location_start_date == datetime(2015, 1, 1)
    assert got["2"].naics is None
    assert (got["3"].latitude, got["3"].council_district) == (None, None)


def test_business_load_and_checks(spark, place):
    root = place({"business.json": json.dumps(BUSINESSES)})
    raw = read_json_records(spark, f"{root}/business.json", RAW_BUSINESS)
    business.load_all(spark, root, raw, now=NOW)
    gold = {n: read_dataset(spark, root, n) for n in DATASETS if n.startswith("gold.b")}
    geography = read_dataset(spark, root, "gold.geography")
    assert {r.location_account for r in geography.collect()} == {"1", "3"}
    districts = gold["gold.business_by_district"].orderBy("council_district").collect()
    assert [
        (r.council_district, r.business_count, r.unique_categories) for r in districts
    ] == [(None, 1, 0), (9, 2, 1)]
    assert districts[1].ingestion_date == date(2024, 1, 31)
    checks = validation.validate_gold(
        gold["gold.business"], geography, gold["gold.business_by_district"]
    )
    assert checks["reconciliation"].first().status == "PASS"
    assert tuple(checks["geography"].first()) == (2, 1, 1, 2)
    assert tuple(checks["naics"].first()) == (3, 2, 2)
    assert [r[0] for r in checks["districts"].collect()] == [None, 9]
    assert {r.table_name: r.row_count for r in checks["row_counts"].collect()} == {
        "gold.business": 3,
        "gold.geography": 2,
        "gold.business_by_district": 2,
    }
    assert all(r.ok for r in checks["schema gold.business"].collect())


def test_pit_load(spark, place):
    text = "year,spa,population_type,count\n2020,1,adult,5\n2020,1,youth,2\n2021,2,adult,x\n"
    root = place({"pit.csv": text})
    pit.load_all(spark, root, f"{root}/pit.csv", "orc")
    out = read_dataset(spark, root, "gold.pit_metrics", "orc")
    assert as_set(out) == {(2020, "1", 7), (2021, "2", None)}


def test_pit_yearly(rows):
    raw = rows(
        "Year int, Unsheltered double, `Total Homeless` double, `none-set` int, "
        "Site struct<`Tent Count`:string, `Site-Number`:string>",
        (2020, 4.0, 10.0, None, ("3", "1")),
        (2020, 1.0, 10.0, None, (None, "12A")),
        (2021, 1.0, 30.0, None, ("1", "2")),
    )
    clean = pit.clean_totals(raw)
    assert dict(clean.dtypes)["site.tent_count"] == "bigint"
    assert dict(clean.dtypes)["site.site_number"] == "string"
    got = {
        r.year: (r["site.tent_count"], r.none_set, r.pct_unsheltered, r.pct_change_total)
        for r in pit.yearly_totals(clean).collect()
    }
    assert got == {2020: (3, 0, 0.25, None), 2021: (1, 0, 1 / 30, 0.5)}


@pytest.mark.parametrize("lines", [False, True])
def test_pit_totals_load(spark, place, lines):
    records = [
        {"Year": 2020, "Unsheltered": 4.0, "Total Homeless": 10.0, "Site": {"Tent Count": "3"}},
        {"Year": 2020, "Unsheltered": 1.0, "Total Homeless": 10.0, "none-set": None},
        {"Year": 2021, "Unsheltered": 1.0, "Total Homeless": 30.0, "Site": {"Tent Count": "1"}},
    ]
    text = "\n".join(map(json.dumps, records)) if lines else json.dumps(records, indent=2)
    root = place({"raw.json": text})
    for _ in range(2):  # a second load replaces the first
        paths = pit.load_totals(spark, root, f"{root}/raw.json")
    clean = read_path(spark, f"{root}/silver/pit_totals")
    assert clean.count() == 3 and dict(clean.dtypes)["site.tent_count"] == "bigint"
    yearly = read_path(spark, f"{root}/gold/pit_yearly")
    assert yearly.count() == read_path(spark, paths["gold.pit_yearly"]).count()
    assert as_set(
        yearly.select("year", "`site.tent_count`", "pct_unsheltered", "pct_change_total")
    ) == {(2020, 3, 0.25, None), (2021, 1, 1 / 30, 0.5)}
