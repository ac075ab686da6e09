import datetime as dt

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tractlake.functions.casts import clean_numeric_columns, lenient_double, money, strict_cast
from tractlake.functions.dates import iso_timestamp, lenient_timestamp, strict_date
from tractlake.functions.keys import collapsed_id, geoid, is_estimate_code, table_of
from tractlake.functions.reliability import with_reliability
from tractlake.functions.text import has_prefix_and_suffix, joined_or, strip

ESTIMATES = [
    ("1000", "164.5", 100.0, 10.0, "reliable"),
    ("1000", "197.4", 120.0, 12.0, "reliable"),
    ("1000", "329", 200.0, 20.0, "use with caution"),
    ("1000", "658", 400.0, 40.0, "use with caution"),
    ("1000", "1645", 1000.0, 100.0, "not reliable"),
    ("-1000", "164.5", 100.0, 10.0, "reliable"),
    ("0", "12", 12 / 1.645, None, "not applicable"),
    ("-", "12", 12 / 1.645, None, "not applicable"),
    ("NaN", "1", 1 / 1.645, None, "not applicable"),
    ("1000", None, None, None, "not applicable"),
    ("1000", "NaN", None, None, "not applicable"),
    (None, "3", 3 / 1.645, None, "not applicable"),
    ("-666666666", "-222222222", -222222222 / 1.645, 20.263, "use with caution"),
]


@pytest.mark.parametrize("estimate, moe, error, cv, grade", ESTIMATES)
def test_reliability(rows, estimate, moe, error, cv, grade):
    row = with_reliability(rows("estimate string, moe string", (estimate, moe))).first()
    assert row.standard_error == (error if error is None else pytest.approx(error))
    assert row.cv_pct == (cv if cv is None else pytest.approx(cv, abs=1e-3))
    assert row.reliability == grade


NUMBER_TEXT = st.one_of(
    st.none(),
    st.integers(-(10**12), 10**12).map(str),
    st.floats(-1e6, 1e6).map(repr),
    st.sampled_from(["-", "", "NaN", "nan", "0", "-0", "0.0", "N/A", "(X)", "1,000", "5+", " 7 "]),
)


@settings(
    max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(st.lists(st.tuples(NUMBER_TEXT, NUMBER_TEXT), min_size=1, max_size=40))
def test_reliability_equals_a_row_by_row_computation(spark, pairs):
    def number(text):
        value = pd.to_numeric(pd.Series([text], dtype=object), errors="coerce")[0]
        return None if pd.isna(value) else float(value)

    def expected(estimate, moe):
        e, m = number(estimate), number(moe)
        error = None if m is None else m / 1.645
        cv = None if error is None or not e else abs(error / e) * 100
        name = "not applicable" if cv is None else next(
            (n for n, limit in (("reliable", 12), ("use with caution", 40)) if cv <= limit),
            "not reliable",
        )
        return (e, m, error, cv, name)

    df = spark.createDataFrame(
        [(i, *pair) for i, pair in enumerate(pairs)], "i int, estimate string, moe string"
    )
    out = with_reliability(df).orderBy("i").drop("i").collect()
    # pandas may miss the nearest double by one place when it parses long decimals.
    for row, pair in zip(out, pairs, strict=True):
        *numbers, name = expected(*pair)
        assert row.reliability == name
        for got, wanted in zip(row[:-1], numbers, strict=True):
            assert got == (wanted if wanted is None else pytest.approx(wanted, rel=1e-12))


def test_thresholds_are_inclusive(rows):
    row = with_reliability(rows("estimate string, moe string", ("1000", "197.4"))).first()
    assert row.cv_pct == 12.0


def test_sentinels_can_be_nulled(rows):
    df = rows("estimate string, moe string", ("-666666666", "-222222222"), ("5", "1"))
    out = with_reliability(df, null_sentinels=True).collect()
    assert [(r.estimate, r.reliability) for r in out] == [
        (None, "not applicable"),
        (5.0, "reliable" if out[1].cv_pct <= 12 else "use with caution"),
    ]


@pytest.mark.parametrize(
    "text, number",
    [
        ("12", 12.0),
        (" 12 ", 12.0),
        ("+1.5e3", 1500.0),
        (".5", 0.5),
        ("5.", 5.0),
        ("inf", float("inf")),
        ("-Infinity", float("-inf")),
        ("1d", None),
        ("2f", None),
        ("0x1p3", None),
        ("1_000", None),
        ("nan", None),
        ("NaN", None),
        ("-", None),
        ("", None),
        (None, None),
    ],
)
def test_lenient_double(rows, text, number):
    assert rows("x string", (text,)).select(lenient_double("x")).first()[0] == number


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_strict_cast_does_not_depend_on_ansi(spark, rows, ansi):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        good = rows("x string", ("1.5",), (None,)).select(strict_cast("x", "double"))
        assert [r[0] for r in good.collect()] == [1.5, None]
        with pytest.raises(PySparkException, match="abc"):
            rows("x string", ("abc",)).select(strict_cast("x", "double")).collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def test_money(rows):
    df = rows("x string", ("$1,234.50",), (None,), ("7",), ("-$3",))
    assert [r[0] for r in df.select(money("x")).collect()] == [1234.5, None, 7.0, -3.0]
    with pytest.raises(PySparkException):
        rows("x string", ("n/a",)).select(money("x")).collect()


def test_strict_date(rows):
    df = rows("x string", ("01/05/2024",), ("1/5/2024",), ("01/05/24",), (None,))
    assert [r[0] for r in df.select(strict_date("x")).collect()] == [
        dt.datetime(2024, 1, 5),
        dt.datetime(2024, 1, 5),
        dt.datetime(24, 1, 5),
        None,
    ]
    with pytest.raises(PySparkException, match="2024-01-05"):
        rows("x string", ("2024-01-05",)).select(strict_date("x")).collect()


def test_lenient_timestamp(rows):
    df = rows(
        "x string", ("2015-01-01T00:00:00.000",), ("3/4/2020",), ("2024-02-03",), ("n/a",), (None,)
    )
    assert [r[0] for r in df.select(lenient_timestamp("x")).collect()] == [
        dt.datetime(2015, 1, 1),
        dt.datetime(2020, 3, 4),
        dt.datetime(2024, 2, 3),
        None,
        None,
    ]


def test_iso_timestamp(rows):
    df = rows("x string", ("2015-01-01T02:30:00.000",), ("x",))
    assert [r[0] for r in df.select(iso_timestamp("x")).collect()] == [
        dt.datetime(2015, 1, 1, 2, 30),
        None,
    ]


def test_numeric_columns_are_cast_wholly_or_not_at_all(rows):
    df = rows(
        "tent_count string, mean_count string, site_number string, big_number string, name string",
        ("1", "1.5", "12", "1", "5"),
        (None, "2", "12A", "99999999999999999999", "6"),
    )
    out = clean_numeric_columns(df)
    assert [f.dataType.simpleString() for f in out.schema] == [
        "bigint",
        "double",
        "string",
        "double",
        "string",
    ]
    assert [r.tent_count for r in out.collect()] == [1, None]


def test_codes(rows):
    df = rows("state string, county string, tract string", ("06", None, "000100"))
    assert df.select(geoid("state", "county", "tract")).first()[0] == "06000100"
    codes = rows("c string", ("B19013_001E",), ("B19013_001M",), ("NAME",), ("B19013_001EA",))
    out = codes.select(is_estimate_code("c"), table_of("c"), collapsed_id("c")).collect()
    assert [r[0] for r in out] == [True, False, False, False]
    assert out[0][1] == "B19013"
    assert out[0][2] == "C19013_001E"


def test_text(rows):
    assert rows("x string", ("\t a b \r\n",)).select(strip("x")).first()[0] == "a b"
    lists = rows("x array<string>", (["b", "a"],), ([],), (None,))
    assert [r[0] for r in lists.select(joined_or(F.col("x"))).collect()] == ["a, b", "none", "none"]
    names = rows("x string, p string", ("B1_2E", "B1_"), ("B12_E", "B1_"))
    out = names.select(has_prefix_and_suffix("x", F.col("p"), "E")).collect()
    assert [r[0] for r in out] == [True, False]


@pytest.mark.parametrize("text", ["12d", "5f", "0x1p3", "1_0", ""])
def test_strict_numbers_take_no_java_suffixes(rows, text):
    with pytest.raises(Exception, match="cannot cast"):
        rows("a string", (text,)).select(strict_cast("a", "double")).collect()
    with pytest.raises(Exception, match="cannot cast"):
        rows("a string", (f"${text}",)).select(money("a")).collect()


def test_more_lenient_dates(rows):
    texts = ["01/05/2024 12:00:00 AM", "1/5/2024 13:45", "January 5, 2024", "05-Jan-2024", "1/5/2024 1:45 PM"]
    out = rows("a string", *[(t,) for t in texts]).select(lenient_timestamp("a")).collect()
    assert [str(r[0]) for r in out] == [
        "2024-01-05 00:00:00", "2024-01-05 13:45:00", "2024-01-05 00:00:00", "2024-01-05 00:00:00", "2024-01-05 13:45:00",
    ]
