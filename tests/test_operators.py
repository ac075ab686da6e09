import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tractlake.functions.reliability import GRADES, with_reliability
from tractlake.operators.aggregates import category_counts, metric_table, sum_numeric_by
from tractlake.operators.columns import (
    cast_by_name,
    drop_columns,
    flatten,
    normalize_names,
    rename,
    snake_case,
    snake_case_no_dollar,
    trimmed_lower,
)
from tractlake.operators.dedup import concat_tables, first_per_key, keep_first, keep_latest
from tractlake.operators.joins import coverage, left_lookup, star_join, with_match
from tractlake.operators.quality import (
    EmptyInputError,
    coverage_counts,
    duplicate_report,
    filter_with_dropped,
    ingest_summary,
    load_status,
    profile,
    reconcile,
    require_rows,
    schema_report,
)
from tractlake.operators.reshape import melt_pairs
from tractlake.operators.windows import ratio, with_change

FEW = settings(
    max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)


def test_name_rules():
    assert trimmed_lower(" City ") == "city"
    assert snake_case("Site-Number X") == "site_number_x"
    assert snake_case_no_dollar("Total-Amount$") == "total_amount"


def test_colliding_names_are_an_error(rows):
    with pytest.raises(ValueError, match="a_b"):
        normalize_names(rows("`A B` int, `a-b` int", (1, 2)))


def test_rename_and_drop_ignore_absent_names(rows):
    df = rows("a int, `@computed_region_x` int, b int", (1, 2, 3))
    out = drop_columns(rename(df, {"a": "z", "nope": "y"}), ["nope"], ["@computed_region_"])
    assert out.columns == ["z", "b"]


def test_flatten_keeps_arrays(rows):
    schema = "id int, place struct<lat:double, at:struct<zip:string>>, tags array<string>"
    out = flatten(rows(schema, (1, (2.0, ("90001",)), ["x"])))
    assert out.columns == ["id", "place.lat", "place.at.zip", "tags"]
    assert out.first()[2] == "90001"


def test_cast_by_name_date_wins_over_money(rows):
    out = cast_by_name(rows("cost_date string, cost string", ("2024-01-01", "$2")))
    assert [f.dataType.simpleString() for f in out.schema] == ["timestamp_ntz", "double"]


def test_melt_pairs(rows):
    out = melt_pairs(
        rows("id int, aE double, aM double, bE int, bM int", (1, 2.0, 3.0, 4, None)),
        ["id"],
        {"a": ("aE", "aM"), "b": ("bE", "bM")},
    )
    assert [tuple(r) for r in out.collect()] == [(1, "a", 2.0, 3.0), (1, "b", 4.0, None)]


def test_keep_latest_groups_null_keys_and_breaks_ties(rows):
    df = rows(
        "k1 string, k2 string, t int, v string",
        ("a", None, 1, "x"),
        ("a", None, 1, "y"),
        ("b", "c", 1, "old"),
        ("b", "c", 2, "new"),
        (None, None, None, None),
    )
    out = {(r.k1, r.k2): (r.v, r.rn) for r in keep_latest(df, ["k1", "k2"], "t").collect()}
    assert out == {("a", None): ("y", 1), ("b", "c"): ("new", 1), (None, None): (None, 1)}


@FEW
@given(
    st.lists(
        st.tuples(
            st.one_of(st.none(), st.integers(0, 3)), st.integers(0, 3), st.text("ab", max_size=2)
        ),
        max_size=30,
    )
)
def test_keep_first_does_not_depend_on_row_order(spark, data):
    def kept(items):
        df = spark.createDataFrame(items, "k int, t int, v string")
        return {r.k: (r.t, r.v) for r in keep_first(df, ["k"], [F.col("t").asc()]).collect()}

    expected = {}
    for k, t, v in sorted(data, key=lambda r: (r[1], [-ord(c) for c in r[2].ljust(2, "\0")])):
        expected.setdefault(k, (t, v))
    assert kept(data) == kept(list(reversed(data))) == expected


def test_one_hot_key_sends_one_row_per_task(spark, capsys):
    df = spark.range(0, 100_000, numPartitions=8).select(
        F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"), F.col("id").alias("v")
    )
    out = first_per_key(df, ["k"])
    assert out.count() == df.select("k").distinct().count()
    capsys.readouterr()
    out.explain()
    assert capsys.readouterr().out.count("WindowGroupLimit") >= 2


def test_nearly_unique_keys_are_sorted_once(spark, capsys):
    df = spark.range(0, 10_000, numPartitions=8).select(
        F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"), F.col("id").alias("v")
    )
    out = first_per_key(df, ["k"], nearly_unique=True)
    capsys.readouterr()
    out.explain()  # before it runs: later, the first plan is printed along with the final one
    plan = capsys.readouterr().out
    assert plan.count(" Sort ") == 1 and plan.count("Exchange hashpartitioning") == 1
    assert sorted(out.collect()) == sorted(first_per_key(df, ["k"]).collect())


def test_concat_fills_missing_columns(rows):
    out = concat_tables(rows("a int, b int", (1, 2)), rows("b int, c int", (3, 4)))
    assert sorted(tuple(r) for r in out.collect() if r.a is not None) == [(1, 2, None)]
    assert [tuple(r) for r in out.collect() if r.a is None] == [(None, 3, 4)]


@pytest.mark.parametrize("salts", [1, 7])
def test_left_lookup(rows, salts):
    left = rows("k string, n int", ("a", 1), ("a", 2), ("b", 3), (None, 4))
    right = rows("k string, label string", ("a", "A"), ("c", "C"))
    out = left_lookup(left, right, "k", {"label": ""}, salts)
    assert out.columns == ["k", "n", "label"]
    assert sorted((r.n, r.label) for r in out.collect()) == [(1, "A"), (2, "A"), (3, ""), (4, "")]


def test_hot_key_is_split_without_salts(spark, capsys):
    """Adaptive execution splits the hot partition of a join too large to broadcast."""
    settings_ = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {key: spark.conf.get(key, None) for key in settings_}
    for key, value in settings_.items():
        spark.conf.set(key, value)
    try:
        ids = spark.range(0, 200_000, numPartitions=8)
        hot = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 1000)
        left = ids.select(hot.alias("k"), F.col("id").alias("v"))
        right = spark.range(1000).select(F.col("id").alias("k"), F.lit("x").alias("label"))
        joined = left_lookup(left, right, "k")
        assert len(joined.collect()) == 200_000
        capsys.readouterr()
        joined.explain()
        assert "skew=true" in capsys.readouterr().out
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_star_join_keeps_unmatched_facts(rows):
    fact = rows("v string, t string, x int", ("v1", "t1", 1), ("v2", "t9", 2))
    dims = {
        "v": rows("v string, label string", ("v1", "L")),
        "t": rows("t string, name string", ("t1", "N")),
    }
    out = {r.x: (r.label, r.name) for r in star_join(fact, dims).collect()}
    assert out == {1: ("L", "N"), 2: (None, None)}


def test_with_match_collapses_the_right_side_first(rows):
    left = rows("k int", (1,), (2,), (None,))
    right = rows("r int", (1,), (1,), (1,), (None,))
    assert [r.k for r in with_match(left, right, "k", "r").collect()] == [1]


KEYS = st.lists(st.one_of(st.none(), st.integers(0, 6)), max_size=20)


@FEW
@given(KEYS, KEYS)
def test_coverage_is_the_set_difference_both_ways(spark, wanted, landed):
    a = spark.createDataFrame([(k,) for k in wanted], "k int")
    b = spark.createDataFrame([(k,) for k in landed], "k int")
    found = {(r.k, r.status) for r in coverage(a, b, ["k"]).collect()}
    assert found == {(k, "missing") for k in set(wanted) - set(landed)} | {
        (k, "extra") for k in set(landed) - set(wanted)
    }
    totals = coverage_counts(a, b, ["k"]).first()
    assert tuple(totals) == (
        len(set(wanted)),
        len(set(landed)),
        len(set(wanted) - set(landed)),
        len(set(landed) - set(wanted)),
    )


def test_category_counts_fill_zero(rows):
    out = category_counts(rows("g string", ("reliable",), ("odd",), (None,)), "g", GRADES)
    assert {r.g: r.row_count for r in out.collect()} == {
        "reliable": 1,
        "use with caution": 0,
        "not reliable": 0,
        "not applicable": 0,
    }


def test_counts_of_grades_sum_to_rows(rows):
    graded = with_reliability(
        rows("estimate string, moe string", ("1", "1"), ("-", "2"), ("1000", "1"), ("9", "2"))
    )
    counts = category_counts(graded, "reliability", GRADES)
    assert sum(r.row_count for r in counts.collect()) == graded.count()


def test_sum_numeric_by(rows):
    df = rows(
        "year int, a int, b double, c double, s string",
        (2020, 1, None, None, "x"),
        (2020, 2, 1.5, None, "y"),
        (None, 5, 1.0, 2.0, "z"),
    )
    out = {r.year: (r.a, r.b, r.c) for r in sum_numeric_by(df, ["year"]).collect()}
    assert out == {2020: (3, 1.5, 0.0), None: (5, 1.0, 2.0)}
    assert "s" not in sum_numeric_by(df, ["year"]).columns


def test_metric_table(rows):
    df = rows("year int, spa string, count int", (2020, "1", 3), (2020, "1", 4), (2021, "1", None))
    spec = {"group_by": ["year", "spa"], "aggregation": {"count": "sum"}}
    out = metric_table(df, "total_count", spec)
    assert dict(out.dtypes)["total_count"] == "bigint"
    assert {r.year: r.total_count for r in out.collect()} == {2020: 7, 2021: None}
    with pytest.raises(ValueError, match="drop"):
        metric_table(df, "m", {"group_by": [], "aggregation": {"count": "drop"}})


def test_change_and_ratio(rows):
    df = rows("year int, part double, total double", (2022, 1.0, 0.0), (2020, 5.0, 10.0), (2021, 6.0, 15.0))
    out = with_change(df.withColumn("share", ratio("part", "total")), "total", "year", "change")
    got = {r.year: (r.share, r.change) for r in out.collect()}
    assert got == {2020: (0.5, None), 2021: (0.4, 0.5), 2022: (None, -1.0)}


def test_duplicate_report(rows):
    df = rows("a int, b int", (1, 1), (1, 1), (1, None), (1, None), (2, 1))
    out = duplicate_report(df, ["a", "b"]).first()
    assert tuple(out) == (5, 3, 2)
    assert out.distinct_keys + out.duplicate_rows == out.total_rows
    assert tuple(duplicate_report(df.filter("a > 9"), ["a"]).first()) == (0, 0, 0)


def test_profile_counts_null_as_a_value(rows):
    df = rows("x int, y int", (1, 1), (1, None), (None, None), (None, None))
    assert tuple(profile(df, ["x", "y"], ["x"]).first()) == (4, 2, 3, 2)
    assert profile(df, [], ["x", "y"]).first().distinct_count == 3


def test_reconcile(rows):
    detail = rows("x int", (1,), (2,), (3,))
    good = rows("n bigint", (1,), (2,))
    assert tuple(reconcile(detail, good, "n").first()) == (3, 3, "PASS")
    assert reconcile(detail, rows("n bigint", (1,)), "n").first().status == "FAIL"
    assert tuple(reconcile(detail, good.filter("n > 9"), "n").first()) == (3, 0, "FAIL")


def test_schema_report(rows):
    expected = T.StructType(
        [T.StructField("a", T.IntegerType()), T.StructField("c", T.StringType())]
    )
    out = schema_report(rows("a int, b string", (1, None), (None, None)), expected)
    assert {tuple(r) for r in out.collect()} == {
        ("a", "int", "int", True, 1),
        ("b", None, "string", False, 2),
        ("c", "string", None, False, None),
    }


def test_ingest_summary(rows):
    config = rows("table_id string", ("B1",), ("B2",), ("B3",), ("B4",))
    described = rows("table_id string", ("B1",), ("B2",), ("B4",), ("C1",))
    landed = rows("table_id string", ("B1",), ("B1",), ("C1",))
    out = ingest_summary(config, described, landed).first()
    assert tuple(out) == (4, 1, 1, 2, "B2, B4")
    status = {tuple(r) for r in load_status(config, described, landed).collect()}
    assert status == {("B1", "landed"), ("B2", "failed"), ("B3", "empty"), ("B4", "failed")}
    everything = ingest_summary(config, described, config).first()
    assert everything.failed_ids == "none"


def test_filter_with_dropped(rows):
    kept, counts = filter_with_dropped(rows("x double", (0.0,), (None,), (2.0,)), "x")
    assert kept.count() == 2
    assert tuple(counts.first()) == (2, 1)


def test_require_rows(rows):
    df = rows("x int", (1,))
    assert require_rows(df, "x") is df
    with pytest.raises(EmptyInputError, match="variables"):
        require_rows(df.filter("x > 1"), "variables")


def test_sums_skip_nan(rows):
    df = rows("k int, a double, b int", (1, 1.0, 1), (1, float("nan"), 2), (2, float("nan"), None))
    assert {tuple(r) for r in sum_numeric_by(df, ["k"]).collect()} == {(1, 1.0, 3), (2, 0.0, 0)}
