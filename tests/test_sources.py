import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tractlake.operators.quality import layer_counts
from tractlake.operators.reshape import melt_payloads, melt_records
from tractlake.schemas import PIT_SPEC, RAW_BUSINESS, schema_from_spec
from tractlake.sources.census import (
    payload_records,
    read_payloads,
    read_variable_labels,
    rejected_payloads,
    rejected_rows,
    rejects,
)
from tractlake.sources.files import (
    read_delimited,
    read_json_lines,
    read_json_pages,
    read_json_records,
    read_table_config,
)
from tractlake.sinks.writers import write_snapshot
from tractlake.sources.snapshots import find_latest_snapshot, latest_snapshot, read_latest_json

FIRST = [
    ["NAME", "B19013_001E", "B19013_001M", "state", "county", "tract"],
    ["Census Tract 1", "50000", "3000", "06", "037", "000100"],
    ["Census Tract 2", None, "10", "06", "037", "000200"],
    ["Census Tract 3", "0", "12", "06", "037", "000300"],
    ["Census Tract 4", "-666666666", "-222222222", "06", "037", "000400"],
]
NO_MARGIN = [["B19013_002E", "state", "county", "tract"], ["7", "06", "037", "000100"]]
RAGGED = [["NAME", "B25064_001E"], ["only one"], ["T", "1"], ["T", "1", "2"], None]
REPEATED = [["NAME", "NAME"], ["a", "b"]]
RECORD = schema_from_spec([{"name": "a", "type": "string"}, {"name": "b", "type": "int"}])


@pytest.fixture
def payloads(spark, place):
    files = {
        f"{i}.json": json.dumps(p, indent=i or None)
        for i, p in enumerate((FIRST, NO_MARGIN, RAGGED, REPEATED))
    }
    files["empty.json"] = "[]"
    files["bad.json"] = '{"error": "no key"}'
    return read_payloads(spark, place(files))


def test_payload_records(payloads):
    records = [r.record for r in payload_records(payloads).collect()]
    assert len(records) == 6
    assert {"NAME": "T", "B25064_001E": "1"} in records
    assert dict(zip(FIRST[0], FIRST[2], strict=True)) in records


def test_rejects_are_kept_whole(payloads):
    assert sorted(len(r.row) for r in rejected_rows(payloads).collect()) == [1, 2, 3]
    assert sorted(r.value for r in rejected_payloads(payloads).collect()) == [
        "[]",
        '{"error": "no key"}',
    ]


def test_melt(payloads):
    by_position = sorted(map(tuple, melt_payloads(payloads).collect()), key=str)
    columns = melt_payloads(payloads).columns
    by_name = melt_records(payload_records(payloads)).select(*columns)
    assert by_position == sorted(map(tuple, by_name.collect()), key=str)
    rows = {(r.variable, r.tract_fips): r for r in melt_payloads(payloads).collect()}
    assert len(rows) == 6
    first = rows["B19013_001", "06037000100"]
    assert (first.table_id, first.tract_name) == ("B19013", "Census Tract 1")
    assert (first.estimate, first.moe) == ("50000", "3000")
    assert rows["B19013_001", "06037000200"].estimate is None
    assert rows["B19013_002", "06037000100"].moe is None
    assert rows["B19013_002", "06037000100"].tract_name == ""
    assert rows["B25064_001", ""].estimate == "1"


def test_payloads_one_per_line_equal_whole_files(spark, place, payloads):
    lines = place({"lines/all.txt": "\n".join(json.dumps(p) for p in (FIRST, NO_MARGIN, RAGGED))})
    whole = melt_payloads(payloads)
    by_line = melt_payloads(read_payloads(spark, f"{lines}/lines", whole_files=False))
    assert whole.exceptAll(by_line).count() == by_line.exceptAll(whole).count() == 0


def test_text_is_parsed_once(payloads, capsys):
    melt_payloads(payloads).explain()
    assert capsys.readouterr().out.count("from_json") == 1
    rejects(payloads).explain()
    plan = capsys.readouterr().out
    assert plan.count("from_json") == plan.count("FileScan") == 1


def test_rejects_name_their_reason(spark, place):
    texts = [
        '[["NAME","tract"],["a","1"],["b"],["c","3","4"],null]',
        '[["NAME","tract"]]',
        '[null,["d"]]',
        "[]",
        "oops",
    ]
    path = place({f"{i}.json": text for i, text in enumerate(texts)})
    found = sorted(map(tuple, rejects(read_payloads(spark, path)).collect()))
    assert found == [
        ("response without a header", "[]"),
        ("response without a header", "oops"),
        ("row does not fit its header", '{"header":["NAME","tract"],"row":["b"]}'),
        ("row does not fit its header", '{"header":["NAME","tract"],"row":["c","3","4"]}'),
        ("row does not fit its header", '{"row":["d"]}'),
    ]


def test_variable_labels(spark, place):
    payload = {
        "variables": {
            "B19013_001E": {"label": "Estimate!!Median income"},
            "B19013_001M": {"label": "Margin"},
            "B19013_002E": {},
            "C19013_001E": {"label": "collapsed"},
            "NAME": {"label": "Geography"},
        }
    }
    out = read_variable_labels(spark, place({"variables.json": json.dumps(payload, indent=2)}))
    assert sorted(map(tuple, out.collect())) == [
        ("B19013", "B19013_001", "Estimate!!Median income"),
        ("B19013", "B19013_002", ""),
        ("C19013", "C19013_001", "collapsed"),
    ]


def test_table_config(spark, place):
    text = "table_id\tseries\nB19013\tIncome\n B25064 \tHousing\nB99999\tNone, such\n"
    out = read_table_config(spark, place({"config.csv": text}))
    assert list(map(tuple, out.collect())) == [
        ("B19013", "Income"),
        ("B25064", "Housing"),
        ("B99999", "None, such"),
    ]


@pytest.mark.parametrize("whole_files", [True, False])
def test_json_pages(spark, place, whole_files):
    root = place(
        {
            "p1.json": '[{"a": "x", "b": 1}, {"a": null}]',
            "p2.json": "[]",
            "p3.json": ' \n[{"b": 3}]' if whole_files else '[{"b": 3}]\n\n[]',
        }
    )
    out = read_json_pages(spark, root, RECORD, whole_files)
    assert {tuple(r) for r in out.collect()} == {(None, 3), (None, None), ("x", 1)}
    assert out.count() == 3


def test_page_that_is_no_list_ends_the_run(spark, place):
    root = place({"p1.json": '[{"a": "x"}]', "p2.json": '{"error": true}'})
    with pytest.raises(PySparkException, match="expected a JSON list"):
        read_json_pages(spark, root, RECORD).collect()


def test_broken_page_ends_the_run(spark, place):
    with pytest.raises(Exception, match="Malformed records"):
        read_json_pages(spark, place({"p.json": '[{"a": "x"'}), RECORD).collect()


def test_json_records_keep_nested_objects(spark, place):
    data = [
        {"location_account": "1", "location_1": {"latitude": "34.1", "longitude": "-118.2"}},
        {"location_account": "2"},
    ]
    root = place({"business.json": json.dumps(data, indent=2)})
    out = read_json_records(spark, root, RAW_BUSINESS)
    assert [r[0] for r in out.select("location_1.latitude").collect()] == ["34.1", None]
    inferred = read_json_records(spark, root)
    assert set(inferred.columns) == {"location_account", "location_1"}


def test_json_lines_take_records_and_arrays(spark, place):
    root = place({"a.json": '{"a": "x", "b": 1}\n[{"a": "y", "b": 2}, {"a": "z"}]\n'})
    out = read_json_lines(spark, root, RECORD)
    assert sorted(map(tuple, out.collect()), key=str) == [("x", 1), ("y", 2), ("z", None)]


def test_the_first_line_tells_how_records_are_written(spark, place):
    """A file with a record per line gives all of its records."""
    records = [{"a": str(i), "b": i} for i in range(100)]
    root = place(
        {
            "lines/20240101.json": "\n" + "\n".join(map(json.dumps, records)),
            "array/20240101.json": json.dumps(records, indent=1),
            "one/20240101.json": json.dumps(records),
            "record/20240101.json": json.dumps(records[0], indent=1),
            "blank/20240101.json": "\n",
        }
    )
    counts = {n: read_latest_json(spark, f"{root}/{n}", RECORD).count() for n in ("lines", "array", "one", "record", "blank")}
    assert counts == {"lines": 100, "array": 100, "one": 100, "record": 1, "blank": 0}


def test_typed_csv(spark, place):
    text = "year,spa,population_type,count\n2020,1,adult,5\n2021,2,youth,x\n"
    out = read_delimited(spark, place({"pit.csv": text}), schema_from_spec(PIT_SPEC))
    assert list(map(tuple, out.collect())) == [(2020, "1", "adult", 5), (2021, "2", "youth", None)]


def test_unknown_type_in_a_spec():
    with pytest.raises(ValueError, match="money"):
        schema_from_spec([{"name": "a", "type": "money"}])


def test_latest_snapshot(spark, place):
    root = place(
        {
            "raw/x_20240101_000000.json": '[{"a": "1"}, {"a": "2"}]',
            "raw/x_20240102_000000.json": '[{"a": "3"}]',
            "raw/zzz.txt": "no snapshot",
            "empty/readme.txt": "nothing",
        }
    )
    assert latest_snapshot(spark, f"{root}/raw").endswith("x_20240102_000000.json")
    assert [r.a for r in read_latest_json(spark, f"{root}/raw", RECORD).collect()] == ["3"]
    assert find_latest_snapshot(spark, f"{root}/empty") is None
    assert find_latest_snapshot(spark, f"{root}/absent") is None
    with pytest.raises(FileNotFoundError):
        latest_snapshot(spark, f"{root}/empty")


def test_layer_counts(spark, place):
    root = place(
        {
            "raw/x_1.json": '[{"a": "1"}, {"a": "2"}]',
            "raw/x_2.json": '[\n  {"a": "3"}\n]',
            "empty/readme.txt": "nothing",
        }
    )
    write_snapshot(spark.range(5), f"{root}/silver", "parquet")
    out = layer_counts(
        spark,
        {
            "bronze": (f"{root}/raw", "*.json", "json"),
            "silver": (f"{root}/silver", "*.parquet", "parquet"),
            "gold": (f"{root}/empty", "*.parquet", "parquet"),
        },
    )
    assert {r.layer: r.records for r in out.collect()} == {"bronze": 1, "silver": 5, "gold": 0}


def test_columns_and_filters_reach_the_scan(spark, tmp_path, capsys):
    spark.range(10).select("id", (F.col("id") * 2).alias("x"), F.lit("s").alias("s")).write.parquet(
        str(tmp_path / "t")
    )
    spark.read.parquet(str(tmp_path / "t")).filter("x > 4").select("x").explain()
    plan = capsys.readouterr().out
    assert "ReadSchema: struct<x:bigint>" in plan
    assert "GreaterThan(x,4)" in plan


def test_delimited_columns_go_by_name(spark, place):
    spec = schema_from_spec([{"name": "a", "type": "int"}, {"name": "b", "type": "string"}])
    root = place({"x.csv": "b,other,A\nq,1,5\nr,2,x\n", "y.csv": "b\nq\n"})
    assert [tuple(r) for r in read_delimited(spark, f"{root}/x.csv", spec).collect()] == [(5, "q"), (None, "r")]
    with pytest.raises(ValueError, match="no column a"):
        read_delimited(spark, f"{root}/y.csv", spec)
