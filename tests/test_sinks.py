import uuid
from datetime import datetime, timezone

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tractlake.schemas import DIM_TRACT
from tractlake.sinks.writers import (
    append_rows,
    conform,
    ensure_namespace,
    ensure_table,
    replace_partitions,
    replace_path,
    replace_table,
    write_dataset,
    write_snapshot,
    write_with_metrics,
)
from tractlake.sinks.commits import (
    commit_version,
    commits,
    expire_versions,
    observed_write,
    run_metrics,
    standing_commits,
)
from tractlake.sources.files import read_dataset, read_path, read_table
from tractlake.sources.snapshots import latest_snapshot
from tractlake.workspace import fresh_dir, shared_root

ONE = ("06037000100", "Tract 1")
TWO = ("06037000200", "Tract 2")


@pytest.fixture
def table(spark, tmp_path):
    namespace = f"ns_{uuid.uuid4().hex[:8]}"
    ensure_namespace(spark, namespace, str(tmp_path / namespace))
    ensure_namespace(spark, namespace)
    return f"{namespace}.dim_tract"


def test_append_enforces_the_schema(spark, rows, table):
    ensure_table(spark, table, DIM_TRACT)
    ensure_table(spark, table, DIM_TRACT)
    swapped = rows("tract_name string, tract_fips string", (ONE[1], ONE[0]))
    assert append_rows(swapped, table, DIM_TRACT) == 1
    assert append_rows(swapped.limit(0), table, DIM_TRACT) == 0
    assert list(map(tuple, read_table(spark, table).collect())) == [ONE]
    with pytest.raises(ValueError, match="other"):
        append_rows(swapped.withColumn("other", F.lit(1)), table, DIM_TRACT)
    with pytest.raises(PySparkException):
        append_rows(rows("tract_fips array<int>, tract_name string", ([1], "x")), table, DIM_TRACT)


def test_conform_fills_absent_nullable_columns(rows):
    assert tuple(conform(rows("tract_name string", ("x",)), DIM_TRACT).first()) == (None, "x")


def test_replace_table_twice_gives_the_same_table(spark, rows, table):
    for _ in range(2):
        replace_table(rows(DIM_TRACT, ONE, TWO), table)
    assert read_table(spark, table, ["tract_fips"]).columns == ["tract_fips"]
    assert read_table(spark, table).count() == 2


def test_replace_path_is_static_even_under_dynamic_overwrite(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        replace_path(rows("p int, x int", (1, 1), (2, 2)), path, partition_by=["p"])
        replace_path(rows("p int, x int", (2, 3)), path, partition_by=["p"])
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)
    assert [(r.p, r.x) for r in read_path(spark, path).collect()] == [(2, 3)]


def test_a_failed_load_leaves_the_old_rows(spark, rows, table, tmp_path):
    path = str(tmp_path / "t")
    good = rows(DIM_TRACT, ONE, TWO)
    broken = good.withColumn(
        "tract_name", F.when(F.col("tract_name") == ONE[1], F.raise_error(F.lit("broken"))).cast("string")
    )
    replace_table(good, table)
    replace_path(good, path)
    for load in (lambda: replace_table(broken, table), lambda: replace_path(broken, path)):
        with pytest.raises(PySparkException, match="broken"):
            load()
    assert read_table(spark, table).count() == read_path(spark, path).count() == 2
    assert [t.name for t in spark.catalog.listTables() if t.name.startswith("staged_")] == []


def test_an_empty_snapshot_is_not_written(spark, rows, tmp_path):
    df = rows("a string", ("x",))
    write_snapshot(df, str(tmp_path), "parquet", datetime(2024, 1, 1))
    assert write_snapshot(df.filter("a = 'y'"), str(tmp_path), "parquet", datetime(2024, 1, 2)) is None
    assert latest_snapshot(spark, str(tmp_path), "*.parquet").endswith("snapshot=20240101_000000")


def test_replace_partitions_leaves_the_others(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    replace_partitions(rows("p int, x int", (1, 1), (2, 2)), path, ["p"])
    replace_partitions(rows("p int, x int", (2, 3)), path, ["p"])
    assert sorted((r.p, r.x) for r in spark.read.parquet(path).collect()) == [(1, 1), (2, 3)]


def test_datasets_are_read_where_they_are_written(spark, rows, tmp_path):
    write_dataset(rows(DIM_TRACT, ONE), str(tmp_path), "gold.dim_tract", "orc")
    assert tuple(read_dataset(spark, str(tmp_path), "gold.dim_tract", "orc").first()) == ONE


def test_snapshots_sort_by_time(spark, rows, tmp_path):
    df = rows("a string", ("x",))
    for day in (2, 1):
        write_snapshot(df, str(tmp_path), "json", datetime(2024, 1, day, tzinfo=timezone.utc))
    assert latest_snapshot(spark, str(tmp_path)).endswith("snapshot=20240102_000000")
    nothing = df.filter("a = 'y'")
    assert write_snapshot(nothing, str(tmp_path), "json", datetime(2024, 1, 3)) is None
    assert latest_snapshot(spark, str(tmp_path)).endswith("snapshot=20240102_000000")


def test_json_snapshots_are_compressed_and_read_back_whole(spark, rows, tmp_path):
    from pathlib import Path

    from tractlake.sources.snapshots import read_latest_json

    df = rows("a string, b long", *[(f"text {i}", i) for i in range(200)])
    path = write_snapshot(df, str(tmp_path), "json", datetime(2024, 1, 1, tzinfo=timezone.utc))
    parts = [p.name for p in Path(path).glob("part-*")]
    assert parts and all(name.endswith(".json.gz") for name in parts)
    back = read_latest_json(spark, str(tmp_path), df.schema)
    assert sorted(back.collect()) == sorted(df.collect())

def test_json_snapshot_files_hold_a_bounded_number_of_records(spark, tmp_path):
    from pathlib import Path

    from tractlake.sinks.writers import JSON_RECORDS_PER_FILE
    from tractlake.sources.snapshots import read_latest_json

    df = spark.range(0, JSON_RECORDS_PER_FILE + 10, numPartitions=1)
    path = write_snapshot(df, str(tmp_path), "json", datetime(2024, 1, 1, tzinfo=timezone.utc))
    parts = sorted(str(p) for p in Path(path).glob("part-*.json.gz"))
    assert len(parts) == 2
    per_file = spark.read.json(parts).groupBy(F.input_file_name()).count().collect()
    assert max(row["count"] for row in per_file) <= JSON_RECORDS_PER_FILE
    back = read_latest_json(spark, str(tmp_path), df.schema)
    assert back.count() == JSON_RECORDS_PER_FILE + 10
    assert back.agg(F.sum("id")).first()[0] == df.agg(F.sum("id")).first()[0]


def test_metrics_come_with_the_write(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    metrics = {"rows": F.count("*"), "dropped": F.count_if(F.col("x").isNull())}
    assert write_with_metrics(rows("x int", (1,), (None,), (3,)), path, metrics) == {
        "rows": 3,
        "dropped": 1,
    }
    assert read_path(spark, path).count() == 3
    runs = run_metrics(spark, {"t": path, "none": str(tmp_path / "none")}).collect()
    assert [(r.source, r.records, r.metrics) for r in runs] == [("t", 3, {"rows": 3.0, "dropped": 1.0})]


def test_a_version_counts_when_it_is_committed(spark, rows, table, tmp_path):
    """What is written and not committed isn't read; who reads meanwhile sees the old rows."""
    path = str(tmp_path / "t")
    replace_path(rows(DIM_TRACT, ONE, TWO), path)
    before = read_path(spark, path)
    observed_write(rows(DIM_TRACT, ONE), f"{path}/_versions/29990101_000000_000000-x", "parquet")
    assert read_path(spark, path).count() == 2
    replace_path(rows(DIM_TRACT, ONE), path)
    assert (before.count(), read_path(spark, path).count()) == (2, 1)
    replace_table(rows(DIM_TRACT, ONE, TWO), table)
    opened = read_table(spark, table)
    replace_table(rows(DIM_TRACT, TWO), table)
    assert (opened.count(), read_table(spark, table).count()) == (2, 1)
    assert len(commits(spark, path).collect()) == 2


def test_a_table_may_feed_its_own_replacement(spark, rows, table):
    replace_table(rows(DIM_TRACT, ONE, TWO), table)
    replace_table(read_table(spark, table).filter("tract_name = 'Tract 2'"), table)
    assert list(map(tuple, read_table(spark, table).collect())) == [TWO]
    replace_table(rows("x int", (1,)), table)
    assert read_table(spark, table).columns == ["x"]
    replace_table(rows("p int, x int", (1, 1), (2, 2)), table, partition_by=["p"])
    replace_table(rows("p int, x int", (2, 3)), table, partition_by=["p"])
    assert [(r.p, r.x) for r in read_table(spark, table).collect()] == [(2, 3)]


def test_too_few_rows_are_not_committed(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    commit_version(rows("x int", (1,)), path)
    data, observed = commit_version(rows("x int"), path, least_rows=1)
    assert data is None and observed["record_count"] == 0
    assert read_path(spark, path).count() == 1


def test_partitions_are_replaced_alone(spark, rows, tmp_path):
    path, kind = str(tmp_path / "t"), "p int, x int"

    def put(*data, scoped=True):
        return commit_version(rows(kind, *data), path, "parquet", ["p"], scoped=scoped)[0]

    def now():
        return sorted(((r.p, r.x) for r in read_path(spark, path).collect()), key=str)

    put((1, 1), (2, 2), (None, 9))
    put((3, 3))
    put((2, 20), (2, 21))
    assert now() == [(1, 1), (2, 20), (2, 21), (3, 3), (None, 9)]
    put((2, 5), (None, 8))
    assert now() == [(1, 1), (2, 5), (3, 3), (None, 8)]
    put((7, 7), (8, 8), scoped=False)
    put((8, 9))
    assert now() == [(7, 7), (8, 9)]
    assert len(standing_commits(spark, path)) == 2
    assert expire_versions(spark, path, keep=3) == 3
    assert expire_versions(spark, path) == 1
    assert expire_versions(spark, path) == 0
    assert now() == [(7, 7), (8, 9)]


def test_partition_values_are_read_as_written(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    for value in ("01", "1"):
        commit_version(rows("p string, x int", (value, 1)), path, "parquet", ["p"], scoped=True)
    assert sorted(r.p for r in read_path(spark, path).collect()) == ["01", "1"]


def test_an_append_with_a_token_counts_once(spark, rows, table):
    ensure_table(spark, table, DIM_TRACT)
    assert append_rows(rows(DIM_TRACT, ONE), table, DIM_TRACT, token="load-1") == 1
    assert append_rows(rows(DIM_TRACT, ONE), table, DIM_TRACT, token="load-1") == 0
    assert append_rows(rows(DIM_TRACT, TWO), table, DIM_TRACT, token="load-2") == 1
    assert sorted(map(tuple, read_table(spark, table).collect())) == [ONE, TWO]


def test_uncommitted_snapshots_do_not_count(spark, rows, tmp_path):
    directory, df = str(tmp_path / "s"), rows("a string", ("x",))
    write_snapshot(df, directory, "json", datetime(2024, 1, 1))
    df.write.json(f"{directory}/snapshot=20240102_000000")  # nobody committed it
    assert write_snapshot(df.filter("a = 'y'"), directory, "json", datetime(2024, 1, 3)) is None
    assert latest_snapshot(spark, directory).endswith("snapshot=20240101_000000")


def test_shared_folder_comes_from_the_session(spark):
    assert shared_root(spark) == spark.conf.get("spark.checkpoint.dir")
    assert fresh_dir(spark, "x") != fresh_dir(spark, "x")
    assert fresh_dir(spark, "x").startswith(shared_root(spark))


class Session:
    """Stands in for a session with these settings."""

    def __init__(self, **settings):
        self.conf = {"spark." + key.replace("_", "."): value for key, value in settings.items()}


def test_only_a_local_session_may_use_a_temporary_folder():
    local = Session(master="local[2]", app_id="app-1")
    assert shared_root(local) == shared_root(local)
    assert shared_root(Session(master="yarn", checkpoint_dir="s3a://b/c/")) == "s3a://b/c"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_root(Session(master="yarn", app_id="app-2"))
