from datetime import datetime

import pytest

from tractlake.schemas import schema_from_spec
from tractlake.streaming.changes import change_check
from tractlake.sinks.commits import commits, standing_commits
from tractlake.streaming.landing import BATCH, clean_table, ingest_new_files, merge_batch, read_log

RECORD = schema_from_spec(
    [
        {"name": "year", "type": "string"},
        {"name": "doc", "type": "string"},
        {"name": "amount", "type": "double"},
    ]
)


@pytest.fixture
def run(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()

    def step(files=None, hour=0, **options):
        for name, text in (files or {}).items():
            (landing / name).write_text(text)
        return ingest_new_files(
            spark,
            str(landing),
            RECORD,
            ["year", "doc"],
            str(tmp_path / "log"),
            str(tmp_path / "clean"),
            str(tmp_path / "checkpoint"),
            now=datetime(2024, 1, 1, hour),
            **options,
        )

    return step


def clean(spark, tmp_path):
    return {
        (r.year, r.doc): (r.amount, r.ingest_timestamp.hour)
        for r in clean_table(spark, str(tmp_path / "clean"), RECORD).collect()
    }


def test_only_new_files_are_taken_in(spark, tmp_path, run):
    first = '{"year": "2023", "doc": "a", "amount": 1}\n{"year": "2024", "doc": "b", "amount": 2}\n'
    assert run({"1.json": first}, hour=1) == 1
    assert clean(spark, tmp_path) == {("2023", "a"): (1.0, 1), ("2024", "b"): (2.0, 1)}
    assert run(hour=2) == 0
    assert run({"2.json": '{"year": "2024", "doc": "b", "amount": 5}\n'}, hour=3) == 1
    assert clean(spark, tmp_path) == {("2023", "a"): (1.0, 1), ("2024", "b"): (5.0, 3)}
    assert read_log(spark, str(tmp_path / "log"), RECORD).count() == 3


def files_of(tmp_path):
    return {f for f in (tmp_path / "clean").rglob("*.parquet")}


def test_a_batch_writes_its_own_rows_only(spark, tmp_path, run):
    many = "".join(f'{{"year": "2023", "doc": "{i}", "amount": {i}}}\n' for i in range(2000))
    run({"1.json": many})
    before = files_of(tmp_path)
    run({"2.json": '{"year": "2023", "doc": "7", "amount": -1}\n'}, hour=1)
    run({"3.json": '{"year": "2023", "doc": "7", "amount": -2}\n{"year": "2023", "doc": "x"}\n'}, hour=2)
    assert before < files_of(tmp_path) and len(files_of(tmp_path) - before) == 2
    found = clean(spark, tmp_path)
    assert len(found) == 2001 and found["2023", "7"] == (-2, 2) and found["2023", "8"] == (8, 0)
    standing = standing_commits(spark, str(tmp_path / "clean"))
    assert [r.record_count for r in standing] == [2, 1, 2000]


def test_deltas_are_compacted(spark, tmp_path, run):
    """Many deltas, and a large one, are written together with the rest."""
    many = "".join(f'{{"year": "2023", "doc": "{i}", "amount": {i}}}\n' for i in range(100))
    run({"0.json": many})
    files = {f"{i}.json": f'{{"year": "2023", "doc": "{i % 4}", "amount": {-i}}}\n' for i in range(1, 18)}
    assert run(files, max_files_per_batch=1) == 17
    assert [r.record_count for r in standing_commits(spark, str(tmp_path / "clean"))] == [1, 100]
    run({"z.json": many.replace('"amount": ', '"amount": 5')})
    assert [r.record_count for r in standing_commits(spark, str(tmp_path / "clean"))] == [100]
    assert clean(spark, tmp_path)["2023", "42"][0] == 542


def test_every_file_counts_when_batches_are_small(spark, tmp_path, run):
    files = {
        f"{i}.json": f'{{"year": "2024", "doc": "{i % 3}", "amount": {i}}}\n' for i in range(6)
    }
    assert run(files, max_files_per_batch=2) == 3
    assert len(clean(spark, tmp_path)) == 3
    assert read_log(spark, str(tmp_path / "log"), RECORD).count() == 6


def test_null_and_empty_keys_are_different(spark, tmp_path, run):
    run({"1.json": '{"doc": "a", "amount": 1}\n{"year": "", "doc": "a", "amount": 2}\n'})
    run({"2.json": '{"doc": "a", "amount": 3}\n'})
    assert {k: v for k, (v, _) in clean(spark, tmp_path).items()} == {(None, "a"): 3.0, ("", "a"): 2.0}


def test_a_repeated_batch_changes_nothing(spark, tmp_path, run):
    run({"1.json": '{"year": "2023", "doc": "a", "amount": 1}\n{"doc": "b", "amount": 2}\n'})
    path, once = str(tmp_path / "clean"), clean(spark, tmp_path)
    landed = read_log(spark, str(tmp_path / "log"), RECORD)
    assert merge_batch(spark, landed, ["year", "doc"], path, 0) is False
    assert clean(spark, tmp_path) == once and commits(spark, path).count() == 1
    assert [r[BATCH] for r in landed.collect()] == [0, 0]


def test_change_check(rows):
    current = rows("source string, records bigint", ("a", 5), ("b", 5), ("c", 0))
    runs = rows(
        "source string, run_at int, records bigint", ("a", 1, 5), ("a", 2, 4), ("b", 1, 5)
    )
    out = {r.source: (r.previous, r.changed) for r in change_check(current, runs).collect()}
    assert out == {"a": (4, True), "b": (5, False), "c": (-1, True)}
