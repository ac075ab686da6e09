"""Wall time of the registered queries; prints one JSON line.

BENCH_SF_DIR, BENCH_CPUS, BENCH_RUNS and BENCH_QUERIES (comma-separated names) set
the data, the cores, the timed runs per query (the best counts) and the selection.
BENCH_COMPARE=1 also times the SQL twins in DuckDB, as ``duckdb``.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))

from tractlake.session import build_session  # noqa: E402
from workload import QUERIES  # noqa: E402


def best_time(run, runs: int) -> float:
    run()
    times = []
    for _ in range(runs):
        start = time.perf_counter()
        run()
        times.append(time.perf_counter() - start)
    return round(min(times), 4)


def duckdb_times(sf_dir: str, cpus: int, names: list[str], runs: int) -> dict[str, float]:
    sys.path.insert(0, str(ROOT / "tests"))
    from compare import connect

    connection = connect(sf_dir)
    connection.execute(f"SET threads = {cpus}")

    def timed(sql: str) -> float:
        return best_time(
            lambda: connection.execute(f"CREATE OR REPLACE TEMP TABLE result AS {sql}"), runs
        )

    return {name: timed(QUERIES[name].sql) for name in names if QUERIES[name].sql}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else list(QUERIES)

    spark = build_session(
        "bench",
        master=f"local[{cpus}]",
        shuffle_partitions=cpus,
        conf={
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            # One file per test table: small splits give every core a part of it.
            "spark.sql.files.maxPartitionBytes": "4m",
            "spark.log.level": "ERROR",
            "spark.checkpoint.dir": os.environ.get("BENCH_SHARED_DIR") or tempfile.mkdtemp(),
        },
    )
    times = {}
    for name in names:

        def run(query=QUERIES[name]) -> None:
            query.run(spark, sf_dir).write.format("noop").mode("overwrite").save()

        times[name] = best_time(run, runs)
    spark.stop()

    result = {
        "metric": "total wall time of the registered queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": sf_dir.rpartition("sf")[2],
        "cpus": cpus,
    }
    if os.environ.get("BENCH_COMPARE") == "1":
        result["duckdb"] = duckdb_times(sf_dir, cpus, names, runs)
    print(json.dumps(result))


if __name__ == "__main__":
    main()
