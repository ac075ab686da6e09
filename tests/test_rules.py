"""What the library must not contain, by its own text."""

import re
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
LIBRARY = [p for p in sorted((ROOT / "tractlake").rglob("*.py")) if "llm" not in p.parts]
FORBIDDEN = {
    "user-defined functions": r"\budf\b|pandas_udf|applyInPandas|mapInPandas",
    "RDDs": r"\.rdd\b|parallelize|mapPartitions",
    "local checkpoints": r"localCheckpoint",
    "broadcast hints": r"broadcast\(",
    "cross joins": r"crossJoin",
    "JVM internals": r"\._j[a-z]+",
    "sampling": r"\.sample\(",
}


@pytest.mark.parametrize("what", FORBIDDEN)
def test_library_has_no(what):
    found = [p.name for p in LIBRARY if re.search(FORBIDDEN[what], p.read_text())]
    assert found == []


def test_nothing_is_collected():
    """Records of a log come one by one, and stop at the first whole version."""
    assert [p.name for p in LIBRARY if ".collect()" in p.read_text()] == []
    assert [p.name for p in LIBRARY if "toLocalIterator" in p.read_text()] == ["commits.py"]
