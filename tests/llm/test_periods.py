import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from cases import documents, frame, save, with_clashes
from tractlake.llm import periods
from tractlake.llm.periods import op12_periodic_runs, periodic_runs, runs_of, runs_of_texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(x, least=12):
    """(start, end, period) of all runs, by trying each period."""
    n, best = len(x), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q):
                best.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e, q) for (s, e), q in best.items()), key=lambda r: (r[0], r[2]))


def noisy_repeats(rng):
    root = [rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.randrange(1, 40))]
    x = (root * 400)[: rng.randrange(1, 400)]
    for _ in range(rng.randrange(4)):
        x[rng.randrange(len(x))] = 9
    return x


def nested_squares(rng):
    """A periodic root, twice: no window inside one root is free of the shorter period."""
    root = [rng.randrange(2) for _ in range(rng.randrange(1, 12))]
    u = (root * 40)[: rng.randrange(1, 120)]
    ends = [[rng.randrange(3) for _ in range(rng.randrange(5))] for _ in range(2)]
    return ends[0] + u * rng.choice([2, 2, 3]) + ends[1]


def mixed(rng):
    x = []
    while len(x) < 400:
        root = [rng.randrange(3) for _ in range(rng.randrange(1, 6))]
        x += (root * 40)[: rng.randrange(1, 100)]
        if rng.random() < 0.3:
            x += x[-rng.randrange(1, len(x) + 1) :]
    return x[:500]


def fibonacci(rng):
    a, b = [0], [0, 1]
    while len(b) < 400:
        a, b = b, b + a
    return b[: rng.randrange(400)]


@pytest.mark.parametrize("make", [noisy_repeats, nested_squares, mixed, fibonacci])
def test_all_runs_are_found(make):
    rng = random.Random(make.__name__)
    texts = [make(rng) for _ in range(120)]
    got = runs_of_texts([np.array(x, np.int64) for x in texts])
    for x, rows in zip(texts, got):
        assert [tuple(r) for r in rows.tolist()] == brute(x)


def test_constant_text_takes_linear_work():
    rows = runs_of(np.zeros(200_000, np.int64))
    assert rows.tolist() == [[0, 200_000, 1]]


def test_hash_collisions_lose_no_run(monkeypatch):
    """With block hashes that are all equal, stretches are scanned instead."""

    class Equal(periods.Blocks):
        def __call__(self, start, length):
            return np.zeros(len(start), np.uint64)

    monkeypatch.setattr(periods, "Blocks", Equal)
    x = np.r_[np.arange(40), np.tile(np.arange(100, 120), 4), np.arange(200, 230)]
    assert [tuple(r) for r in runs_of(x).tolist()] == brute(x.tolist())


def expected(doc_id, text):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words) if n < 3_000 else [tuple(r) for r in runs_of(np.unique(words, return_inverse=True)[1]).tolist()]
    gone = {i for s, e, q in runs for i in range(s + q, e)}
    best = min(runs, key=lambda r: (-(r[1] - r[0]), r[0], r[2]), default=None)
    longest = (None,) * 4
    if best:
        s, e, q = best
        longest = (s, e - s, q, 1000 * (e - s) // q)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    listed = "".join(f"{s},{e - s},{q}\n" for s, e, q in runs)
    return (doc_id, len(runs), *longest, sha(listed), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query(spark, tmp_path):
    rows = documents()
    folder = save(with_clashes(frame(spark, rows)), tmp_path)
    got = collections.Counter(map(tuple, op12_periodic_runs(spark, folder).collect()))
    assert got == collections.Counter(expected(r[0], r[1]) for r in rows)
    assert any(r[1] for r in got)


def test_runs_and_texts(spark):
    text = "one two " + "la li lu " * 6 + "end"
    rows = [(1, text, "en", "a", 1), (2, None, "en", "a", 1), (None, "x " * 30, "en", "a", 1)]
    got = {r.doc_id: r for r in periodic_runs(frame(spark, rows)).collect()}
    assert [tuple(r) for r in got[1].runs] == [(2, 18, 3)] and got[1].text == "one two la li lu end"
    assert got[2].runs == [] and got[2].text == ""
    assert [tuple(r) for r in got[None].runs] == [(0, 30, 1)] and got[None].text == "x"


def test_empty_table(spark, tmp_path):
    assert op12_periodic_runs(spark, save(frame(spark, []), tmp_path)).collect() == []
