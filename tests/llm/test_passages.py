import collections
import hashlib
import random
import re

import numpy as np
import pytest
from cases import documents, frame, prose, save, with_clashes
from compare import connect, differences
from tractlake.llm import passages
from tractlake.llm.fmindex import FMIndex, Wavelet, repeated_windows
from tractlake.llm.passages import OP11_SQL, drop_repeated, op11_substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(texts, window):
    """(number of words, of words that go, text left) of each text."""
    words = [WORD.findall(t or "") for t in texts]
    spots = [[tuple(w[i : i + window]) for i in range(len(w) - window + 1)] for w in words]
    counts = collections.Counter(s for each in spots for s in each)
    out = []
    for w, each in zip(words, spots):
        gone = {j for i, s in enumerate(each) if counts[s] > 1 for j in range(i, i + window)}
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def shared(seed=3):
    """Texts with passages of other texts, copies, near copies, and periodic stretches."""
    rng = random.Random(seed)
    base = [prose(rng, 200).split() for _ in range(6)]
    rows = [r[1] for r in documents(seed)]
    for _ in range(40):
        words = prose(rng, rng.randrange(5, 80)).split()
        for _ in range(rng.randrange(3)):
            b, at = rng.choice(base), rng.randrange(150)
            where = rng.randrange(len(words) + 1)
            words[where:where] = b[at : at + rng.choice([10, 34, 35, 36, 50, 120])]
        rows.append(" ".join(words))
    for i in range(12):
        words = list(base[0])
        words[rng.randrange(200)] = f"odd{i}"
        rows.append(("\n" if i % 2 else " ").join(words))
    rows += [" ".join(base[1])] * 5 + ["ha " * 90, "ha " * 34, "a b " * 18, " ".join(base[2][:35]), " ".join(base[2][:34])]
    return [(None if i % 17 == 3 else i, t, "en", "a", 1) for i, t in enumerate(rows)]


def check(spark, rows, window):
    docs = with_clashes(frame(spark, rows))
    got = collections.Counter(map(tuple, drop_repeated(docs, window).collect()))
    wanted = brute([r[1] for r in rows], window)
    assert got == collections.Counter((r[0], *w) for r, w in zip(rows, wanted))
    assert sum(r[2] for r in got) > 0


@pytest.mark.parametrize("hot", [1_000, 2])
def test_passages(spark, monkeypatch, hot):
    """With indexed anchors, and with most of them counted window by window."""
    monkeypatch.setattr(passages, "HOT", hot)
    check(spark, shared(), 35)


def test_shorter_windows(spark):
    check(spark, shared(8), 16)


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    assert differences(op11_substring_dedup(spark, folder), connect(folder), OP11_SQL) == []


def test_query_digest(spark, tmp_path):
    rows = shared(5)
    got = op11_substring_dedup(spark, save(frame(spark, rows), tmp_path)).collect()
    wanted = [(r[0], n, gone, hashlib.sha256(t.encode()).hexdigest()) for r, (n, gone, t) in zip(rows, brute([r[1] for r in rows], 35))]
    assert collections.Counter(map(tuple, got)) == collections.Counter(wanted)


def test_empty_table(spark):
    assert drop_repeated(frame(spark, [])).collect() == []


def test_wavelet_ranks():
    rng = np.random.default_rng(4)
    for symbols in (1, 2, 3, 70, 300):
        x = rng.integers(0, symbols, 500)
        tree = Wavelet(x, symbols)
        for c in {0, symbols - 1, symbols // 2}:
            at = np.arange(501)
            place = tree.place(np.full(501, c), at)
            assert (place - place[0]).tolist() == np.r_[0, np.cumsum(x == c)].tolist()


def test_backward_search():
    rng = random.Random(2)
    for window in (2, 3, 5, 8, 35):
        for letters in (1, 2, 3, 20):
            base = [rng.randrange(1, letters + 1) for _ in range(300)]
            texts = []
            for _ in range(25):
                at, n = rng.randrange(200), window + rng.randrange(20)
                texts.append(base[at : at + n] if rng.random() < 0.5 else [rng.randrange(1, letters + 1) for _ in range(n)])
            texts = [np.array(t, np.int64) for t in texts]
            index = FMIndex(np.concatenate([np.append(t, 0) for t in texts]), letters + 1, window - 1)
            counts = collections.Counter(tuple(t[i : i + window]) for t in texts for i in range(len(t) - window + 1))
            for t, got in zip(texts, repeated_windows(texts, index, window)):
                assert got.tolist() == [i for i in range(len(t) - window + 1) if counts[tuple(t[i : i + window])] > 1]
