import collections
import random
import re

import numpy as np
from cases import documents, frame, save, with_clashes
from tractlake.llm.mixing import _trade, decide, mix, op6_mixing, sized_rows, source_targets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes):
    """Shares by weight; what is over a limit goes to the others, again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, list(names), 1.5 * sum(sizes.values())
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        full = [s for s in free if share[s] > 2 * sizes[s]]
        if not full:
            return target | share
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            free.remove(s)
    return target


def test_targets(spark):
    rng = random.Random(4)
    for n in (1, 2, 5, 40):
        sizes = {None if i == 0 else rng.choice("aZé\U0001f600") + str(i): int(10 ** (4 * rng.random())) for i in range(n)}
        got = source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long"))
        wanted = plain_targets(sizes)
        for r in got.collect():
            assert abs(r.target - wanted[r.source]) <= 1e-9 * max(1, wanted[r.source])
            assert r.source_size == sizes[r.source]
    zero = source_targets(spark.createDataFrame([("a", 0), (None, 0)], "source string, size long"))
    assert {r.target for r in zero.collect()} == {0.0}


def test_trades_keep_words_and_expectations():
    rng = np.random.default_rng(2)
    size, part = rng.integers(1, 50, 40).astype(float), rng.random(40)
    sums = np.zeros(40)
    for _ in range(4000):
        out, left = _trade(size, part, rng.random(40))
        assert abs((out * size).sum() - (part * size).sum()) < 1e-6
        rounded = np.delete(out, left) if left >= 0 else out
        assert set(rounded.tolist()) <= {0.0, 1.0}
        sums += out
    assert np.abs(sums / 4000 - part).max() < 0.05


def test_sources_come_within_one_row_of_the_target(spark):
    rng = random.Random(9)
    rows = [(i, f"s{i % 3 and i % 7}", rng.randrange(0, 90), i * 7) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long, __text_hash long")
    out = decide(df, group=40).collect()
    assert len(out) == len(rows)
    taken, target = collections.Counter(), {}
    for r in out:
        assert 0 <= r.copies <= 2
        taken[r.source] += r.copies * r["size"]
        target[r.source] = r.target
    assert all(abs(taken[s] - t) <= 90 for s, t in target.items())


def test_query(spark, tmp_path):
    rows = documents()
    folder = save(with_clashes(frame(spark, rows)), tmp_path)
    out = op6_mixing(spark, folder).collect()
    size = collections.Counter()
    for _, t, _, source, _ in rows:
        size[source] += len(WORD.findall(t or ""))
    target = plain_targets(size)
    wanted = collections.Counter((i, len(WORD.findall(t or "")), size[s], round(target[s], 6)) for i, t, _, s, _ in rows)
    assert collections.Counter((r.doc_id, r["size"], r.source_size, round(r.target, 6)) for r in out) == wanted
    assert all(0 <= r.taken <= 2 * r["size"] for r in out)
    again = op6_mixing(spark, save(frame(spark, rows[::-1]).repartition(5), tmp_path)).collect()
    assert collections.Counter(map(tuple, again)) == collections.Counter(map(tuple, out))


def test_repeated_rows_share_their_copies(spark):
    rows = [(1, "a b c", "en", "s", 1)] * 1001 + [(i, "x y z", "en", "t", 1) for i in range(2, 900)]
    docs = frame(spark, rows)
    out = mix(docs)
    counts = collections.Counter(r.source for r in out.collect())
    targets = {r.source: r.target for r in source_targets(sized_rows(docs)).collect()}
    assert all(abs(3 * counts[s] - t) <= 3 for s, t in targets.items())


def test_mix_agrees_with_its_decisions(spark):
    docs = with_clashes(frame(spark, documents()))
    copies = {(r.doc_id, r.source, r["__text_hash"]): r.copies for r in decide(sized_rows(docs)).collect()}
    out = mix(docs)
    assert out.columns == docs.columns
    got = collections.Counter((r.doc_id, r.source, r["__text_hash"]) for r in sized_rows(out).collect())
    assert got == {k: n for k, n in copies.items() if n}


def test_empty_table(spark, tmp_path):
    folder = save(frame(spark, []), tmp_path)
    assert op6_mixing(spark, folder).collect() == []
    assert mix(spark.read.parquet(f"{folder}/documents.parquet")).collect() == []
