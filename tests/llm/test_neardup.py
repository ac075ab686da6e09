import collections
import random
from itertools import combinations

import numpy as np
import pytest
from cases import documents, frame, prose, save, with_clashes
from tractlake.llm import neardup
from tractlake.llm.components import components
from tractlake.llm.neardup import keep_one, linked, op8_near_dedup, shingles, signatures


def plain_set(text):
    words = (text or "").encode().lower().split()
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def similar(a, b):
    return bool(a and b) and 100 * len(a & b) >= 85 * len(a | b)


def brute(rows):
    """(doc_id, n_shingles, component, kept) of each row; ids are the vertices."""
    sets = [(i, plain_set(t)) for i, t, *_ in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (i, a), (j, b) in combinations(sets, 2):
        if i is not None and j is not None and similar(a, b):
            x, y = sorted((root(i), root(j)))
            parent[y] = x
    return collections.Counter(
        (i, len(s), None if i is None else root(i), True if i is None else i == root(i)) for i, s in sets
    )


def family(rng, n, words=120, most=14):
    """Copies of one text with up to ``most`` changed words: some linked, some not."""
    base = prose(rng, words).split()
    out = []
    for _ in range(n):
        copy = list(base)
        for at in rng.sample(range(words), rng.randrange(most)):
            copy[at] = f"new{rng.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


def awkward():
    rng = random.Random(11)
    rows = documents()
    rows += [(1000 + i, t, "en", "a", 1) for i, t in enumerate(family(rng, 90))]
    rows += [(2000 + i, rows[0][1], "en", "b", 1) for i in range(40)]
    return rows + [(12, rows[30][1], "en", "a", 1), (2003, prose(rng, 50), "en", "a", 1)]


def test_signature_is_the_plain_algorithm():
    rng = np.random.default_rng(3)
    for n in (1, 3, 50, 600):
        one = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        m, wanted = neardup.PLACES, np.full(neardup.PLACES, np.inf)
        for e in one:
            places = list(range(m))
            for j in range(m):
                bits = int(neardup.mixed(np.array([(int(e) + (j + 1) * 0x9E3779B97F4A7C15) % 2**64], np.uint64))[0])
                k = j + ((bits & 0xFFFFFFFF) * (m - j) >> 32)
                places[j], places[k] = places[k], places[j]
                wanted[places[j]] = min(wanted[places[j]], j + (bits >> 32) * 2.0**-32)
        assert (signatures([one])[0] == wanted).all()


def test_signatures_agree_as_often_as_sets_overlap():
    rng = np.random.default_rng(4)
    agree, wanted = [], []
    for _ in range(60):
        both, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (300, 60, 40))
        x, y = signatures([np.unique(np.concatenate([both, a])), np.unique(np.concatenate([both, b]))])
        agree.append((x == y).mean())
        wanted.append(300 / 400)
    assert abs(np.mean(agree) - 0.75) < 0.01


def test_large_sets_go_in_parts(monkeypatch):
    one = np.unique(np.random.default_rng(5).integers(0, 2**63, 5000, dtype=np.uint64))
    whole = signatures([one, one[:70]])
    monkeypatch.setattr(neardup, "STEP_SHINGLES", 300)
    assert (signatures([one, one[:70]]) == whole).all()


@pytest.mark.parametrize("most", [3, 8, 14, 25])
def test_forest_connects_what_links_connect(most):
    rng = random.Random(most)
    texts = family(rng, 120, most=most) + family(rng, 30, words=30, most=4)
    sets = [shingles(t.encode(), {}) for t in texts]
    forest = linked(np.arange(len(sets)), sets)
    rows = [(i, t) for i, t in enumerate(texts)]
    wanted = {i: c for i, _, c, _ in brute(rows)}
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in forest:
        assert similar(plain_set(texts[a]), plain_set(texts[b]))
        x, y = sorted((root(a), root(b)))
        assert x != y
        parent[y] = x
    assert {i: root(i) for i in range(len(sets))} == wanted


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)]
    edges += [(i, i + 1) for i in range(1000, 1060)] + [(5000, i) for i in range(4000, 4050)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    parent = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    assert got == {i: root(i) for i in parent if root(i) != i}


@pytest.mark.parametrize("block", [(128, 2048), (9, 9)])
def test_query(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK_ROWS", block)
    rows = awkward()
    folder = save(with_clashes(frame(spark, rows)).repartition(3), tmp_path)
    out = op8_near_dedup(spark, folder)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert collections.Counter(map(tuple, out.collect())) == brute(rows)


def test_one_of_each_group_stays(spark):
    rows = awkward()
    docs = with_clashes(frame(spark, rows))
    out = keep_one(docs)
    assert out.columns == docs.columns
    ids = collections.Counter(r.doc_id for r in out.collect())
    wanted = {i for (i, _, _, kept) in brute(rows) if kept}
    assert set(ids) == wanted
    assert all(n == 1 for i, n in ids.items() if i is not None)


def test_empty_table(spark, tmp_path):
    folder = save(frame(spark, []), tmp_path)
    assert op8_near_dedup(spark, folder).collect() == []
    assert keep_one(spark.read.parquet(f"{folder}/documents.parquet")).collect() == []
