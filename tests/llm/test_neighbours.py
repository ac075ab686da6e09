import numpy as np
from cases import save
from tractlake.llm import neighbours
from tractlake.llm.neighbours import op10_neighbours, ranks, search, usable

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, score string"


def brute(rows, asked, k):
    """{query: [(vec_id, score)]} of the whole."""
    out = {}
    for q in asked:
        own = [np.array(v, np.float64) for i, v in rows if i == q]
        best = {}
        for i, v in rows:
            if i != q:
                for x in own:
                    if len(x) == len(v):
                        s = float((np.array(v, np.float64) * x).sum())
                        best[i] = max(best.get(i, -np.inf), s)
        out[q] = sorted(best.items(), key=lambda p: (-p[1], p[0]))[:k]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_footrule_from_the_querys_files():
    rng = np.random.default_rng(1)
    x = ranks(rng.standard_normal((30, 16))).astype(int)
    q = ranks(rng.standard_normal((1, 16))).astype(int)[0]
    footrule = np.abs(x - q).sum(axis=1)
    own = q < neighbours.POSTED
    short = np.maximum(x[:, own], q[own]).sum(axis=1)
    assert len(set((footrule - 2 * short).tolist())) == 1


def test_query_on_awkward_rows(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(i, np.float32(rng.standard_normal(8)).tolist()) for i in range(150)]
    rows += [(200 + i, rows[40][1]) for i in range(60)]  # ties
    rows += [(20, rows[20][1]), (40, rows[41][1]), (300, [1.0, 2.0]), (301, [2.0, 1.0]), (320, [float(np.float32(3e38)), 0.5])]
    odd = [(400, None), (420, []), (440, [0.0] * 8), (460, [None] + [1.0] * 7), (480, [float("nan")] * 8), (500, [float("inf")] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows + odd], SCHEMA)
    out = op10_neighbours(spark, save(df.repartition(3), tmp_path, "embeddings"))
    assert [f.simpleString() for f in out.schema] == ["query_id:bigint", "rank:int", "vec_id:bigint", "score:double"]
    wanted = brute(rows, sorted({i for i, _ in rows if i % 20 == 0}), 20)
    assert found(out) == {q: hits for q, hits in wanted.items() if hits}


def test_recall_and_scores(spark):
    vectors = usable(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"))
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    asked = [i for i, _ in rows if i % 40 == 0]
    got = found(search(vectors, vectors.filter("vec_id % 40 = 0"), 20))
    x = {i: np.array(v) for i, v in rows}
    hits = []
    for q, best in brute(rows, asked, 20).items():
        assert len(got[q]) == 20
        assert all(abs(s - (x[q] * x[i]).sum()) < 1e-12 for i, s in got[q])
        hits.append(len({i for i, _ in best} & {i for i, _ in got[q]}) / 20)
    assert np.mean(hits) >= 0.9


def test_recall_in_a_large_block(monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((12_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.arange(len(x))
    q, v, _ = neighbours.nearest_in_block(ids, x, ids[:40], x[:40], 20)
    hits = []
    for i in range(40):
        score = x @ x[i]
        score[i] = -9
        hits.append(len(set(np.argsort(-score)[:20].tolist()) & {b for a, b in zip(q, v) if a == i}) / 20)
    assert np.mean(hits) >= 0.9


def test_empty_table(spark, tmp_path):
    assert op10_neighbours(spark, save(spark.createDataFrame([], SCHEMA), tmp_path, "embeddings")).collect() == []


def recall(x, queries, k=20):
    """The share of the best ``k`` that a block of ``x`` gives for the first ``queries`` vectors."""
    ids = np.arange(len(x))
    q, v, _ = neighbours.nearest_in_block(ids, x, ids[:queries], x[:queries], k)
    hits = []
    for i in range(queries):
        score = x @ x[i]
        score[i] = -np.inf
        hits.append(len(set(np.argsort(-score)[:k].tolist()) & {b for a, b in zip(q, v) if a == i}) / k)
    return np.mean(hits)


def test_recall_with_unequal_lengths():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((12_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    few = x.copy()
    few[100:140] *= 100
    assert recall(few, 40) >= 0.9
    assert recall(x * rng.lognormal(0, 0.5, (12_000, 1)), 40) >= 0.9
    assert recall(x * rng.uniform(0.5, 1, (12_000, 1)), 40) >= 0.9
    assert recall(few * 1e-100, 40) >= 0.9


def test_the_given_table_is_ranked(spark):
    """Its 2,000 vectors make one block, of which 256 and ties are compared."""
    assert [neighbours.cells(n, n // 20)[0] for n in (0, 500, 2_000, 16_384, 16_385)] == [1, 1, 1, 1, 2]
    assert neighbours.cells(2_000, 100) == (1, 7)
    vectors = usable(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"))
    assert recall(np.array([r.embedding for r in vectors.collect()]), 100) >= 0.9
