import collections
import math
import zlib

import numpy as np
import pytest
from cases import documents, frame, save, with_clashes
from tractlake.llm import blocks, scoring
from tractlake.llm.scoring import CLASSES, END, FREQUENT, TAILS, fit, op7_lm_scoring, tail


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def brute(rows):
    """Per row: id, held out, tokens, known, all training tokens, base score; and the counts."""
    lines = [(i, [*(t or "").encode().lower().split(), None]) for i, t, *_ in rows]
    counts = collections.Counter(w for i, ws in lines if not held(i) for w in ws)
    n, v = sum(counts.values()), len(counts)
    return [
        (i, held(i), len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 6))
        for i, ws in lines
    ], counts


def plain_scores(rows):
    """The model's scores, word by word."""
    lines = [(i, [*(t or "").encode().lower().split(), None]) for i, t, *_ in rows]
    counts = brute(rows)[1]
    words = sorted((-n, w) for w, n in counts.items() if w is not None)
    frequent = {w: k for k, (_, w) in enumerate(words[:FREQUENT])}

    def kind(w):
        return END if w is None else frequent.get(w, tail(w))

    pairs = np.zeros((CLASSES, CLASSES))
    for i, ws in lines:
        if not held(i):
            for a, b in zip([None, *ws], ws):
                pairs[kind(a), kind(b)] += 1
    model = fit(pairs)
    size = collections.Counter()
    for n, w in words[FREQUENT:]:
        size[tail(w)] += 1 - n
    out = []
    for i, ws in lines:
        total = 0.0
        for a, b in zip([None, *ws], ws):
            total += model[kind(a), kind(b)]
            if FREQUENT <= kind(b) < END:
                total += math.log10((counts[b] + 1) / (size[kind(b)] + 1))
        out.append((i, total))
    return out


@pytest.mark.parametrize("limit", [blocks.BLOCK_WORDS, 60])
def test_query(spark, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(blocks.pack, "__defaults__", (None, False, None, limit))
    monkeypatch.setattr(scoring._tokens, "__defaults__", (min(limit, 500),))
    rows = documents()
    out = op7_lm_scoring(spark, save(with_clashes(frame(spark, rows)).repartition(3), tmp_path))
    assert out.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    got = out.collect()
    assert collections.Counter((*r[:5], round(r.base_score, 6)) for r in got) == collections.Counter(brute(rows)[0])
    wanted = sorted(plain_scores(rows), key=lambda p: (p[0] is None, p[0] or 0, p[1]))
    found = sorted(((r.doc_id, r.score) for r in got), key=lambda p: (p[0] is None, p[0] or 0, p[1]))
    for (i, a), (j, b) in zip(found, wanted):
        assert i == j and abs(a - b) <= 1e-3 + 1e-4 * abs(b)


def test_model_is_normalised_and_learns():
    rng = np.random.default_rng(1)
    pairs = np.zeros((60, 60))
    for i in range(60):
        pairs[i, (i + np.arange(3)) % 60] = rng.integers(50, 100, 3)
    model = fit(pairs)
    assert np.allclose((10**model).sum(axis=1), 1)
    p = pairs / pairs.sum()
    unigram = np.log10(pairs.sum(axis=0) / pairs.sum())
    best = np.log10(np.maximum(pairs / pairs.sum(axis=1, keepdims=True), 1e-9))
    assert (p * model).sum() > (p * unigram).sum() + 0.8 * ((p * best).sum() - (p * unigram).sum())
    assert TAILS + FREQUENT == END


def test_better_than_the_base_on_held_out_texts(spark):
    out = op7_lm_scoring(spark, "/root/testdata/sf0.01").filter("held_out").collect()
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    assert np.mean([r.score > r.base_score for r in out]) > 0.9


def test_empty_table_and_no_training_text(spark, tmp_path):
    assert op7_lm_scoring(spark, save(frame(spark, []), tmp_path)).collect() == []
    only = next(i for i in range(100) if held(i))
    rows = [(only, "a b", "en", "s", 1)]
    r = op7_lm_scoring(spark, save(frame(spark, rows), tmp_path)).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0)
    assert math.isclose(r.score, -3 * math.log10(CLASSES), rel_tol=1e-4)
