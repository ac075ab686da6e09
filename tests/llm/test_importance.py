import collections
import hashlib
import math
import re
import zlib

from cases import documents, frame, save, with_clashes
from compare import connect, differences
from tractlake.llm import importance
from tractlake.llm.importance import OP13_SQL, Features, head, op13_importance, resampled, words_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TARGETS = ["the of and bat bet", "BAT bat kit é", None, "", "the the"]


def plain_words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, targets, buckets, size, seed, percent, least):
    """Rows (doc_id, n_features, weight, score), and the drawn (doc_id, score) in order."""

    def found(text):
        words = plain_words(text)
        runs = [" ".join(words[i : i + k]) for k in range(1, size + 1) for i in range(len(words) - k + 1)]
        return [zlib.crc32(r.encode()) % buckets for r in runs]

    s = collections.Counter(b for _, t in rows for b in found(t))
    t = collections.Counter(b for x in targets for b in found(x))
    all_s, all_t = s.total(), t.total()
    out, open_ = [], []
    for i, text in rows:
        weight = sum(
            math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in found(text)
        )
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((i, len(found(text)), weight, score))
        if len(plain_words(text)) >= least:
            open_.append((-score, i is None, i or 0))
    drawn = sorted(open_)[: percent * len(open_) // 100]
    return collections.Counter(out), [(None if n else i, -s) for s, n, i in drawn]


def check(spark, rows, size, buckets=500, percent=30):
    docs = with_clashes(frame(spark, rows))
    targets = spark.createDataFrame([(i, t) for i, t in enumerate(TARGETS)], "item_id long, text string")
    got = resampled(docs, targets, buckets, size, 7, percent, 20).collect()
    wanted, drawn = brute([r[:2] for r in rows], TARGETS, buckets, size, 7, percent, 20)
    assert collections.Counter((r.doc_id, r.n_features, r.weight, r.score) for r in got) == wanted
    ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [(r.doc_id, r.score) for r in ranked] == drawn


def test_words(spark):
    for text in ("A-b_C9 é\x00x\x7fy ÀB", "", " ", "́x日本 z", "a\x0bb\x85c"):
        assert [w.decode() for w in words_of(text.encode())] == plain_words(text)


def test_words_pairs_and_triples(spark, monkeypatch):
    """With a head of a few words and pairs, and with one that holds all."""
    rows = documents()
    check(spark, rows, 1)
    monkeypatch.setattr(importance, "COUNTED", 40)
    for size in (2, 3):
        check(spark, rows, size)


def test_head_has_no_influence(spark):
    docs = frame(spark, documents())
    words, pairs = head(docs, 2, 5)
    assert len(words) == len(pairs) == 5 and b"the" in words
    for size in (1, 2, 3):
        text = words_of(b"the the the same line here kit kit")
        assert Features(words, pairs, 97, size)(text).tolist() == Features([], [], 97, size)(text).tolist()


def test_many_equal_rows(spark):
    """Rows equal in score and id take ranks one after the other."""
    rows = [(1, "bat kit " * 20, "en", "a", 1)] * 300 + [(i, "of and " * 12, "en", "a", 1) for i in range(2, 60)]
    check(spark, rows, 1)


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    assert differences(op13_importance(spark, folder), connect(folder), OP13_SQL) == []


def test_empty_tables(spark, tmp_path):
    save(spark.createDataFrame([], "item_id long, text string"), tmp_path, "benchmark")
    assert op13_importance(spark, save(frame(spark, []), tmp_path)).collect() == []
    save(frame(spark, documents()), tmp_path)
    assert op13_importance(spark, str(tmp_path)).count() == len(documents())
