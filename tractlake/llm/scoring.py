"""Operator 7: scoring texts with a log-bilinear model.

The model predicts a token's class from the token before it. The ``FREQUENT`` most frequent training
words and the end are classes of their own; all other words fall into ``TAILS`` classes by
their last two bytes. A context vector times a matrix is compared with every class's vector:
``score = (r(before) C) . q(class) + b(class)``; the softmax of the scores is the class's
probability. A word's probability in its class is ``(c + 1) / (N + V + 1)`` over the class's
training words, with one place for words never seen. So the probabilities of all words, of one
unknown word per class, and of the end add up to 1.

1. Texts become blocks (``blocks.py``). Words of the training texts are counted in buckets.
2. Every pair of neighbouring classes in the training texts is counted: a table of at most
   ``classes^2`` numbers, however large the corpus; it and the most frequent words are all
   that the driver sees.
3. Noise-contrastive estimation fits the model to the whole table: pairs against noise drawn
   from the classes' frequencies, ``NOISE`` draws for each pair, by their exact expectation. The
   score is then normalised: one matrix product gives the log-probabilities of all classes
   for all contexts.
4. Counts come back to the blocks by position, and each text's terms are added up.

Null texts are empty: only an end. Without training texts every class is equally likely. A
null id counts as an empty id text. Repeated rows are each scored and, if they train, counted.
Empty tables give empty tables. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tractlake.llm.base import Query, fresh_dir, materialize, table
from tractlake.llm.blocks import (
    bucket_order,
    by_block,
    by_word,
    own_of,
    pack,
    pack_numbers,
    parts_of,
    unpack_numbers,
    unpack_words,
)

FREQUENT, TAILS = 1_024, 256
END = FREQUENT + TAILS
CLASSES = END + 1
DIMENSION, NOISE, STEPS, RATE = 32, 10, 60, 0.05
#: Tokens of a block that are scored at once; rows of the pair table that travel together.
SLICE, ROWS = 500_000, 64


def is_held_out(doc_id: int | None) -> bool:
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 7 == 2


def trains(doc_id: int | None) -> bool:
    return not is_held_out(doc_id)


def tail(word: bytes) -> int:
    return FREQUENT + zlib.crc32(word[-2:]) % TAILS


def count_words(blocks: DataFrame, keep: int = FREQUENT) -> DataFrame:
    """What each bucket knows, stored.

    Rows with ``data``: the training counts of a block's words of the bucket. One row without:
    the bucket's most frequent words with their counts, and the words seen and their sum, for
    each tail class.
    """

    def run(rows: pa.Table) -> pa.Table:
        counts: dict[bytes, int] = {}
        lists = []
        for packed, numbers in zip(rows.column("words"), rows.column("counts")):
            words = unpack_words(packed.as_py())
            lists.append(words)
            for word, n in zip(words, unpack_numbers(numbers.as_py()).tolist()):
                counts[word] = counts.get(word, 0) + n
        seen, total = np.zeros(TAILS, np.int64), np.zeros(TAILS, np.int64)
        for word, n in counts.items():
            if n:
                seen[tail(word) - FREQUENT] += 1
                total[tail(word) - FREQUENT] += n
        best = sorted(((-n, w) for w, n in counts.items() if n))[:keep]
        data = [pack_numbers(_halves([counts[w] for w in words])) for words in lists]
        none = [None] * len(lists)
        return pa.table(
            {
                "block": pa.array([*rows["block"].to_pylist(), None], pa.int64()),
                "bucket": pa.array([*rows["bucket"].to_pylist(), rows["bucket"][0].as_py()], pa.int32()),
                "data": pa.array([*data, None], pa.binary()),
                **_summary(best, seen, total, none),
            }
        )

    return materialize(by_word(blocks, run, f"block long, bucket int, data binary, {SUMMARY}"), "counts")


SUMMARY = "best array<binary>, uses array<long>, seen array<long>, total array<long>"


def _summary(best: list[tuple[int, bytes]], seen, total, before: list | None = None) -> dict:
    before = before or []
    return {
        "best": pa.array([*before, [w for _, w in best]], pa.list_(pa.binary())),
        "uses": pa.array([*before, [-n for n, _ in best]], pa.list_(pa.int64())),
        "seen": pa.array([*before, seen.tolist()], pa.list_(pa.int64())),
        "total": pa.array([*before, total.tolist()], pa.list_(pa.int64())),
    }


def _merged(rows: list[dict], keep: int) -> tuple[list[tuple[int, bytes]], np.ndarray, np.ndarray]:
    """The most frequent words of all rows, and the sums of their tail classes."""
    every = sorted((-n, bytes(w)) for r in rows for w, n in zip(r["best"], r["uses"]))
    seen, total = (
        sum((np.array(r[c], np.int64) for r in rows), np.zeros(TAILS, np.int64)) for c in ("seen", "total")
    )
    return every[:keep], seen, total


def vocabulary(counted: DataFrame, keep: int = FREQUENT, parts: int = 32):
    """The ``keep`` most frequent words with negative counts, and the sums of the tail classes.

    Buckets' lists are merged in ``parts`` groups first; the driver sees one list of each.
    """

    def merge(rows: pa.Table) -> pa.Table:
        return pa.table(_summary(*_merged(rows.to_pylist(), keep)))

    lists = counted.filter("data IS NULL").select(
        F.pmod("bucket", F.lit(parts)).alias("part"), "best", "uses", "seen", "total"
    )
    merged = lists.groupBy("part").applyInArrow(merge, SUMMARY)
    return _merged([r.asDict() for r in merged.collect()], keep)


def _halves(counts: list[int]) -> np.ndarray:
    """64-bit counts as two 32-bit numbers each."""
    return np.array(counts, "<u8").view("<u4")


def _counts(data: list[bytes]) -> np.ndarray:
    parts = [unpack_numbers(x).view("<u8") for x in data]
    return np.concatenate([np.empty(0, "<u8"), *parts]).astype(np.int64)


def _classes(own: dict, frequent: dict[bytes, int]) -> np.ndarray:
    """The class of each word of a block."""
    words = [w for packed in own["words"] for w in unpack_words(packed)]
    found = np.fromiter((frequent.get(w, -1) for w in words), np.int64, len(words))
    rest = np.flatnonzero(found < 0)
    found[rest] = [tail(words[i]) for i in rest]
    return found[bucket_order(own)]


def _tokens(own: dict, limit: int = SLICE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, token, token before) in slices; a token is a word's number, or -1 for an end."""
    places = unpack_numbers(own["places"])
    sizes = np.array(own["sizes"], np.int64)
    at, doc, n = 0, 0, len(sizes)
    ends = np.cumsum(sizes)
    while doc < n:
        stop = max(doc + 1, int(np.searchsorted(ends, at + limit, "right")))
        size = sizes[doc:stop]
        owner = np.repeat(np.arange(doc, stop), size + 1)
        last = np.cumsum(size + 1) - 1
        token = np.full(len(owner), -1, np.int64)
        inside = np.ones(len(owner), bool)
        inside[last] = False
        token[inside] = places[at : at + size.sum()]
        before = np.concatenate([[-1], token[:-1]])  # an end comes before a first word
        for i in range(0, len(token), limit):
            yield owner[i : i + limit], token[i : i + limit], before[i : i + limit]
        at += int(size.sum())
        doc = stop


def count_pairs(blocks: DataFrame, frequent: dict[bytes, int], path: str) -> np.ndarray:
    """(CLASSES, CLASSES): how often a class follows another in the training texts.

    Each task adds up its blocks; parts of ``ROWS`` contexts of all tasks are added by others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros(CLASSES * CLASSES, np.int64)
        for batch in batches:
            for file in batch.column("file"):
                own = own_of(file.as_py(), path)
                kind = np.append(_classes(own, frequent), END)
                training = np.array([trains(i) for i in own["ids"]], bool)
                for owner, token, before in _tokens(own):
                    used = training[owner]
                    codes = kind[before[used]] * CLASSES + kind[token[used]]
                    pairs += np.bincount(codes, minlength=len(pairs))
        cuts = np.split(pairs, np.arange(ROWS, CLASSES, ROWS) * CLASSES)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(range(len(cuts)), pa.int32()),
                pa.array([pack_numbers(x.view("<u4")) for x in cuts], pa.binary()),
            ],
            ["part", "pairs"],
        )

    def add(rows: pa.Table) -> pa.Table:
        sums = sum(unpack_numbers(x.as_py()).view("<i8") for x in rows.column("pairs"))
        return pa.table(
            {
                "part": rows["part"][:1].combine_chunks(),
                "pairs": pa.array([pack_numbers(sums.view("<u4"))], pa.binary()),
            }
        )

    schema = "part int, pairs binary"
    parts = blocks.select("file").mapInArrow(run, schema).groupBy("part").applyInArrow(add, schema)
    found = sorted(parts.collect())  # CLASSES / ROWS rows of a fixed size
    if not found:
        return np.zeros((CLASSES, CLASSES))
    pairs = np.concatenate([unpack_numbers(bytes(r.pairs)).view("<i8") for r in found])
    return pairs.reshape(CLASSES, CLASSES).astype(np.float64)


def fit(pairs: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """(contexts, classes) log10 probabilities of a log-bilinear model fitted to ``pairs``."""
    n, total = len(pairs), pairs.sum()
    noise = (pairs.sum(axis=0) + 1) / (total + n)
    if not total:
        return np.full((n, n), -np.log10(n))
    data = (pairs / total).astype(np.float32)
    against = (pairs.sum(axis=1, keepdims=True) / total * noise * NOISE).astype(np.float32)
    rng = np.random.default_rng(3)
    shape = [(n, DIMENSION), (DIMENSION, DIMENSION), (n, DIMENSION), (n,)]
    r, c, q, b = (rng.standard_normal(s).astype(np.float32) * 0.1 for s in shape)
    c += np.eye(DIMENSION, dtype=np.float32)
    b[:] = np.log(noise)
    offset = np.log(NOISE * noise).astype(np.float32)
    values = [r, c, q, b]
    first = [np.zeros_like(v) for v in values]
    second = [np.zeros_like(v) for v in values]
    for step in range(1, steps + 1):
        context = r @ c
        odds = 1 / (1 + np.exp(np.clip(offset - b - context @ q.T, -30, 30)))
        slope = data * (1 - odds) - against * odds
        back = slope @ q
        slopes = [back @ c.T, r.T @ back, slope.T @ context, slope.sum(axis=0)]
        rate = RATE * (1 - step / (steps + 1))
        for v, g, m1, m2 in zip(values, slopes, first, second):
            m1 += 0.1 * (g - m1)
            m2 += 0.01 * (g * g - m2)
            v += rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-9)
    return log_probabilities(r, c, q, b)


def log_probabilities(r, c, q, b) -> np.ndarray:
    """The normalised model, contexts by classes, in base 10."""
    scores = (r @ c @ q.T + b).astype(np.float64)
    scores -= scores.max(axis=1, keepdims=True)
    return (scores - np.log(np.exp(scores).sum(axis=1, keepdims=True))) / np.log(10)


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    spark = docs.sparkSession
    path = fresh_dir(spark, "texts")
    blocks = pack(docs.select("doc_id", "text"), path, lower=True, counted=trains)
    counted = count_words(blocks)
    words, seen, total = vocabulary(counted)
    frequent = {w: i for i, (_, w) in enumerate(words)}
    pairs = count_pairs(blocks, frequent, path)
    ends = int(pairs[:, END].sum())
    n_train, n_kinds = int(total.sum()) + ends, int(seen.sum()) + bool(ends)
    for n, w in words:
        seen[tail(w) - FREQUENT] -= 1
        total[tail(w) - FREQUENT] += n
    model = fit(pairs).astype(np.float32)
    # What a tail class's words share: a frequent word or the end is all of its class.
    inside = np.concatenate([np.zeros(FREQUENT), np.log10(total + seen + 1.0), [0.0]])

    def run(rows: pa.Table) -> pa.Table:
        own, found = parts_of(rows, path)
        count = np.append(_counts(found)[bucket_order(own)], ends)
        kind = np.append(_classes(own, frequent), END)
        base = np.log10(count + 1.0) - np.log10(n_train + n_kinds + 1.0)
        is_tail = (kind >= FREQUENT) & (kind < END)
        word = np.where(is_tail, np.log10(count + 1.0) - inside[kind], 0.0)
        n = len(own["ids"])
        known, base_sum, model_sum = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
        for owner, token, before in _tokens(own):
            known += np.bincount(owner, count[token] > 0, n).astype(np.int64)
            base_sum += np.bincount(owner, base[token], n)
            model_sum += np.bincount(owner, model[kind[before], kind[token]] + word[token], n)
        return pa.table(
            {
                "doc_id": pa.array(own["ids"], pa.int64()),
                "held_out": pa.array([is_held_out(i) for i in own["ids"]]),
                "n_tokens": pa.array(np.array(own["sizes"], np.int64) + 1),
                "n_known": pa.array(known),
                "train_tokens": pa.array([n_train] * n, pa.int64()),
                "base_score": pa.array(base_sum),
                "score": pa.array(model_sum),
            }
        )

    schema = (
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
        "base_score double, score double"
    )
    return by_block(blocks, counted.filter("data IS NOT NULL"), run, schema)


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


QUERIES = [Query("op7_lm_scoring", op7_lm_scoring)]
