"""Operator 13: importance resampling towards a target distribution, by hashed n-gram buckets.

A document's features are its runs of 1 to ``size`` consecutive words, repeats counted. A feature
belongs to the bucket that the CRC-32 of its bytes names. A bucket's gain is the logarithm of how
much more often the target texts use it than the corpus does; a document's weight is the sum
of its features' gains. Adding Gumbel noise to the weights and taking the greatest scores draws
without replacement, in proportion to the weights' exponentials.

The vocabulary has a head and a tail. Head words are those that tasks count most often; their
CRC states, and the buckets of the most frequent pairs, go to all tasks, in tables of at most
``HEAD`` entries of ``LONGEST`` bytes each. A longer feature carries on from its first word's
state. All other features take their CRC directly. Head and tail feed the same exact totals,
so the choice of the head has no influence on results.

The driver sees the head and one row for each bucket, whose number is a parameter. Ranks come from a
range sort over all tasks and the number of rows in each range.

Null and empty texts have no features and weight 0. A null id is the empty text where noise is
drawn, and comes last among ties. Repeated rows are drawn each; rows equal in score and id may
swap ranks. Empty targets make all gains follow the corpus alone; empty tables give
empty tables. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tractlake.llm.base import Query, materialize, table, utf8, width

#: Entries of the head, bytes of an entry, and different features that a task counts at a time.
HEAD, LONGEST, COUNTED = 16_384, 64, 400_000
LETTERS = bytes(c if chr(c).isalnum() or c >= 0x80 else 0x20 for c in range(0x80)) + bytes(range(0x80, 0x100))


def words_of(text: bytes) -> list[bytes]:
    """Runs of digits, letters and everything outside ASCII; A-Z are lower-cased, nothing else."""
    return text.lower().translate(LETTERS).split()


def head(docs: DataFrame, size: int = 1, most: int = HEAD) -> tuple[list[bytes], list[bytes]]:
    """The words and the pairs that tasks count most often, at most ``most`` of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [Counter(), Counter()]
        for batch in batches:
            for text in batch.column("__text"):
                words = words_of(text.as_py())
                counts[0].update(words)
                if size > 1:
                    counts[1].update(map(b" ".join, zip(words, words[1:])))
            for i, counted in enumerate(counts):
                if len(counted) > COUNTED:
                    counts[i] = Counter(dict(counted.most_common(COUNTED // 4)))
        for kind, counted in enumerate(counts):
            top = [(f, n) for f, n in counted.most_common(most) if n > 1 and len(f) <= LONGEST]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([kind] * len(top), pa.int32()),
                    pa.array([f for f, _ in top], pa.binary()),
                    pa.array([n for _, n in top], pa.int64()),
                ],
                ["kind", "feature", "n"],
            )

    counts = docs.select(utf8().alias("__text")).mapInArrow(run, "kind int, feature binary, n long")
    sums = materialize(counts.groupBy("kind", "feature").agg(F.sum("n").alias("n")), "head")
    found = []
    for kind in range(2):
        rows = sums.filter(F.col("kind") == kind).orderBy(F.desc("n"), "feature").limit(most)
        found.append([bytes(r.feature) for r in rows.select("feature").collect()])
    return found[0], found[1]


class States(dict):
    """CRC states of the head's words; any other word's is worked out directly."""

    def __missing__(self, word: bytes) -> int:
        return zlib.crc32(word)


class Features:
    """The buckets of a text's features."""

    def __init__(self, words: list[bytes], pairs: list[bytes], buckets: int, size: int = 1):
        self.buckets, self.size = buckets, size
        self.states = States((w, zlib.crc32(w)) for w in words)
        self.pairs = {tuple(p.split(b" ")): zlib.crc32(p) for p in pairs}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        states = list(map(self.states.__getitem__, words))
        found = [states]
        for length in range(2, self.size + 1):
            last = words[length - 1 :]
            if length == 2:
                known = map(self.pairs.get, zip(words, last))
                states = [
                    k if k is not None else zlib.crc32(b" " + w, s) for k, s, w in zip(known, states, last)
                ]
            else:
                states = [zlib.crc32(b" " + w, s) for s, w in zip(states, last)]
            found.append(states)
        flat = [s for part in found for s in part] if len(found) > 1 else states
        return np.fromiter(flat, np.int64, len(flat)) % self.buckets


def totals(docs: DataFrame, features: Features) -> np.ndarray:
    """How many features of all texts each bucket holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(features.buckets, np.int64)
        for batch in batches:
            for text in batch.column("__text"):
                sums += np.bincount(features(words_of(text.as_py())), minlength=features.buckets)
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int64()), pa.array(sums[used], pa.int64())], ["bucket", "n"]
        )

    counts = docs.select(utf8().alias("__text")).mapInArrow(run, "bucket long, n long")
    out = np.zeros(features.buckets, np.int64)
    for bucket, n in counts.groupBy("bucket").agg(F.sum("n")).collect():  # one row a bucket
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray, scale: int = 1000) -> np.ndarray:
    """floor(scale * ln((t + 1) / (T + buckets) * (S + buckets) / (s + 1))) of each bucket."""
    n, all_s, all_t = len(source), float(source.sum()), float(target.sum())
    return np.array(
        [
            math.floor(scale * math.log((t + 1.0) * (all_s + n) / ((s + 1.0) * (all_t + n))))
            for s, t in zip(source.tolist(), target.tolist())
        ],
        np.int64,
    )


def weigh(docs: DataFrame, features: Features, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = []
            for text in batch.column("__text"):
                words = words_of(text.as_py())
                found = features(words)
                values.append((len(words), len(found), int(gain[found].sum())))
            columns = [[v[i] for v in values] for i in range(3)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns]],
                ["doc_id", "n_words", "n_features", "weight"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), utf8().alias("__text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int, scale: int = 1000) -> Column:
    """floor(-scale * ln(-ln(u))) for a u in (0, 1) that seed and id decide."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    u = (h + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-float(scale)) * F.log(-F.log(u))).cast("long")


def ranked(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """``df`` with ``rank`` from 1 in ``order``. Ranges are sorted each by a task, and counted."""
    salted = df.withColumn("__salt", F.rand(13))  # splits rows that are equal in all of ``order``
    stored = materialize(salted, "unsorted")
    keys = [*order, F.col("__salt")]
    placed = (
        stored.repartitionByRange(width(df.sparkSession), *keys)
        .sortWithinPartitions(*keys)
        .withColumn("__place", F.monotonically_increasing_id())
    )
    placed = materialize(placed, "sorted").withColumn("__part", F.shiftright("__place", 33))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    # One row for each range.
    starts = sizes.select("__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    at = F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        placed.join(materialize(starts, "starts"), "__part")
        .withColumn("rank", (at + F.col("__before") + F.lit(1)).cast("long"))
        .select(*df.columns, "rank")
    )


def resampled(
    docs: DataFrame,
    targets: DataFrame,
    buckets: int = 10_000,
    size: int = 1,
    seed: int = 2024,
    percent: int = 10,
    least_words: int = 20,
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row; rank is null if not drawn.

    Drawn are floor(percent * N / 100) of the N documents with ``least_words`` or more.
    """
    words, pairs = head(docs, size)
    features = Features(words, pairs, buckets, size)
    gain = gains(totals(docs, features), totals(targets, features))
    scored = weigh(docs, features, gain)
    scored = scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = scored.withColumn("__open", F.col("n_words") >= least_words)
    order = [F.desc("__open"), F.desc("score"), F.asc_nulls_last("doc_id")]
    all_ranked = ranked(scored, order)
    drawn = percent * all_ranked.filter("__open").count() // 100
    rank = F.when(F.col("__open") & (F.col("rank") <= drawn), F.col("rank"))
    return all_ranked.withColumn("rank", rank).drop("__open")


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


# CRC-32 byte by byte, over each distinct word once.
OP13_SQL = r"""
WITH codes AS (
  SELECT list(code ORDER BY i) AS of_byte FROM (
    SELECT i, list_reduce(range(8),
      lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS code
    FROM (SELECT unnest(range(256)) AS i))
), tokens AS (
  SELECT doc_id, unnest(words) AS word FROM (
    SELECT doc_id, regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents)
), target AS (
  SELECT unnest(regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark
), words AS (
  SELECT word, xor(list_reduce(
      list_transform(range(len(hex(encode(word))) // 2),
                     lambda i: CAST('0x' || substr(hex(encode(word)), 2 * i + 1, 2) AS BIGINT)),
      lambda c, b: xor(c >> 8, of_byte[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket
  FROM (SELECT word FROM tokens UNION SELECT word FROM target), codes
), s AS (
  SELECT bucket, count(*) AS n FROM tokens JOIN words USING (word) GROUP BY bucket
), t AS (
  SELECT bucket, count(*) AS n FROM target JOIN words USING (word) GROUP BY bucket
), gain AS (
  SELECT b AS bucket, CAST(floor(1000 * ln(
      CAST((coalesce(t.n, 0) + 1) * ((SELECT count(*) FROM tokens) + 10000) AS DOUBLE)
      / CAST((coalesce(s.n, 0) + 1) * ((SELECT count(*) FROM target) + 10000) AS DOUBLE))) AS BIGINT) AS gain
  FROM (SELECT unnest(range(10000)) AS b) LEFT JOIN s ON s.bucket = b LEFT JOIN t ON t.bucket = b
), weights AS (
  SELECT doc_id, count(*) AS n, sum(gain) AS weight
  FROM tokens JOIN words USING (word) JOIN gain USING (bucket) GROUP BY doc_id
), scored AS (
  SELECT d.doc_id, coalesce(n, 0) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln(
      (CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM documents d LEFT JOIN weights USING (doc_id)
), places AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place
  FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score,
       CASE WHEN place <= (SELECT 10 * count(*) // 100 FROM places) THEN place END AS rank
FROM scored LEFT JOIN places USING (doc_id)
"""

QUERIES = [Query("op13_importance", op13_importance, OP13_SQL)]
