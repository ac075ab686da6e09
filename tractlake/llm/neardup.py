"""Operator 8: near-duplicates by SuperMinHash, banding, exact checks and components.

A document's set holds its distinct five-word shingles, words lower-cased in A-Z; a shorter
text is one shingle. Two documents are linked if ``100 * common >= percent * all`` of their
shingles, 85 in the query and 80 in the pipeline; a component is what links connect.

1. One pass over the texts hashes the shingles and makes a SuperMinHash signature: each
   shingle writes, in steps ``j = 0, 1, ...``, the value ``j + uniform`` to the place that a
   random permutation of its own gives it, and each place keeps the smallest. The places of
   one shingle are all different, so signatures vary less than with independent hashes, and
   a document is done when its largest value is below ``j``, mostly after a few steps.
2. Documents with equal sets are one class, named by its smallest id.
3. ``BANDS`` bands of ``ROWS`` values: classes that agree in a band are candidates. A link
   of exactly 0.85 is missed with probability ``(1 - 0.85^ROWS)^BANDS``, under 3 in 10
   million, and one of exactly 0.80 with 6 in 100,000.
4. Candidates that hang together meet in cells. A large group is cut into blocks, and each
   pair of blocks is a cell, so no group is ever in one task. A cell compares whole shingle
   sets and returns a spanning forest of its links, never all pairs.
5. Components over the forests give the smallest id.

Null or empty texts, or texts without a word, have no set and are linked with nothing.
The id is the document: rows that repeat an id are one vertex. Rows without an id have no
component (null) and are kept. Empty tables give empty tables. Input columns with an output's
name are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tractlake.llm.base import Query, materialize, table, utf8, width
from tractlake.llm.components import components

SHINGLE = 5
BANDS, ROWS = 32, 6
PLACES = BANDS * ROWS
PERCENT = 85
#: Shingles of a vectorised step; shingles of a block at most; rows of a block, least and most.
STEP_SHINGLES = 128_000
BLOCK_SHINGLES = 1_000_000
BLOCK_ROWS = (128, 2_048)

_SEEDS = np.random.default_rng(20240501)
MULTIPLY = _SEEDS.integers(1, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BAND_MULTIPLY = _SEEDS.integers(1, 2**63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A random-looking one-to-one map of 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, known: dict[bytes, int]) -> np.ndarray:
    """The sorted hashes of the set. ``known`` keeps the words' hashes."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    hashes = np.empty(n, np.uint64)
    for i, word in enumerate(words):
        value = known.get(word)
        if value is None:
            value = known[word] = xxhash.xxh3_64_intdigest(word)
        hashes[i] = value
    size = min(n, SHINGLE)
    sums = np.full(n - size + 1, size, np.uint64)  # the length keeps short texts apart
    for k in range(size):
        sums += hashes[k : n - size + 1 + k] * MULTIPLY[k]
    return np.unique(mixed(sums))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """SuperMinHash signatures (len(sets), PLACES) of sets that aren't empty.

    A signature is the smallest of those of a set's parts, so large sets go in parts.
    """
    parts, starts = [], []
    for one in sets:
        starts.append(len(parts))
        parts += [one[i : i + STEP_SHINGLES] for i in range(0, len(one), STEP_SHINGLES)]
    done, pending, total = [], [], 0
    for part in parts:
        if pending and total + len(part) > STEP_SHINGLES:
            done.append(_signatures(pending))
            pending, total = [], 0
        pending.append(part)
        total += len(part)
    return np.minimum.reduceat(np.concatenate([*done, _signatures(pending)]), starts, axis=0)


def _signatures(sets: list[np.ndarray]) -> np.ndarray:
    m = PLACES
    out = np.full((len(sets), m), np.inf)
    values = out.reshape(-1)
    element = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    places = None
    for j in range(m):
        if j:
            # A step adds values of j and more: sets whose values are all smaller are done.
            active = (out.max(axis=1) > j)[owner]
            if not active.all():
                element, owner, places = element[active], owner[active], places[active]
            if not len(element):
                break
        bits = mixed(element + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % 2**64))
        uniform = (bits >> np.uint64(32)).astype(np.float64) * 2.0**-32
        pick = j + ((bits & np.uint64(0xFFFFFFFF)) * np.uint64(m - j) >> np.uint64(32)).astype(
            np.int64
        )
        # One step of a shuffle: the picked place comes to position j.
        if j == 0:
            places = np.tile(np.arange(m, dtype=np.uint8), (len(element), 1))
        rows = np.arange(len(element))
        place = places[rows, pick]
        places[rows, pick] = places[:, j]
        places[:, j] = place
        np.minimum.at(values, owner * m + place, uniform + j)
    return out


def band_hashes(signature: np.ndarray) -> np.ndarray:
    """(sets, BANDS) hashes, each of a band's number and its values."""
    bits = signature.view(np.uint64).reshape(-1, BANDS, ROWS)
    sums = (mixed(bits) * BAND_MULTIPLY).sum(axis=2, dtype=np.uint64)
    return mixed(sums + mixed(np.arange(1, BANDS + 1, dtype=np.uint64))).view(np.int64)


def _bytes(batch: pa.RecordBatch, column: str) -> Iterator[bytes]:
    return (value.as_py() for value in batch.column(column))


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, digest of the set, band hashes); the last two null without a set."""
    known: dict[bytes, int] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at = batch.column("doc_id"), 0
            pending: list[np.ndarray] = []
            total = 0
            for text in _bytes(batch, "__text"):
                if len(known) > 500_000:
                    known.clear()
                pending.append(shingles(text, known))
                total += len(pending[-1])
                if total >= STEP_SHINGLES:
                    yield describe(ids.slice(at, len(pending)), pending)
                    at, pending, total = at + len(pending), [], 0
            if pending:
                yield describe(ids.slice(at, len(pending)), pending)

    def describe(ids: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
        full = [s for s in sets if len(s)]
        hashed = iter(band_hashes(signatures(full)) if full else [])
        bands = [next(hashed) if len(s) else None for s in sets]
        digests = [
            hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets
        ]
        return pa.RecordBatch.from_arrays(
            [
                ids,
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array(digests, pa.binary()),
                pa.array(bands, pa.list_(pa.int64())),
            ],
            ["doc_id", "n_shingles", "digest", "bands"],
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", utf8().alias("__text")).mapInArrow(
        run, f"doc_id {kind}, n_shingles long, digest binary, bands array<long>"
    )


def linked(ids: np.ndarray, sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple]:
    """A spanning forest of the links between ``sets``.

    ``row`` counts what one set shares with all others. A set with too many shingles that no
    other has can't reach the limit and needs no row. A few sets with the fewest such shingles
    come first; the component that they build up needs no further rows of its own: a link that joins
    it to a set outside is found by that set's row.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets])
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(codes, kind="stable")
    holders = owner[order]
    counts = np.bincount(codes)
    first = np.concatenate([[0], np.cumsum(counts)])
    starts = np.concatenate([[0], np.cumsum(size)])
    own = np.bincount(owner[counts[codes] == 1], minlength=n)
    open_sets = np.flatnonzero(100 * (size - own) >= percent * size)

    parent = np.arange(n)

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    forest = []

    def join(i, j):
        a, b = root(i), root(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
            forest.append((ids[i], ids[j]))

    def row(i):
        mine = codes[starts[i] : starts[i + 1]]
        mine = mine[counts[mine] > 1]
        length = counts[mine]
        at = np.repeat(first[mine] - np.concatenate([[0], np.cumsum(length)[:-1]]), length)
        common = np.bincount(holders[at + np.arange(length.sum())], minlength=n)
        both = size[i] + size - common
        for j in np.flatnonzero((100 * common >= percent * both) & (common > 0)):
            join(i, j)

    done = np.zeros(n, bool)
    central = open_sets[np.argsort(own[open_sets] / size[open_sets], kind="stable")]
    for i in central[:8]:
        row(i)
        done[i] = True
    roots = np.array([root(i) for i in open_sets], np.int64)
    largest = np.bincount(roots).argmax() if len(roots) else -1
    for i in central:
        if not done[i] and root(i) != root(largest):
            row(i)
    return forest


def _cells(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """(cell, doc_id, set) for the documents of ``groups`` (doc_id, root, n_shingles)."""
    spark = docs.sparkSession
    least, most = BLOCK_ROWS
    rows = min(most, max(least, groups.count() // width(spark)))
    blocks = F.ceil(
        F.greatest(F.count("*") / F.lit(rows), F.sum("n_shingles") / F.lit(BLOCK_SHINGLES))
    ).cast("int")
    sizes = materialize(groups.groupBy("root").agg(blocks.alias("blocks")), "sizes")
    block = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    others = F.filter(
        F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: i != F.col("block")
    )
    placed = (
        groups.join(sizes, "root")
        .withColumn("block", block)
        .withColumn("others", F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(others))
        .select("doc_id", "root", "block", "others")
    )
    placed = materialize(placed, "blocks")
    texts = docs.select("doc_id", utf8().alias("__text")).join(placed, "doc_id")

    known: dict[bytes, int] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known.clear()
            sets = [shingles(text, known).tobytes() for text in _bytes(batch, "__text")]
            at = batch.schema.get_field_index("__text")
            columns = [pa.array(sets, pa.binary()) if i == at else c for i, c in enumerate(batch.columns)]
            names = ["set" if name == "__text" else name for name in batch.schema.names]
            yield pa.RecordBatch.from_arrays(columns, names)

    sets = texts.mapInArrow(
        run, "doc_id long, set binary, root long, block int, others array<int>"
    )
    each = sets.select("doc_id", "set", "root", "block", F.explode("others").alias("other"))
    return each.select(
        "doc_id",
        "set",
        "root",
        F.least("block", "other").alias("one"),
        F.greatest("block", "other").alias("two"),
    )


def _links(cells: DataFrame, percent: int) -> DataFrame:
    def run(rows: pa.Table) -> pa.Table:
        ids = rows.column("doc_id").to_numpy()
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in rows.column("set")]
        full = [i for i, s in enumerate(sets) if len(s)]
        found = linked(ids[full], [sets[i] for i in full], percent) if len(full) > 1 else []
        return pa.table(
            {
                "a": pa.array([int(a) for a, _ in found], pa.int64()),
                "b": pa.array([int(b) for _, b in found], pa.int64()),
            }
        )

    return cells.groupBy("root", "one", "two").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of ``docs``."""
    described = materialize(features(docs.select("doc_id", "text")), "signatures")
    owned = described.filter("doc_id IS NOT NULL AND n_shingles > 0")
    # Stored, so that joins with it deal both sides out anew and can split a set with many copies.
    classes = materialize(owned.groupBy("digest").agg(F.min("doc_id").alias("doc_id")), "classes")
    named = owned.join(classes, ["digest", "doc_id"], "left_semi").select(
        "doc_id", "n_shingles", "bands"
    )
    banded = named.select("doc_id", F.explode("bands").alias("band"))
    met = (
        banded.groupBy("band")
        .agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
        .filter("least < most")
        .select("band", "least")
    )
    met = materialize(met, "bands")
    meetings = (
        banded.join(met, "band").filter("doc_id <> least").select("doc_id", "least").distinct()
    )
    candidates = components(meetings, "doc_id", "least")
    members = candidates.select(F.col("node").alias("doc_id"), "root").unionByName(
        candidates.select(F.col("root").alias("doc_id"), "root").distinct()
    )
    groups = materialize(
        members.join(named.select("doc_id", "n_shingles"), "doc_id").dropDuplicates(["doc_id"]),
        "candidates",
    )
    names = classes.withColumnRenamed("doc_id", "__class")
    # An id with several texts is one vertex: it connects their classes.
    placed = owned.select("doc_id", "digest").join(names, "digest")
    mixed_ids = (
        placed.groupBy("doc_id")
        .agg(F.min("__class").alias("__least"), F.max("__class").alias("__most"))
        .filter("__least < __most")
    )
    same_id = placed.join(mixed_ids, "doc_id", "left_semi").select(
        F.col("__class").alias("a"), F.col("doc_id").alias("b")
    )
    links = materialize(_links(_cells(docs, groups), percent), "links")
    roots = components(links.unionByName(same_id), "a", "b")
    return (
        described.select("doc_id", "n_shingles", "digest")
        .join(names, "digest", "left")
        .join(roots.select(F.col("node").alias("__class"), "root"), "__class", "left")
        .select(
            "doc_id",
            "n_shingles",
            F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "__class", "doc_id")).alias(
                "component_id"
            ),
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` without later members of a component; of a repeated id, one row."""
    judged = materialize(near_duplicates(docs, percent), "components")
    gone = judged.filter("NOT kept").select("doc_id")
    again = judged.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1")
    again = materialize(again.select("doc_id"), "repeated")
    if again.isEmpty():
        return docs.join(materialize(gone, "gone"), "doc_id", "left_anti").select(docs.columns)
    gone = materialize(gone.distinct(), "gone")
    single = docs.join(gone.unionByName(again), "doc_id", "left_anti").select(docs.columns)
    several = docs.join(again.join(gone, "doc_id", "left_anti"), "doc_id", "left_semi")
    return single.unionByName(several.dropDuplicates(["doc_id"]).select(docs.columns))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = [Query("op8_near_dedup", op8_near_dedup)]
