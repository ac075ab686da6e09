"""Operator 12: maximal periodic runs of words, found by multi-scale minimizers.

A run is a stretch of words with smallest period ``q`` and length ``max(LEAST, 2 * q)`` or more that
no neighbouring word extends with that period. All runs of a text are found.

1. Periods below ``SHORT``: each lag is scanned directly, for stretches where words that far apart
   are equal.
2. Periods from ``scale`` up to twice the scale, for each power of two: in each window of grams,
   the leftmost one with the smallest hash is picked. A window and its gram are shorter than
   half a period, so inside a run some window stands again one period on, and picks the same gram. Picks of
   equal grams at such a distance are seeds.
3. A gram that overlaps its own next pick by half lies in a run of a shorter period. Such picks form
   chains, evenly spaced. Two chains are paired by each one's first place with every place of the
   other, which covers all distances between them, so constant stretches don't give all pairs.
4. Seeds grow both ways as far as words that far apart are equal, by bisection over hashes of blocks.
   Each stretch found is compared word by word before it counts. Of equal stretches the smallest
   period is kept; a multiple of it is no smallest period.

Texts are independent, so nothing is shuffled; a task joins the texts of a batch, with a
mark between any two, and works on ``BATCH_WORDS`` words at a time, or on one longer text.

Null and empty texts, and those under ``LEAST`` words, have no runs. Repeated rows are each searched.
Null ids stay null. Empty tables give empty tables. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tractlake.llm.base import Query, in_parts, table, utf8, word_numbers

LEAST, SHORT, BATCH_WORDS = 12, 16, 1_000_000
#: Bytes of texts that a task looks at together.
PART = 6_000_000
#: An odd multiplier and its inverse, for block hashes that wrap at 64 bits.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2**64, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    have = 1
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * np.uint64(pow(base, have, 2**64))
        have += more
    return out


class Blocks:
    """Hashes of any stretch of ``x``, a number for each word."""

    def __init__(self, x: np.ndarray):
        # Numbers are spread over 64 bits first (the finisher of splitmix64).
        z = x.astype(np.uint64) * np.uint64(BASE) + np.uint64(BASE)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
        n = len(x)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(z * powers(BASE, n), out=self.sums[1:])
        self.inverse = powers(INVERSE, n + 1)

    def __call__(self, start: np.ndarray, length: int) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.inverse[start]

    def all(self, length: int) -> np.ndarray:
        last = len(self.sums) - length
        return (self.sums[length:] - self.sums[:last]) * self.inverse[:last]


def stretches(at: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each stretch of ``least`` or more consecutive numbers."""
    if len(at) < least:
        return at[:0], at[:0]
    cut = np.flatnonzero(np.diff(at) != 1)
    first, last = at[np.r_[0, cut + 1]], at[np.r_[cut, len(at) - 1]]
    long = last - first + 1 >= least
    return first[long], last[long]


def lag_runs(x: np.ndarray, lag: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the stretches of the shortest length or more with period ``lag``."""
    least = max(LEAST, 2 * lag) - lag
    first, last = stretches(np.flatnonzero(x[lag:] == x[:-lag]), least)
    return first, last + 1 + lag


def picks(keys: np.ndarray, window: int) -> np.ndarray:
    """Places that some ``window`` consecutive keys have as their leftmost smallest."""
    n = len(keys)
    bits = n.bit_length()
    packed = (keys >> np.uint64(bits) << np.uint64(bits)) | np.arange(n, dtype=np.uint64)
    span = 1
    while span < window:  # smallest of ``span`` keys, then of up to twice as many
        step = min(span, window - span)
        packed = np.minimum(packed[:-step], packed[step:])
        span += step
    return np.unique(packed & np.uint64((1 << bits) - 1)).astype(np.int64)


def seeds(x: np.ndarray, blocks: Blocks, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, lag) with lags from ``scale`` to twice that, one at least in each run of such a period."""
    gram = window = scale // 4
    none = np.empty(0, np.int64)
    if len(x) < 2 * scale:
        return none, none
    keys = blocks.all(gram)
    at = picks(keys, window)
    key = keys[at]
    order = np.argsort(key, kind="stable")  # by key, then by place
    key, at = key[order], at[order]
    same = key[1:] == key[:-1]
    if not same.any():
        return none, none
    twice = np.r_[same, False] | np.r_[False, same]
    key, at = key[twice], at[twice]
    group = np.cumsum(np.r_[True, key[1:] != key[:-1]]) - 1
    gap = np.diff(at)
    linked = (group[1:] == group[:-1]) & (gap <= gram // 2)
    # The shortest period of a gram divides all gaps inside its chains.
    spacing = np.zeros(group[-1] + 1, np.int64)
    if linked.any():
        where, which = group[1:][linked], gap[linked]
        begin = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
        spacing[where[begin]] = np.gcd.reduceat(which, begin)
    begin = np.flatnonzero(np.r_[True, ~linked])
    end = np.r_[begin[1:], len(at)] - 1
    first, last, group = at[begin], at[end], group[begin]
    step = np.maximum(spacing[group], 1)
    # All places of all chains.
    count = (last - first) // step + 1
    chain = np.repeat(np.arange(len(first)), count)
    nth = np.arange(len(chain)) - np.repeat(np.cumsum(count) - count, count)
    place = first[chain] + nth * step[chain]
    # Chains are in order of group and first place, so one sorted axis finds all partners.
    width = np.int64(len(x) + 4 * scale)
    axis = group * width + first
    here = group[chain] * width + place
    out = []
    for low, high in ((scale, 2 * scale), (1 - 2 * scale, 1 - scale)):
        a = np.searchsorted(axis, here + low)
        many = np.searchsorted(axis, here + high) - a
        row = np.repeat(np.arange(len(here)), many)
        partner = np.repeat(a, many) + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        other = partner != chain[row]
        own, far = place[row[other]], first[partner[other]]
        out.append((np.minimum(own, far), np.abs(far - own)))
    return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def grow(x: np.ndarray, blocks: Blocks, place: np.ndarray, lag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the stretch with period ``lag`` around each seed."""
    n = len(x)
    right, left = place.copy(), place.copy()
    step = 1 << max(n.bit_length() - 1, 0)
    while step:
        for ahead in (True, False):
            if ahead:
                may = np.flatnonzero(right + lag + step <= n)
                a = right[may]
            else:
                may = np.flatnonzero(left >= step)
                a = left[may] - step
            equal = blocks(a, step) == blocks(a + lag[may], step)
            if ahead:
                right[may[equal]] += step
            else:
                left[may[equal]] -= step
        step >>= 1
    return left, right + lag


def runs_of(x: np.ndarray) -> np.ndarray:
    """Rows (start, end, smallest period) of all runs, by start and period. No run crosses a unique number."""
    found = []
    for lag in range(1, min(SHORT, len(x))):
        start, end = lag_runs(x, lag)
        found.append(np.stack([start, end, np.full(len(start), lag)], axis=1))
    if len(x) >= 2 * SHORT:
        blocks, scale = Blocks(x), SHORT
        while 2 * scale <= len(x):
            place, lag = seeds(x, blocks, scale)
            start, end = grow(x, blocks, place, lag)
            long = end - start >= np.maximum(LEAST, 2 * lag)
            rows = np.unique(np.stack([start[long], end[long], lag[long]], axis=1), axis=0)
            sound = [np.array_equal(x[s : e - q], x[s + q : e]) for s, e, q in rows]
            if not all(sound):  # two blocks with one hash: scan these lags
                for q in np.unique(rows[~np.array(sound), 2]):
                    start, end = lag_runs(x, int(q))
                    found.append(np.stack([start, end, np.full(len(start), q)], axis=1))
                rows = rows[sound]
            found.append(rows)
            scale *= 2
    rows = np.concatenate(found) if found else np.empty((0, 3), np.int64)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    fresh = np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)] if len(rows) else []
    rows = rows[fresh]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def runs_of_texts(texts: list[np.ndarray]) -> list[np.ndarray]:
    """``runs_of`` for each text of word numbers below 2**40, several at a time."""
    out: list[np.ndarray] = [np.empty((0, 3), np.int64)] * len(texts)
    # Texts of like length go together, as long ones have more scales.
    order = sorted((i for i, t in enumerate(texts) if len(t) >= LEAST), key=lambda i: len(texts[i]))
    while order:
        now, total = [], 0
        longest = 2 * len(texts[order[0]])
        while order and (not now or (len(texts[order[0]]) <= longest and total + len(texts[order[0]]) <= BATCH_WORDS)):
            now.append(order.pop(0))
            total += len(texts[now[-1]]) + 1
        starts = np.cumsum([0] + [len(texts[i]) + 1 for i in now])
        joined = np.empty(starts[-1], np.int64)
        for k, i in enumerate(now):
            joined[starts[k] : starts[k + 1] - 1] = texts[i]
            joined[starts[k + 1] - 1] = (1 << 40) + k
        rows = runs_of(joined)
        at = np.searchsorted(rows[:, 0], starts)
        for k, i in enumerate(now):
            own = rows[at[k] : at[k + 1]].copy()
            own[:, :2] -= starts[k]
            out[i] = own
    return out


Rearrange = Callable[[int | None, int], np.ndarray | None]


def search(
    docs: DataFrame,
    row: Callable[[list[bytes], np.ndarray], tuple],
    columns: dict[str, tuple[str, pa.DataType]],
    rearrange: Rearrange | None = None,
) -> DataFrame:
    """(doc_id, columns): what ``row`` makes of each text's words and runs.

    ``rearrange`` gives, for an id and a number of words, the words' new order, or None.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches, "__text", PART):
            ids = batch.column("doc_id").to_pylist()
            texts = []
            for doc, text in zip(ids, batch.column("__text")):
                words = text.as_py().split()
                order = rearrange(doc, len(words)) if rearrange else None
                if order is not None:
                    words = [words[i] for i in order.tolist()]
                texts.append(words)
            numbers = np.split(word_numbers(texts)[0], np.cumsum([len(t) for t in texts])[:-1])
            values = [row(words, runs) for words, runs in zip(texts, runs_of_texts(numbers))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64())]
                + [pa.array([v[i] for v in values], kind) for i, (_, kind) in enumerate(columns.values())],
                ["doc_id", *columns],
            )

    schema = ", ".join(["doc_id long", *[f"{n} {kind}" for n, (kind, _) in columns.items()]])
    return docs.select(F.col("doc_id").cast("long"), utf8().alias("__text")).mapInArrow(run, schema)


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words without those that stand in a run after its first period, joined by blanks."""
    if not len(runs):
        return b" ".join(words)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 1], -1)
    keep = np.flatnonzero(np.cumsum(edges)[:-1] == 0)
    return b" ".join([words[i] for i in keep.tolist()])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, runs, text): every run as (start, length, period), and the text with each run cut to one period."""
    kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))

    def row(words: list[bytes], runs: np.ndarray) -> tuple:
        found = [{"start": int(s), "length": int(e - s), "period": int(q)} for s, e, q in runs]
        return found, collapsed(words, runs).decode()

    columns = {
        "runs": ("array<struct<start:long,length:long,period:long>>", kind),
        "text": ("string", pa.string()),
    }
    return search(docs, row, columns)


def digest(words: list[bytes], runs: np.ndarray) -> tuple:
    """Number of runs, the longest, and hashes of all runs and of the collapsed text."""
    length = runs[:, 1] - runs[:, 0]
    longest = (None,) * 4
    if len(runs):
        i = np.lexsort((runs[:, 2], runs[:, 0], -length))[0]
        n, q = int(length[i]), int(runs[i, 2])
        longest = (int(runs[i, 0]), n, q, 1000 * n // q)
    listed = "".join(f"{s},{n},{q}\n" for (s, _, q), n in zip(runs.tolist(), length.tolist()))
    return (
        len(runs),
        *longest,
        hashlib.sha256(listed.encode()).hexdigest(),
        hashlib.sha256(collapsed(words, runs)).hexdigest(),
    )


DIGEST = {
    **{n: ("long", pa.int64()) for n in ("n_runs", "start", "length", "period", "exponent_milli")},
    **{n: ("string", pa.string()) for n in ("runs_sha256", "collapsed_sha256")},
}


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """For a tenth of the ids: from some word on, the text repeats a stretch of itself."""
    h = zlib.crc32(str("" if doc_id is None else doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.r_[np.arange(a), a + np.arange(n - a) % p]


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), digest, DIGEST, planted)


QUERIES = [Query("op12_periodic_runs", op12_periodic_runs)]
