"""Operator 11: repeated passages, by a compressed FM-index per shard.

A window of ``WINDOW`` words is repeated if the same words start anywhere else in the corpus; all
words that a repeated window covers go, the first occurrence as well. Windows are judged on the
texts as given.

1. Each window picks an anchor: of its grams of ``GRAM`` words, the leftmost with the smallest hash.
   Equal windows pick equal anchors, at the same offset. Anchors are counted over all texts; a
   window whose anchor stands at one place of the corpus isn't repeated.
2. Neighbouring windows with one anchor are a piece, which goes to the shard that the anchor's
   hash names. So a window meets all its equals in one shard, and pieces, not texts, are
   compared: work grows with the input, not with texts times shards.
3. A shard indexes its different pieces (``fmindex.py``) and streams them against the index, by
   backward search over the wavelet tree. Windows whose matching statistic reaches ``WINDOW`` words
   with two occurrences are reported, and their spans go back to the texts.

Shards have a bounded size: their number follows the words of all pieces, and an anchor that
stands at more than ``HOT`` places, which would be a large part of a shard, isn't indexed. Its different pieces are counted instead, and
then the windows of these, both by 128 bits of hash, and tasks combine counts before the shuffle; so
neither a frequent passage nor a large group of copies meets in one task. Of rows with the
same text one stands for all, and all their windows are repeated.

Null texts have no words. Repeated rows are repeated texts. Null ids stay null. Empty tables give
empty tables. Only ``doc_id`` and ``text`` are read, whatever other columns are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tractlake.llm.base import Query, in_parts, materialize, table, utf8, width, word_numbers
from tractlake.llm.fmindex import FMIndex, repeated_windows
from tractlake.llm.periods import Blocks

WINDOW, GRAM = 35, 12
#: Words of pieces in a shard, and places of an anchor that is counted instead of indexed.
SHARD_WORDS = 500_000
HOT = 1_000
#: Bytes of texts, and of compressed ones, that a task looks at together.
PART, PACKED_PART = 1_000_000, 400_000
ALL_ONES = np.uint64(0xFFFFFFFF)


def key_of(text: bytes) -> tuple[int, int]:
    """128 bits that name a text, as two signed numbers."""
    digest = xxhash.xxh3_128_digest(text)
    return tuple(int.from_bytes(digest[i : i + 8], "little", signed=True) for i in (0, 8))


class Windows:
    """Windows and anchors of some texts' words."""

    def __init__(self, texts: list[list[bytes]], window: int = WINDOW, gram: int = GRAM):
        sizes = np.array([len(t) for t in texts], np.int64)
        self.numbers, self.known = word_numbers(texts)
        self.window = window
        self.starts = np.cumsum(sizes) - sizes
        text = np.repeat(np.arange(len(texts)), sizes)
        n = len(self.numbers)
        self.at = self.text = self.anchor = np.empty(0, np.int64)
        if n >= window:
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, self.known), np.uint64, len(self.known))
            self.keys = Blocks(hashes[self.numbers]).all(gram)
            # Half of the bits choose, so that picks don't depend on how many texts are here.
            least = (self.keys & ~ALL_ONES) | np.arange(len(self.keys), dtype=np.uint64)
            span, most = 1, window - gram + 1
            while span < most:
                step = min(span, most - span)
                least = np.minimum(least[:-step], least[step:])
                span += step
            self.at = np.flatnonzero(text[: n - window + 1] == text[window - 1 :])
            self.text = text[self.at]
            self.anchor = (least[self.at] & ALL_ONES).astype(np.int64)

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, hash, places) of each anchor, once for each text."""
        first = np.flatnonzero(np.r_[True, self.anchor[1:] != self.anchor[:-1]]) if len(self.anchor) else []
        # Picks move to the right only, so a place's windows stand together.
        text, value = self.text[first], self.hashes(self.anchor[first])
        order = np.lexsort((value, text))
        text, value = text[order], value[order]
        new = np.r_[True, (text[1:] != text[:-1]) | (value[1:] != value[:-1])] if len(text) else np.empty(0, bool)
        begin = np.flatnonzero(new)
        return text[begin], value[begin], np.diff(np.append(begin, len(text)))

    def hashes(self, anchor: np.ndarray) -> np.ndarray:
        return self.keys[anchor].view(np.int64) if len(anchor) else np.empty(0, np.int64)

    def window_hashes(self) -> tuple[np.ndarray, ...]:
        """Twice 64 bits for the words of the window at each place."""
        out = []
        for seed in (1, 2):
            hashes = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in self.known), np.uint64, len(self.known))
            out.append(Blocks(hashes[self.numbers]).all(self.window).view(np.int64))
        return tuple(out)


def texts_in(batch: pa.RecordBatch, name: str = "__text") -> list[bytes]:
    return [t.as_py() for t in batch.column(name)]


def anchor_rows(docs: DataFrame, window: int) -> DataFrame:
    """(hash, k1, n) of each anchor of a text, and (k1, k2, doc_id) with a null hash for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches, "__text", PART):
            texts = texts_in(batch)
            keys = np.array([key_of(t) for t in texts], np.int64).reshape(-1, 2)
            text, value, places = Windows([t.split() for t in texts], window).anchors()
            none = pa.nulls(len(text), pa.int64())
            names = ["hash", "k1", "n", "k2", "doc_id"]
            yield pa.RecordBatch.from_arrays(
                [pa.array(value), pa.array(keys[text, 0]), pa.array(places, pa.int64()), none, none], names
            )
            nothing = pa.nulls(len(texts), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [nothing, pa.array(keys[:, 0]), nothing, pa.array(keys[:, 1]), batch.column("doc_id")], names
            )

    return docs.mapInArrow(run, "hash long, k1 long, n long, k2 long, doc_id long")


def packed_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, packed): texts compressed, as they are dealt out by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=5)
        for batch in in_parts(batches, "__text", PART):
            texts = texts_in(batch)
            keys = [key_of(t) for t in texts]
            arrays = [
                batch.column("doc_id"),
                *[pa.array([k[i] for k in keys], pa.int64()) for i in range(2)],
                pa.array([squeeze.compress(t) for t in texts], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "k1", "k2", "packed"])

    return docs.mapInArrow(run, "doc_id long, k1 long, k2 long, packed binary")


def unpack(batch: pa.RecordBatch) -> list[bytes]:
    expand = zstandard.ZstdDecompressor()
    return [expand.decompress(p.as_py()) for p in batch.column("packed")]


PIECES = (
    "anchor long, p1 long, p2 long, k1 long, k2 long, starts array<int>, words long, piece binary, "
    "windows array<struct<w1:long,w2:long>>"
)


def pieces(suspects: DataFrame, window: int) -> DataFrame:
    """The pieces that the texts' repeated anchors select, once for each text, with their ``starts``.

    Those of hot anchors have no anchor here, and hashes of the ``piece`` (p1, p2) and of its
    windows in place of its words. ``suspects``: k1, k2, packed, and ``spots``, the repeated anchors
    with whether they are hot.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches, "packed", PACKED_PART):
            texts = [t.split() for t in unpack(batch)]
            found = Windows(texts, window)
            value = found.hashes(found.anchor)
            state = np.zeros(len(value), np.int8)  # 1: indexed, 2: hot
            cuts = np.searchsorted(found.text, np.arange(len(texts) + 1))
            for i, spots in enumerate(batch.column("spots").to_pylist()):
                own = slice(cuts[i], cuts[i + 1])
                for kind in (1, 2):
                    chosen = [s["hash"] for s in spots if s["hot"] == (kind == 2)]
                    if chosen:
                        state[own][np.isin(value[own], chosen)] = kind
            keys = [batch.column(k).to_numpy() for k in ("k1", "k2")]
            hashes = found.window_hashes() if (state == 2).any() else ()
            rows: dict[tuple, list[int]] = {}
            used = np.flatnonzero(state)
            new = np.r_[True, np.diff(found.anchor[used]) != 0] if len(used) else np.empty(0, bool)
            begin = np.flatnonzero(new)
            end = np.append(begin[1:], len(used)) - 1
            for a, b in zip(used[begin].tolist(), used[end].tolist()):
                text = int(found.text[a])
                first = int(found.at[a] - found.starts[text])
                last = int(found.at[b] - found.starts[text]) + window
                piece = b" ".join(texts[text][first:last])
                if state[a] == 1:
                    row = (text, int(value[a]), None, None, last - first, piece, None)
                else:
                    own = slice(int(found.at[a]), int(found.at[b]) + 1)
                    each = tuple(zip(*[w[own].tolist() for w in hashes]))
                    row = (text, None, *key_of(piece), last - first, None, each)
                rows.setdefault(row, []).append(first)
            columns = list(zip(*rows)) or [()] * 7
            text = np.array(columns[0], np.int64)
            each = [None if w is None else [{"w1": x, "w2": y} for x, y in w] for w in columns[6]]
            pair = pa.list_(pa.struct([("w1", pa.int64()), ("w2", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [
                    *[pa.array(columns[i], pa.int64()) for i in (1, 2, 3)],
                    *[pa.array(k[text], pa.int64()) for k in keys],
                    pa.array(list(rows.values()), pa.list_(pa.int32())),
                    pa.array(columns[4], pa.int64()),
                    pa.array(columns[5], pa.binary()),
                    pa.array(each, pair),
                ],
                ["anchor", "p1", "p2", "k1", "k2", "starts", "words", "piece", "windows"],
            )

    return suspects.mapInArrow(run, PIECES)


SPANS = "k1 long, k2 long, spans array<struct<first:int,last:int>>"


def indexed_spans(found: DataFrame, window: int) -> DataFrame:
    """(k1, k2, spans): the words of repeated windows in pieces, found through the shards' indexes."""
    total = found.agg(F.sum("words")).first()[0] or 0
    shards = max(width(found.sparkSession), -(-total // SHARD_WORDS))

    def run(rows: pa.Table) -> pa.Table:
        known: dict[bytes, int] = {}
        of = [known.setdefault(p, len(known)) for p in rows["piece"].to_pylist()]
        starts = rows["starts"].to_pylist()
        weight = np.bincount(of, [len(s) for s in starts], len(known))
        words = [piece.split(b" ") for piece in known]
        numbers, vocabulary = word_numbers(words)
        ends = np.cumsum([len(w) for w in words])
        texts = np.split(numbers + 1, ends[:-1])
        index = FMIndex(np.insert(numbers + 1, ends, 0), len(vocabulary) + 1, window - 1)
        # A piece that stands at two places has repeated windows only.
        asked = [i for i in range(len(texts)) if weight[i] < 2]
        hits = dict(zip(asked, repeated_windows([texts[i] for i in asked], index, window)))
        keys = [rows[k].to_numpy() for k in ("k1", "k2")]
        row_of, out = [], []
        for row, (i, places) in enumerate(zip(of, starts)):
            hit = hits.get(i)
            if hit is None:
                spans = [(0, len(texts[i]))]
            elif len(hit):
                cut = np.flatnonzero(np.diff(hit) != 1)
                spans = list(zip(hit[np.r_[0, cut + 1]].tolist(), (hit[np.r_[cut, len(hit) - 1]] + window).tolist()))
            else:
                continue
            row_of.append(row)
            out.append([{"first": p + a, "last": p + b} for p in places for a, b in spans])
        row_of = np.array(row_of, np.int64)
        kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
        return pa.table(
            {
                "k1": pa.array(keys[0][row_of], pa.int64()),
                "k2": pa.array(keys[1][row_of], pa.int64()),
                "spans": pa.array(out, kind),
            }
        )

    shard = F.pmod(F.xxhash64("anchor"), F.lit(shards))
    return found.withColumn("shard", shard).select("shard", "k1", "k2", "starts", "piece").groupBy("shard").applyInArrow(run, SPANS)


def hot_spans(found: DataFrame, window: int) -> DataFrame:
    """(k1, k2, spans): the words of repeated windows in pieces of hot anchors.

    A piece that stands at two places has repeated windows only; of the others, windows are
    repeated that another piece has as well.
    """
    piece = ["p1", "p2"]
    counts = found.groupBy(*piece).agg(
        F.sum(F.size("starts")).alias("n"), F.first("words").alias("words"), F.first("windows").alias("windows")
    )
    counts = materialize(counts, "hot")
    each = counts.select(*piece, "n", F.posexplode("windows").alias("at", "w")).select(*piece, "n", "at", "w.*")
    often = each.groupBy("w1", "w2").agg(F.count("*").alias("pieces")).filter("pieces > 1")
    often = materialize(often.select("w1", "w2"), "often")
    single = each.filter("n = 1").join(often, ["w1", "w2"], "left_semi")
    hits = single.select(*piece, "at", (F.col("at") + F.lit(window)).alias("end")).unionByName(
        counts.filter("n > 1").select(*piece, F.lit(0).alias("at"), F.col("words").cast("int").alias("end"))
    )
    hits = materialize(
        hits.groupBy(*piece).agg(F.collect_list(F.struct("at", "end")).alias("hits")), "hits"
    )
    spans = F.flatten(
        F.transform(
            "starts",
            lambda s: F.transform("hits", lambda h: F.struct((s + h["at"]).alias("first"), (s + h["end"]).alias("last"))),
        )
    )
    joined = found.select(*piece, "k1", "k2", "starts").join(hits, piece)
    return joined.select("k1", "k2", spans.alias("spans"))


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(k1, k2, spans): per text that has some, the spans (first word, end) to remove; spans may overlap.

    ``docs``: doc_id long, __text binary.
    """
    anchors = materialize(anchor_rows(docs, window), "anchors")
    places = anchors.filter("hash IS NOT NULL")
    counts = places.groupBy("hash").agg(F.sum("n").alias("n")).filter("n > 1")
    often = materialize(counts.select("hash", (F.col("n") > HOT).alias("hot")), "often")
    same = anchors.filter("hash IS NULL").groupBy("k1", "k2")
    same = same.agg(F.count("*").alias("rows"), F.min("doc_id").alias("one"))
    copies = materialize(same.filter("rows > 1").select("k1", "k2", "one"), "copies")
    # By half of the key: what else has it is only looked at in vain.
    spots = places.select("hash", "k1").join(often, "hash").groupBy("k1")
    spots = materialize(spots.agg(F.collect_set(F.struct("hash", "hot")).alias("spots")), "spots")
    ones = copies.groupBy("k1").agg(F.collect_set("one").alias("ones"))
    spots = materialize(spots.join(ones, "k1", "left"), "spots")
    suspects = packed_texts(docs).join(spots, "k1")
    suspects = suspects.filter("ones IS NULL OR size(ones) = 0 OR doc_id IS NULL OR array_contains(ones, doc_id)")
    found = materialize(pieces(suspects.select("k1", "k2", "packed", "spots"), window), "pieces")
    spans = (
        indexed_spans(found.filter("anchor IS NOT NULL"), window)
        .unionByName(hot_spans(found.filter("anchor IS NULL"), window))
        .unionByName(copies.selectExpr("k1", "k2", f"array(struct(0 as first, {2**31 - 1} as last)) as spans"))
    )
    return spans.groupBy("k1", "k2").agg(F.flatten(F.collect_set("spans")).alias("spans"))


def drop_repeated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, text) of every row: the words that are left, joined by blanks."""
    rows = docs.select(F.col("doc_id").cast("long"), utf8().alias("__text"))
    spans = materialize(repeated_spans(rows, window), "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches, "packed", PACKED_PART):
            values = []
            for text, own in zip(unpack(batch), batch.column("spans").to_pylist()):
                words = text.split()
                n = len(words)
                if own and n >= window:
                    edges = np.zeros(n + 1, np.int64)
                    np.add.at(edges, [s["first"] for s in own], 1)
                    np.add.at(edges, [min(s["last"], n) for s in own], -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(edges)[:n] == 0).tolist()]
                values.append((n, n - len(words), b" ".join(words).decode()))
            kinds = [pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array([v[i] for v in values], k) for i, k in enumerate(kinds)]],
                ["doc_id", "n_words", "n_removed", "text"],
            )

    joined = packed_texts(rows).join(spans, ["k1", "k2"], "left").select("doc_id", "packed", "spans")
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, text string")


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


# Windows are compared as text; a document's words stand apart by one blank.
OP11_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
  SELECT doc_id, i, md5(array_to_string(words[i : i + 34], ' ')) AS content
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i FROM words WHERE len(words) >= 35)
), often AS (
  SELECT content FROM windows GROUP BY content HAVING count(*) > 1
), gone AS (
  SELECT doc_id, list_distinct(flatten(list(range(i, i + 35)))) AS places
  FROM windows WHERE content IN (SELECT content FROM often) GROUP BY doc_id
), marked AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM words
), flat AS (SELECT doc_id, unnest(places) AS i FROM gone),
kept AS (
  SELECT m.doc_id, count(*) AS n, string_agg(m.word, ' ' ORDER BY m.i) AS text
  FROM marked m ANTI JOIN flat f ON m.doc_id = f.doc_id AND m.i = f.i GROUP BY m.doc_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
       CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""

QUERIES = [Query("op11_substring_dedup", op11_substring_dedup, OP11_SQL)]
