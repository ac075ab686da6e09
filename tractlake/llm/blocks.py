"""Texts as blocks: each block's distinct words once, and the place of every word of every text.

A block holds some documents of one task's input. Its distinct words are dealt to buckets by a
hash, so that a word of all blocks meets in one bucket, is handled once, and what is found
for it goes back to each block that has it, by position. Neither a word nor a block brings
more than one row per block and bucket, so frequent words aren't hot. A group of a bucket
holds one part of the distinct words; a group of a block, at most ``BLOCK_WORDS`` words and
the last document's.

The places of a block's words are the bulk of it. They are written once, to a file in the shared folder,
and read by the task that joins the block: they aren't shuffled. The stored rows of the
blocks name the files of the tasks that counted.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tractlake.llm.base import folder_of, materialize, utf8, width

BLOCK_WORDS = 2_000_000
PACKED = "block long, file string, words array<binary>, counts array<binary>"
OWN = pa.schema(
    [
        ("ids", pa.list_(pa.int64())),
        ("sizes", pa.list_(pa.int32())),
        ("places", pa.binary()),
        ("buckets", pa.binary()),
        ("words", pa.list_(pa.binary())),
    ]
)


def pack_numbers(values: np.ndarray) -> bytes:
    """Numbers below 2**32, compressed by their bytes: first, second, third and fourth."""
    planes = np.ascontiguousarray(values, dtype="<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def unpack_numbers(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").reshape(-1)


def pack_words(words: list[bytes]) -> bytes:
    """Words hold no white space, so a line each."""
    return zstandard.ZstdCompressor(level=3).compress(b"\n".join(words))


def unpack_words(data: bytes) -> list[bytes]:
    text = zstandard.ZstdDecompressor().decompress(data)
    return text.split(b"\n") if text else []


def pack(
    docs: DataFrame,
    path: str,
    spread: int | None = None,
    lower: bool = False,
    counted: Callable[[int | None], bool] | None = None,
    limit: int = BLOCK_WORDS,
) -> DataFrame:
    """Blocks of ``docs`` (doc_id, text), stored; their files go to ``path``. ``spread``: buckets.

    ``lower``: words are lower-cased in A-Z. ``counted``: for which ids words are counted.
    """
    spread = spread or min(60_000, 4 * width(docs.sparkSession))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        numbers: dict[bytes, int] = {}
        ids, texts, total = [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column("doc_id"), batch.column("__text")):
                words = text.as_py()
                words = (words.lower() if lower else words).split()
                ids.append(doc.as_py())
                texts.append(
                    np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.uint32, len(words))
                )
                total += len(words)
                if total >= limit:
                    yield flush(block, numbers, ids, texts)
                    block, numbers, ids, texts, total = block + 1, {}, [], [], 0
        if ids:
            yield flush(block, numbers, ids, texts)

    def flush(block, numbers, ids, texts) -> pa.RecordBatch:
        bucket = np.fromiter((zlib.crc32(w) % spread for w in numbers), np.uint32, len(numbers))
        order = np.argsort(bucket, kind="stable")
        ends = np.searchsorted(bucket[order], np.arange(1, spread))
        words = list(numbers)
        parts = np.split(order, ends)
        counts = None
        if counted is not None:
            used = [t for i, t in zip(ids, texts) if counted(i)]
            sums = np.bincount(np.concatenate(used) if used else [], minlength=len(words))
            counts = [pack_numbers(sums[part]) for part in parts]
        packed = [pack_words([words[i] for i in part]) for part in parts]
        own = [
            ids,
            [len(t) for t in texts],
            pack_numbers(np.concatenate(texts)),
            pack_numbers(bucket),
            packed if lower else [],
        ]
        store, folder = folder_of(path)
        store.create_dir(folder, recursive=True)
        file = f"{folder}/block-{block:012x}-{uuid.uuid4().hex}.arrow"
        with store.open_output_stream(file) as stream, pa.ipc.new_file(stream, OWN) as writer:
            arrays = [pa.array([v], f.type) for v, f in zip(own, OWN)]
            writer.write_batch(pa.RecordBatch.from_arrays(arrays, schema=OWN))
        kinds = [pa.int64(), pa.string(), pa.list_(pa.binary()), pa.list_(pa.binary())]
        return pa.RecordBatch.from_arrays(
            [pa.array([v], k) for v, k in zip([block, file, packed, counts], kinds)],
            ["block", "file", "words", "counts"],
        )

    packed = docs.select(F.col("doc_id").cast("long"), utf8().alias("__text"))
    return materialize(packed.mapInArrow(run, PACKED), "blocks")


def by_word(blocks: DataFrame, run: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """``run`` for each bucket: rows (block, bucket, words, counts), packed."""
    none = F.array_repeat(F.lit(None).cast("binary"), F.size("words"))
    zipped = F.arrays_zip("words", F.coalesce("counts", none).alias("counts"))
    each = blocks.select("block", F.posexplode(zipped).alias("bucket", "at"))
    rows = each.select("block", "bucket", "at.words", "at.counts")
    return rows.groupBy("bucket").applyInArrow(run, schema)


def by_block(
    blocks: DataFrame, found: DataFrame, run: Callable[[pa.Table], pa.Table], schema: str
) -> DataFrame:
    """``run`` for each block: the name of its file, and its rows of ``found`` (block, bucket, data)."""
    none = F.lit(None)
    rows = blocks.select(
        "block", F.lit(-1).alias("bucket"), none.cast("binary").alias("data"), "file"
    ).unionByName(found.select("block", "bucket", "data", none.cast("string").alias("file")))
    return rows.groupBy("block").applyInArrow(run, schema)


def own_of(file: str, path: str) -> dict:
    """The values of ``OWN`` in a block's file."""
    with folder_of(path)[0].open_input_file(file) as stream, pa.ipc.open_file(stream) as opened:
        return opened.get_batch(0).to_pylist()[0]


def parts_of(rows: pa.Table, path: str) -> tuple[dict, list[bytes]]:
    """A block's own values, and what was found for its buckets, in their order."""
    found = sorted(rows.select(["bucket", "data", "file"]).to_pylist(), key=lambda r: r["bucket"])
    return own_of(found[0]["file"], path), [r["data"] for r in found[1:]]


def bucket_order(own: dict) -> np.ndarray:
    """Where each word of the block stands among the words of all buckets in order."""
    order = np.argsort(unpack_numbers(own["buckets"]), kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return place
