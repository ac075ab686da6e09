"""Operator 5: BPE encoding by a table of distinct words, and decoding by a table of pieces.

White space never reaches the merges of a word tokenizer, so a text's ids are those of its
words. Tasks split texts into words; each distinct word meets in one bucket, is encoded there
once with the tokenizers library, and its ids are joined back to the texts by position
(``blocks.py``). Decoding joins ids to pieces: the table has one row per entry of the
vocabulary, so its size is bounded and every task holds it.

Null texts are empty and have no ids; an empty text decodes to an empty one. Repeated rows and ids are
encoded each. Null ids of documents stay null. Empty tables give empty tables. Only
``doc_id`` and ``text`` are read, whatever other columns are called.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tractlake.llm.base import Query, fresh_dir, table
from tractlake.llm.blocks import (
    bucket_order,
    by_block,
    by_word,
    pack,
    pack_numbers,
    parts_of,
    unpack_numbers,
    unpack_words,
)

WORD_BPE = "word_bpe_49k.json"
#: Words that are encoded in one call.
CALL = 2_000


def load(definition: str):
    """The tokenizer of a JSON text, without truncation, padding and threads of its own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for every core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(definition)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def piece_table(definition: str) -> list[bytes | None]:
    """Each id's piece; None for an id that isn't used."""
    vocabulary = load(definition).get_vocab(with_added_tokens=True)
    pieces: list[bytes | None] = [None] * (max(vocabulary.values(), default=-1) + 1)
    for piece, number in vocabulary.items():
        pieces[number] = piece.encode()
    return pieces


def encode_words(blocks: DataFrame, definition: str) -> DataFrame:
    """(block, bucket, data): how many ids each word has, then all ids."""

    def run(rows: pa.Table) -> pa.Table:
        tokenizer, known, out = load(definition), {}, []
        for data in rows.column("words"):
            words = unpack_words(data.as_py())
            new = [w for w in words if w not in known]
            for i in range(0, len(new), CALL):
                now = new[i : i + CALL]
                texts = [w.decode("utf-8", "replace") for w in now]
                for w, e in zip(now, tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
                    known[w] = np.array(e.ids, "<u4")
            ids = [known[w] for w in words]
            flat = np.concatenate([np.array([len(x) for x in ids], "<u4"), *ids])
            out.append(pack_numbers(np.concatenate([np.array([len(ids)], "<u4"), flat])))
        return pa.table({"block": rows["block"], "bucket": rows["bucket"], "data": pa.array(out, pa.binary())})

    return by_word(blocks, run, "block long, bucket int, data binary")


def _texts(rows: pa.Table, path: str) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of the documents of a block."""
    own, found = parts_of(rows, path)
    lengths, flat = [np.empty(0, "<u4")], [np.empty(0, "<u4")]
    for data in found:
        numbers = unpack_numbers(data)
        words = int(numbers[0])
        lengths.append(numbers[1 : 1 + words])
        flat.append(numbers[1 + words :])
    length, flat = np.concatenate(lengths).astype(np.int64), np.concatenate(flat)
    place = bucket_order(own)
    starts = (np.cumsum(length) - length)[place]
    length = length[place]
    places = unpack_numbers(own["places"])
    at = 0
    for doc, size in zip(own["ids"], own["sizes"]):
        words = places[at : at + size]
        at += size
        count = length[words]
        before = np.cumsum(count) - count
        gather = np.repeat(starts[words] - before, count) + np.arange(count.sum())
        yield doc, flat[gather]


def encode_with(
    docs: DataFrame,
    definition: str,
    row: Callable[[np.ndarray], tuple],
    columns: dict[str, tuple[str, pa.DataType]],
) -> DataFrame:
    """(doc_id, columns): what ``row`` makes of each text's ids."""
    path = fresh_dir(docs.sparkSession, "texts")
    blocks = pack(docs.select("doc_id", "text"), path)

    def run(rows: pa.Table) -> pa.Table:
        ids, values = [], []
        for doc, numbers in _texts(rows, path):
            ids.append(doc)
            values.append(row(numbers))
        arrays = {"doc_id": pa.array(ids, pa.int64())}
        for i, (name, (_, kind)) in enumerate(columns.items()):
            arrays[name] = pa.array([v[i] for v in values], kind)
        return pa.table(arrays)

    schema = ", ".join(["doc_id long", *[f"{n} {kind}" for n, (kind, _) in columns.items()]])
    return by_block(blocks, encode_words(blocks, definition), run, schema)


def encode(docs: DataFrame, definition: str) -> DataFrame:
    """(doc_id, ids) of every row of ``docs``."""
    return encode_with(
        docs, definition, lambda ids: (ids.astype(np.int32),), {"ids": ("array<int>", pa.list_(pa.int32()))}
    )


def decoded_bytes(ids: np.ndarray, pieces: list[bytes | None], separator: bytes = b" ") -> bytes:
    """The pieces of ``ids``; a file without a decoder has them separated by blanks."""
    found = [pieces[i] for i in ids.tolist() if i < len(pieces)]
    return separator.join([p for p in found if p is not None])


def decode(encoded: DataFrame, definition: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids), special tokens included; null ids give null."""
    pieces = piece_table(definition)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                decoded_bytes(np.array(ids, np.int64), pieces).decode() if ids is not None else None
                for ids in batch.column("ids").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"]
            )

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, definition: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): texts encoded, and decoded from their ids."""
    pieces = piece_table(definition)

    def row(ids: np.ndarray) -> tuple:
        numbers = np.ascontiguousarray(ids, "<u4")
        return (
            len(ids),
            hashlib.sha256(numbers.tobytes()).hexdigest(),
            hashlib.sha256(decoded_bytes(ids, pieces)).hexdigest(),
        )

    columns = {
        "n_tokens": ("long", pa.int64()),
        "ids_sha256": ("string", pa.string()),
        "decoded_sha256": ("string", pa.string()),
    }
    return encode_with(docs, definition, row, columns)


def definition_of(path: str) -> str:
    """A tokenizer file, read on the driver and sent along with the tasks."""
    return Path(path).read_text(encoding="utf-8")


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    definition = definition_of(public_tokenizers.path(WORD_BPE))
    return round_trip(table(spark, sf_dir, "documents"), definition)


QUERIES = [Query("op5_bpe_round_trip", op5_bpe_round_trip)]
