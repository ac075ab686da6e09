"""Operator 3: token ids as Arrow files of fixed-size sequences.

Documents are sorted by id over all tasks. Each task encodes its range, joins the documents'
ids, each with an end id, and cuts them into sequences of ``length``. A file of the Arrow
IPC file format holds them in batches of two fixed-size-list columns: ``tokens``, of the smallest
unsigned type that holds the vocabulary, and ``mask``, false only where the file's last
sequence is filled up. All rows have the same width, so sequence ``i`` is at a known place in
its batch, and a reader that maps the file into memory copies nothing. A second file of the
same format lists the file's documents: id, first token, number of tokens.

A task names its files by itself; the manifest, a table that Spark writes, lists those of the
tasks that counted. So a task that is run again leaves unused files at most. Files go to
the given folder through ``pyarrow.fs``, which knows the folder's scheme.

Texts are cut where the byte-level pattern always cuts: before a blank or line end that a letter
or sign follows, and between a letter and a mark. Cutting and looking up are array operations over
many texts: a piece of up to 15 bytes is two numbers. Each different piece of these texts is looked
up once, and encoded if its Python worker hasn't met it before. A text that names a special token, or
holds a zero byte, is encoded as a whole.

Null ids come first, equal ids in order of a hash of the text; null texts are empty and have
just the end id. Empty tables give a manifest without rows. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import gc
import json
import re
import sys
import types
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tractlake.llm.base import Query, folder_of, fresh_dir, in_parts, materialize, table, utf8, width
from tractlake.llm.bpe import definition_of, load

BYTE_BPE = "byte_bpe_50k.json"
END_ID = 2
LENGTH = 2_048
BATCH = 64
#: Pieces that a task remembers before it starts anew; pieces that are encoded in one call.
KNOWN, CALL = 600_000, 2_000
#: Bytes of texts that a task looks at together.
PART = 4_000_000
# A blank and letters, up to those of Latin-1, are one token of the pattern.
PLAIN = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
LETTERS = [chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7)]


def byte_set(*parts: bytes) -> np.ndarray:
    found = np.zeros(256, bool)
    found[np.frombuffer(b"".join(parts), np.uint8)] = True
    return found


SIGNS = bytes(range(0x21, 0x7F))
ASCII_LETTERS = bytes(c for c in SIGNS if chr(c).isalpha())
# Before one blank or line end that an ASCII sign follows, or the first byte of a letter
# that is no white space in any script (those begin with C2, E1, E2 or E3).
BLANKS, BEGINS = byte_set(b" \n"), byte_set(SIGNS, bytes(range(0xC3, 0xE1)), bytes(range(0xE4, 0xF5)))
# Before a mark that a letter of ASCII or Latin-1 stands before; the latter is C3 and one of these.
MARKS, LETTER = byte_set(b".,;:!?"), byte_set(ASCII_LETTERS)
LATIN = byte_set(bytes(c for c in range(0x80, 0xC0) if c not in (0x97, 0xB7)))


def cut_places(data: np.ndarray) -> np.ndarray:
    """Whether the pattern always cuts before a byte of texts that are joined by zero bytes."""
    before = np.zeros(len(data), bool)
    before[:-1] = BLANKS[data[:-1]] & BEGINS[data[1:]]
    marks = np.flatnonzero(MARKS[data])
    one, two = data[np.maximum(marks - 1, 0)], data[np.maximum(marks - 2, 0)]
    after_letter = (marks > 0) & (LETTER[one] | ((marks > 1) & (two == 0xC3) & LATIN[one]))
    before[marks[after_letter]] = True
    return before


def short_keys(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers that hold all of a piece of up to 15 bytes, and its size."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    keys = []
    for half in (0, 8):
        key = np.zeros(len(start), np.uint64)
        for i in range(8 if half == 0 else 7):
            byte = np.where(size > half + i, padded[start + (half + i)], np.uint8(0))
            key |= byte.astype(np.uint64) << np.uint64(8 * i)
        keys.append(key)
    return keys[0], keys[1] | (size.astype(np.uint64) << np.uint64(56))


class Encoder:
    """Whole texts to ids, with a memory of the pieces met so far."""

    def __init__(self, definition: str, known: int = KNOWN):
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = load(definition)
        # How the byte-level alphabet writes a blank and letters outside ASCII.
        written = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.alphabet = str.maketrans({c: written(c)[0][0] for c in [" ", *LETTERS]})
        added = [t["content"].encode() for t in json.loads(definition)["added_tokens"]]
        self.blank = self.alphabet[ord(" ")]
        self.special = re.compile(b"|".join(map(re.escape, added)) if added else rb"(?!)")
        self.most = known
        self._forget()

    def _forget(self) -> None:
        """A piece has a number; its ids are those from ``ends`` of the number to the next one."""
        self.known: dict[bytes, int] = {}
        self.flat, self.ends = array("I"), array("q", [0])

    def batch(self, texts: list[bytes]) -> list[np.ndarray]:
        """Each text's ids as unsigned 32-bit integers."""
        gc.disable()  # many pieces, none in a cycle, would be searched again and again
        try:
            if len(self.known) > self.most:
                self._forget()
            # Zero bytes join texts; a text that holds one, or names a special token, is a piece.
            whole = [b"\0" in t or self.special.search(t) is not None for t in texts]
            cut = iter(self._cut([t for t, w in zip(texts, whole) if not w]))
            return [self._gather(self._numbers([t]))[0] if w else next(cut) for t, w in zip(texts, whole)]
        finally:
            gc.enable()

    def _cut(self, texts: list[bytes]) -> list[np.ndarray]:
        buffer = b"\0".join(texts)
        data = np.frombuffer(buffer, np.uint8)
        lengths = np.array([len(t) for t in texts], np.int64)
        first = np.cumsum(lengths + 1) - lengths - 1
        begins = cut_places(data)
        begins[first[lengths > 0]] = True
        start = np.flatnonzero(begins)
        text = np.searchsorted(first, start, side="right") - 1
        size = np.minimum(np.append(start[1:], len(data)), (first + lengths)[text]) - start
        which, place = self._distinct(buffer, data, start, size)
        begin = start[which]
        slices = zip(begin.tolist(), (begin + size[which]).tolist())
        ids, before = self._gather(self._numbers([buffer[a:b] for a, b in slices])[place])
        pieces = np.searchsorted(text, np.arange(1, len(texts)))
        return np.split(ids, before[pieces]) if texts else []

    def _gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces, one after the other, and where each piece's begin, and all end."""
        ends = np.frombuffer(self.ends, np.int64)
        begin, count = ends[numbers], ends[numbers + 1] - ends[numbers]
        before = np.zeros(len(numbers) + 1, np.int64)
        np.cumsum(count, out=before[1:])
        at = np.repeat(begin - before[:-1], count) + np.arange(before[-1])
        return np.frombuffer(self.flat, "<u4")[at] if len(at) else np.empty(0, "<u4"), before

    def _distinct(self, buffer: bytes, data, start, size) -> tuple[np.ndarray, np.ndarray]:
        """Places of the different pieces among all, and for each piece which of them it is."""
        short = np.flatnonzero(size <= 15)
        one, two = short_keys(data, start[short], size[short])
        _, index, inverse = np.unique(self._mixed(one, two), return_index=True, return_inverse=True)
        place = np.empty(len(start), np.int64)
        if np.array_equal(one[index][inverse], one) and np.array_equal(two[index][inverse], two):
            which, place[short] = short[index], inverse
            rest = np.flatnonzero(size > 15)
        else:  # two pieces have one key
            which, rest = short[:0], np.arange(len(start))
        numbers: dict[bytes, int] = {}
        other = []
        for i in rest.tolist():
            piece = buffer[start[i] : start[i] + size[i]]
            number = numbers.setdefault(piece, len(numbers))
            if number == len(other):
                other.append(i)
            place[i] = len(which) + number
        return np.append(which, np.array(other, np.int64)), place

    @staticmethod
    def _mixed(one: np.ndarray, two: np.ndarray) -> np.ndarray:
        mixed = one * np.uint64(0x9E3779B97F4A7C15) ^ two * np.uint64(0xC2B2AE3D27D4EB4F)
        return mixed ^ (mixed >> np.uint64(29))

    def _learn(self, piece: bytes, ids: list[int]) -> None:
        self.known[piece] = len(self.known)
        self.flat.extend(ids)
        self.ends.append(len(self.flat))

    def _numbers(self, pieces: list[bytes]) -> np.ndarray:
        """The numbers of different pieces; those that aren't known are encoded."""
        other = []
        for piece in pieces:
            if piece in self.known:
                continue
            if PLAIN.fullmatch(piece):
                word = piece.decode()
                if word.isascii():
                    word = word.replace(" ", self.blank)
                else:
                    word = word.translate(self.alphabet)
                self._learn(piece, [t.id for t in self.tokenizer.model.tokenize(word)])
            else:
                other.append(piece)
        for i in range(0, len(other), CALL):
            now = other[i : i + CALL]
            found = self.tokenizer.encode_batch_fast(
                [p.decode("utf-8", "replace") for p in now], add_special_tokens=False
            )
            for piece, encoded in zip(now, found):
                self._learn(piece, encoded.ids)
        return np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))


def kept_encoder(definition: str) -> Encoder:
    """The encoder of this Python worker: what a task has met serves the worker's next tasks as well."""
    name = "tractlake_kept_encoder"  # functions are shipped anew for each task; loaded modules stay
    kept = sys.modules.setdefault(name, types.ModuleType(name))
    if getattr(kept, "definition", None) != definition:
        kept.definition, kept.encoder = definition, Encoder(definition)
    return kept.encoder


class SequenceWriter:
    """Appends ids and writes them as batches of sequences."""

    def __init__(self, stream, kind: pa.DataType, length: int, rows: int = BATCH):
        self.kind, self.length, self.rows = kind, length, rows
        self.schema = pa.schema(
            [("tokens", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))]
        )
        self.writer = pa.ipc.new_file(stream, self.schema)
        self.waiting: list[np.ndarray] = []
        self.count = self.total = 0

    def append(self, ids: np.ndarray) -> None:
        self.waiting.append(ids)
        self.count += len(ids)
        self.total += len(ids)
        if self.count >= self.length * self.rows:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate([*self.waiting, np.empty(0, "<u4")])
        size = self.length * self.rows
        while len(ids) >= size or (last and len(ids)):
            now, ids = ids[:size], ids[size:]
            missing = -len(now) % self.length
            tokens = np.concatenate([now, np.zeros(missing, now.dtype)]).astype(self.kind.to_pandas_dtype())
            mask = np.arange(len(tokens)) < len(now)
            arrays = [
                pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (tokens, mask)
            ]
            self.writer.write_batch(pa.RecordBatch.from_arrays(arrays, schema=self.schema))
        self.waiting, self.count = [ids], len(ids)

    def close(self) -> None:
        self._flush(True)
        self.writer.close()


class SequenceFile:
    """Random access to a file of sequences."""

    def __init__(self, source):
        self.file = pa.ipc.open_file(source)
        self.length = self.file.schema.field("tokens").type.list_size
        first = self.file.get_batch(0).num_rows if self.file.num_record_batches else 1
        self.step = first * self.length  # all batches but the last hold as many

    def batch(self, i: int, column: str = "tokens") -> pa.Array:
        """A column of a batch as one flat array, without a copy."""
        return self.file.get_batch(i).column(column).flatten()

    def sequence(self, i: int) -> tuple[pa.Array, pa.Array]:
        """The tokens and the mask of one sequence, without a copy."""
        batch = self.file.get_batch(i * self.length // self.step)
        row = i - i * self.length // self.step * (self.step // self.length)
        at = slice(row * self.length, (row + 1) * self.length)
        return tuple(batch.column(c).flatten()[at] for c in ("tokens", "mask"))

    def tokens(self, start: int, count: int) -> np.ndarray:
        """Tokens ``start`` to ``start + count`` of the file."""
        out = []
        while count > 0:
            i, at = divmod(start, self.step)
            part = self.batch(i).to_numpy(zero_copy_only=True)[at : at + count]
            out.append(part)
            start, count = start + len(part), count - len(part)
        return out[0] if len(out) == 1 else np.concatenate([*out, np.empty(0, "<u2")])


def write_tokens(
    docs: DataFrame, path: str, definition: str, end_id: int = END_ID, length: int = LENGTH
) -> DataFrame:
    """Write files below ``path``; the manifest: (part, tokens_file, docs_file, docs, tokens, sequences).

    ``part`` numbers the ranges of ids in ascending order.
    """
    kind = "uint16" if load(definition).get_vocab_size() <= 2**16 else "uint32"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        stem = f"part-{part:06d}-{uuid.uuid4().hex}"
        store = None
        for batch in in_parts(batches, "__text", PART):
            if store is None:
                store, folder = folder_of(path)
                store.create_dir(folder, recursive=True)
                encoder = kept_encoder(definition)
                names = [f"{folder}/{stem}.{x}.arrow" for x in ("tokens", "docs")]
                streams = [store.open_output_stream(name) for name in names]
                writer = SequenceWriter(streams[0], getattr(pa, kind)(), length)
                index_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("tokens", pa.int64())])
                index, count = pa.ipc.new_file(streams[1], index_schema), 0
            starts, sizes = [], []
            texts = [t.as_py() for t in batch.column("__text")]
            for ids in encoder.batch(texts):
                ids = np.append(ids, np.uint32(end_id))
                starts.append(writer.total)
                sizes.append(len(ids))
                writer.append(ids)
            index.write_batch(
                pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())],
                    schema=index_schema,
                )
            )
            count += batch.num_rows
        if store is not None:
            writer.close()
            index.close()
            for stream in streams:
                stream.close()
            row = [part, *names, count, writer.total, -(-writer.total // length)]
            kinds = [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], k) for v, k in zip(row, kinds)],
                ["part", "tokens_file", "docs_file", "docs", "tokens", "sequences"],
            )

    order = ["doc_id", "__hash"]
    sorted_docs = (
        docs.select(F.col("doc_id").cast("long"), utf8().alias("__text"))
        .withColumn("__hash", F.xxhash64("__text"))
        .repartitionByRange(width(docs.sparkSession), *order)
        .sortWithinPartitions(*order)
        .select("doc_id", "__text")
    )
    schema = "part int, tokens_file string, docs_file string, docs long, tokens long, sequences long"
    return materialize(sorted_docs.mapInArrow(run, schema), "manifest")


def read_tokens(
    manifest: DataFrame,
    path: str,
    columns: dict[str, tuple[str, pa.DataType, Callable[[np.ndarray], object]]] | None = None,
) -> DataFrame:
    """(doc_id, start, n_tokens, columns) of every document in the files of ``manifest``.

    ``start`` counts the tokens of all documents before it. ``columns``: SQL type, Arrow type, and
    the function of a document's ids; default: the ids.
    """
    if columns is None:
        columns = {"ids": ("array<int>", pa.list_(pa.int32()), lambda ids: ids.astype(np.int32))}
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per file, so the sums before each are a small sort.
    files = manifest.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    files = files.repartition(width(manifest.sparkSession), "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for row in batch.to_pylist():
                store = folder_of(path)[0]
                is_local = isinstance(store, fs.LocalFileSystem)
                opened = [
                    pa.memory_map(row[c]) if is_local else store.open_input_file(row[c])
                    for c in ("tokens_file", "docs_file")
                ]
                file, index = SequenceFile(opened[0]), pa.ipc.open_file(opened[1])
                for i in range(index.num_record_batches):
                    docs = index.get_batch(i)
                    starts, sizes = docs.column("start").to_numpy(), docs.column("tokens").to_numpy()
                    each = [file.tokens(int(a), int(n)) for a, n in zip(starts, sizes)]
                    yield pa.RecordBatch.from_arrays(
                        [docs.column("doc_id"), pa.array(starts + row["base"]), docs.column("tokens")]
                        + [pa.array([f(ids) for ids in each], k) for _, k, f in columns.values()],
                        ["doc_id", "start", "n_tokens", *columns],
                    )

    schema = ", ".join(
        ["doc_id long, start long, n_tokens long", *[f"{n} {kind}" for n, (kind, *_) in columns.items()]]
    )
    return files.select("tokens_file", "docs_file", "base").mapInArrow(run, schema)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_dir(spark, "tokens")
    definition = definition_of(public_tokenizers.path(BYTE_BPE))
    manifest = write_tokens(table(spark, sf_dir, "documents"), path, definition)
    crc = ("long", pa.int64(), lambda ids: zlib.crc32(ids.astype("<u4").tobytes()))
    return read_tokens(manifest, path, {"ids_crc32": crc})


QUERIES = [Query("op3_token_files", op3_token_files)]
