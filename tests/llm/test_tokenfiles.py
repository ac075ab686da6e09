import collections
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from cases import documents, frame, save, with_clashes
from hypothesis import given, settings
from hypothesis import strategies as st
from test_bpe import ODD
from tokenizers import Tokenizer
from tractlake.llm.bpe import definition_of
from tractlake.llm.tokenfiles import BYTE_BPE, Encoder, SequenceFile, SequenceWriter, op3_token_files, read_tokens, write_tokens

PATH = public_tokenizers.path(BYTE_BPE)
TOKENIZER = Tokenizer.from_file(PATH)
ENCODER = Encoder(definition_of(PATH), known=50)


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t  'aé　\x85×ÿß.,!…")), max_size=40))
def test_pieces_encode_as_the_whole(text):
    assert ENCODER.batch([text.encode()])[0].tolist() == ids_of(text)


def test_odd_texts():
    for text in ODD + ["  a   b\n\n c \n", "x  <|endoftext|>  y", "a　 b  　 c", "   ", "\n\n\nx"]:
        assert ENCODER.batch([text.encode()])[0].tolist() == ids_of(text)


def test_many_texts_at_once():
    """Empty texts, zero bytes, special tokens, long pieces, and cuts that may not look into other texts."""
    texts = [r[1] or "" for r in documents()] + ODD
    texts += ["", ".", " a", "b", ".c", "", "\x00", "a\x00 b", "<|endoftext|> x", "x" * 40, "x" * 40 + ".", "é", ",", "\n", ""]
    got = ENCODER.batch([t.encode() for t in texts])
    assert [g.tolist() for g in got] == [ids_of(t) for t in texts]
    assert ENCODER.batch([]) == [] and [g.tolist() for g in ENCODER.batch([b""])] == [[]]


def test_equal_keys_lose_nothing(monkeypatch):
    """If two pieces had one key, pieces are told apart by their bytes."""
    monkeypatch.setattr(Encoder, "_mixed", staticmethod(lambda one, two: one & np.uint64(1)))
    text = "the cat and the hat, then a bat"
    assert ENCODER.batch([text.encode()])[0].tolist() == ids_of(text)


def test_sequences_are_read_in_place(tmp_path):
    ids = np.arange(1000, dtype="<u4") * 7 % 50000
    path = str(tmp_path / "x.arrow")
    with pa.OSFile(path, "wb") as stream:
        writer = SequenceWriter(stream, pa.uint16(), 16, rows=4)
        for part in np.split(ids, [1, 90, 90, 500, 501]):
            writer.append(part)
        writer.close()
    mapped = pa.memory_map(path)
    before = pa.total_allocated_bytes()
    file = SequenceFile(mapped)
    tokens, mask = file.sequence(61)
    assert pa.total_allocated_bytes() - before < 4096
    assert tokens.to_pylist() == ids[61 * 16 : 62 * 16].tolist() and all(mask.to_pylist())
    tokens, mask = file.sequence(62)
    assert tokens.to_pylist()[:8] == ids[992:].tolist() and mask.to_pylist() == [True] * 8 + [False] * 8
    for start, count in ((0, 1000), (63, 2), (64, 64), (999, 1), (10, 0)):
        assert file.tokens(start, count).tolist() == ids[start : start + count].tolist()


@pytest.fixture
def rows():
    return documents() + [(900 + i, t, "en", "a", 1) for i, t in enumerate(ODD)]


def expected(rows):
    at, out = 0, []
    for i, t, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*ids_of(t), 2]
        out.append((i, at, ids))
        at += len(ids)
    return out


def test_query(spark, tmp_path, rows):
    folder = save(with_clashes(frame(spark, rows)).repartition(3), tmp_path)
    out = op3_token_files(spark, folder)
    assert [f.simpleString() for f in out.schema] == ["doc_id:bigint", "start:bigint", "n_tokens:bigint", "ids_crc32:bigint"]
    got = sorted(map(tuple, out.collect()), key=lambda r: r[1])
    assert collections.Counter(map(tuple, got)) == collections.Counter(
        (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, at, ids in expected(rows)
    )


def test_files_hold_the_ids(spark, tmp_path, rows):
    path = f"{tmp_path}/tokens"
    manifest = write_tokens(frame(spark, rows), path, definition_of(PATH), length=32)
    got = [(r.doc_id, r.start, r.ids) for r in read_tokens(manifest, path).collect()]
    assert sorted(got, key=lambda r: r[1]) == expected(rows)
    for row in manifest.collect():
        file = SequenceFile(pa.memory_map(row.tokens_file))
        masks = [file.sequence(i)[1].to_pylist() for i in range(row.sequences)]
        assert sum(map(sum, masks)) == row.tokens
        assert all(all(m) for m in masks[:-1])


def test_empty_table(spark, tmp_path):
    assert op3_token_files(spark, save(frame(spark, []), tmp_path)).collect() == []
