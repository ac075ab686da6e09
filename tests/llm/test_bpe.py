import collections
import hashlib

import numpy as np
import public_tokenizers
import pytest
from cases import documents, frame, save, with_clashes
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer
from tractlake.llm import blocks
from tractlake.llm.blocks import pack_numbers, pack_words, unpack_numbers, unpack_words
from tractlake.llm.bpe import WORD_BPE, decode, decoded_bytes, definition_of, encode, op5_bpe_round_trip, piece_table

PATH = public_tokenizers.path(WORD_BPE)
TOKENIZER = Tokenizer.from_file(PATH)
PIECES = piece_table(definition_of(PATH))
ODD = [
    "It's <|endoftext|> don't<|startoftext|>x <|endoftext|>", "a b c　d \x1c\x1d e\x85f", "ΑΣ ΣΑΣ İstanbul ǅ",
    "é ́a Å Å", "\U0001f600‍ x\n\n\r\f\vy", "1234 5,6 ''' 'S 'll",
]


def wanted(text):
    ids = TOKENIZER.encode(text or "", add_special_tokens=False).ids
    return ids, TOKENIZER.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t 'aÁ<|>")), max_size=40))
def test_words_can_be_encoded_one_by_one(text):
    ids = [i for w in text.encode().split() for i in TOKENIZER.encode(w.decode(), add_special_tokens=False).ids]
    assert (ids, decoded_bytes(np.array(ids, np.int64), PIECES).decode()) == wanted(text)


def test_packing():
    rng = np.random.default_rng(1)
    for values in ([], [0], [2**32 - 1, 5], rng.integers(0, 2**20, 999)):
        assert unpack_numbers(pack_numbers(np.array(values, np.uint32))).tolist() == list(values)
    for words in ([], [b"a"], [b"a", "é".encode()]):
        assert unpack_words(pack_words(words)) == words


@pytest.mark.parametrize("limit", [blocks.BLOCK_WORDS, 50])
def test_query(spark, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(blocks.pack, "__defaults__", (None, False, None, limit))
    rows = documents() + [(900 + i, t, "en", "a", 1) for i, t in enumerate(ODD)]
    folder = save(with_clashes(frame(spark, rows)).repartition(3), tmp_path)
    out = op5_bpe_round_trip(spark, folder)
    assert [f.simpleString() for f in out.schema] == ["doc_id:bigint", "n_tokens:bigint", "ids_sha256:string", "decoded_sha256:string"]

    def digests(text):
        ids, decoded = wanted(text)
        return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()

    assert collections.Counter(map(tuple, out.collect())) == collections.Counter((i, *digests(t)) for i, t, *_ in rows)


def test_encode_and_decode(spark):
    rows = documents()
    definition = definition_of(PATH)
    encoded = encode(frame(spark, rows), definition).cache()
    assert collections.Counter((r.doc_id, tuple(r.ids)) for r in encoded.collect()) == collections.Counter((i, tuple(wanted(t)[0])) for i, t, *_ in rows)
    decoded = decode(encoded, definition)
    assert collections.Counter(map(tuple, decoded.collect())) == collections.Counter((i, wanted(t)[1]) for i, t, *_ in rows)
    encoded.unpersist()


def test_empty_table(spark, tmp_path):
    assert op5_bpe_round_trip(spark, save(frame(spark, []), tmp_path)).collect() == []
