import collections
import hashlib

import corpus_pipeline
import numpy as np
import public_tokenizers
from cases import frame, save, with_clashes
from test_neardup import awkward
from tokenizers import Tokenizer
from tractlake.llm.bpe import WORD_BPE


def test_stages_hand_over_documents(spark, tmp_path):
    """Each stage's rows are those of its operator; the last one's are those of plain Python."""
    rows = awkward()
    folder = save(with_clashes(frame(spark, rows)), tmp_path)
    save(spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int"), tmp_path, "labels")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if number < 4:
            assert out.columns == columns
        out.write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
        seen.append(docs.collect())
    ids = [{r.doc_id for r in stage} for stage in seen]
    assert ids[1] == ids[0] and ids[2] < ids[1] and ids[3] <= ids[2]
    assert len(seen[1]) == len(seen[0])
    tokenizer = Tokenizer.from_file(public_tokenizers.path(WORD_BPE))

    def digest(text):
        numbers = tokenizer.encode(text or "", add_special_tokens=False).ids
        decoded = tokenizer.decode(numbers, skip_special_tokens=False)
        return len(numbers), hashlib.sha256(np.array(numbers, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()

    assert collections.Counter(map(tuple, seen[4])) == collections.Counter((r.doc_id, *digest(r.text)) for r in seen[3])
    whole = corpus_pipeline.run(spark, folder)
    assert collections.Counter(map(tuple, whole.collect())) == collections.Counter(map(tuple, seen[4]))


def test_empty_tables(spark, tmp_path):
    folder = save(frame(spark, []), tmp_path)
    save(spark.createDataFrame([], "doc_id long, quality int, toxic int"), tmp_path, "labels")
    assert corpus_pipeline.run(spark, folder).collect() == []


def test_one_query_for_each_operator():
    names = sorted(corpus_pipeline.QUERIES)
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13
    assert "pipeline" in names and [n for n, _ in corpus_pipeline.STAGES][0] == "quality rules"


def test_near_copies_from_four_fifths_on_go(spark):
    """177 of 215 shingles in common, 0.82: linked in the pipeline and not in op8."""
    words = [f"word{i}" for i in range(200)]
    copy = words[:-19] + [f"other{i}" for i in range(19)]
    far = words[:-26] + [f"else{i}" for i in range(26)]
    rows = [(i, " ".join(w), "en", "a", 1) for i, w in enumerate([words, copy, far])]
    docs = frame(spark, rows)
    kept = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert sorted(r.doc_id for r in kept) == [0, 2]
    assert sorted(r.doc_id for r in corpus_pipeline.neardup.keep_one(docs).collect()) == [0, 1, 2]
