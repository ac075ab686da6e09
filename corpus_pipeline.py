"""The corpus pipeline, and all queries of the corpus operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tractlake.llm import (
    bpe,
    importance,
    licences,
    lines,
    mixing,
    neardup,
    neighbours,
    passages,
    periods,
    quality,
    scoring,
    sharding,
    tokenfiles,
)
from tractlake.llm.base import Query, materialize, table

#: Documents that share this much of their shingles are near copies; op8 has its own limit.
NEAR_PERCENT = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: the documents that the rules keep."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: every document, without passages that stand earlier."""
    return lines.drop_repeated(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: one document of each group, the one with the smallest id."""
    return neardup.keep_one(docs, NEAR_PERCENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: each document as often as the mix takes it."""
    return mixing.mix(docs)


def encode_and_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: (doc_id, n_tokens, ids_sha256, decoded_sha256) of every row."""
    return bpe.round_trip(docs, bpe.definition_of(public_tokenizers.path(bpe.WORD_BPE)))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("mixing", mix_sources),
    ("encode and decode", encode_and_decode),
]

# Cutoffs by exact binomial tails, rounding by hashed draws and merges have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs


_MODULES = (
    sharding, licences, tokenfiles, lines, bpe, mixing, scoring, neardup, quality, neighbours,
    passages, periods, importance,
)
QUERIES = {q.name: q for module in _MODULES for q in module.QUERIES}
QUERIES["pipeline"] = Query("pipeline", run, ORACLE_SQL)
