"""Operator 10: nearest neighbours by a permutation index.

Pivots are random directions, drawn from a seed for each dimension; they need no fit to the
data. A vector is known by its ``POSTED`` nearest pivots in order. Vectors are dealt
to blocks, and each block has one inverted file per pivot: the rank that the pivot has for
each vector, ``POSTED`` where it isn't among its nearest. A query reads the files of its own nearest
pivots only. The footrule distance of two orders, the sum of rank differences with absent
pivots at rank ``POSTED``, is twice the sum of ``max(rank of query, rank of vector)`` over the
query's pivots, less a constant.

The measure is the inner product, but orders of pivots know angles only. So a block's vectors are
parted into classes by length, each within a factor of two, and a vector of a class gets one more
component, ``sqrt(M^2 - |x|^2)`` with ``M`` the class's greatest length, queries 0: then all of a
class have length ``M``, and the smaller angle is the larger inner product. Each class is ranked by the footrule
distance by itself; its nearest ``SHARE``, ``LEAST`` at least, with all that tie with the last of
them, are compared exactly in double precision. Classes of up to ``LEAST`` vectors are
compared whole.

A block is as large as ``BLOCK_ROWS`` lets it be, also for small tables, so that the share is the
same from ``LEAST / SHARE`` = 2,133 vectors on. Queries meet blocks in cells of bounded
size, one block and some queries each, and every cell returns its best ``k`` per query.

Null, empty or all-zero vectors, vectors with a null, NaN or infinite component, and rows
without an id take no part. Equal rows count once; rows that share the query's id are
its own. An id with several vectors has its best score. Vectors of different dimensions never meet. Ties go to the smaller id. Empty
tables give empty tables. Only ``vec_id`` and ``embedding`` are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tractlake.llm.base import Query, materialize, table

PIVOTS, POSTED, SEED = 256, 128, 17
#: Of a class, the share that is compared exactly, and how many at least.
SHARE, LEAST = 0.12, 256
#: Vectors of a block and queries of a cell, at most about; cells of small tables, and their queries.
BLOCK_ROWS, CELL_QUERIES, LEAST_CELLS, LEAST_QUERIES = 16_384, 1_024, 8, 16


def pivots(dimension: int) -> np.ndarray:
    found = np.random.default_rng([SEED, dimension]).standard_normal((PIVOTS, dimension))
    return found / np.linalg.norm(found, axis=1, keepdims=True)


def ranks(vectors: np.ndarray) -> np.ndarray:
    """(vectors, PIVOTS): the rank of each pivot among the vector's nearest, else POSTED.

    The scale of a vector doesn't change its order. Sums run along the same axis for every row,
    so equal vectors have equal ranks.
    """
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    near = np.einsum("nd,pd->np", scaled, pivots(vectors.shape[1]), optimize=False)
    order = np.argsort(-near, axis=1, kind="stable")[:, :POSTED]
    out = np.full(near.shape, POSTED, np.uint8)
    np.put_along_axis(out, order, np.arange(POSTED, dtype=np.uint8)[None, :], axis=1)
    return out


def by_length(vectors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, the vectors with one more component) of each class of lengths, the longest first."""
    most = np.abs(vectors).max(axis=1)
    length = np.log2(most) + np.log2(np.linalg.norm(vectors / most[:, None], axis=1))
    kind = np.floor(length.max(initial=-np.inf) - length).astype(np.int64)
    out = []
    for one in np.unique(kind):
        rows = np.flatnonzero(kind == one)
        x = vectors[rows] / most[rows].max()
        square = (x * x).sum(axis=1)
        out.append((rows, np.column_stack([x, np.sqrt(square.max() - square)])))
    return out


def nearest_in_block(
    ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int
) -> tuple[list[int], list[int], list[float]]:
    """The best ``k`` of the block for each query, by footrule distance and then exactly."""
    classes = []
    for rows, levelled in by_length(vectors):
        wanted = max(LEAST, 4 * k, int(np.ceil(SHARE * len(rows)))) + 1
        files = np.ascontiguousarray(ranks(levelled).T) if len(rows) > wanted else None
        classes.append((rows, wanted, files))
    out = [], [], []
    orders = ranks(np.pad(queries, ((0, 0), (0, 1))))
    for query_id, query, order in zip(query_ids, queries, orders):
        own = np.flatnonzero(order < POSTED)
        parts = []
        for rows, wanted, files in classes:
            if files is not None:
                distance = np.maximum(files[own], order[own][:, None]).sum(axis=0, dtype=np.int32)
                limit = np.partition(distance, wanted - 1)[wanted - 1]
                rows = rows[distance <= limit]
            parts.append(rows)
        near = np.sort(np.concatenate(parts))
        near = near[ids[near] != query_id]
        score = (vectors[near] * query).sum(axis=1)
        best = np.lexsort((ids[near], -score))[:k]
        out[0].extend([int(query_id)] * len(best))
        out[1].extend(ids[near][best].tolist())
        out[2].extend(score[best].tolist())
    return out


def usable(vectors: DataFrame) -> DataFrame:
    """The distinct rows (vec_id, embedding, dim) that take part, stored."""
    x = F.col("embedding")
    fit = (
        F.col("vec_id").isNotNull()
        & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
        & F.exists(x, lambda v: v != 0)
    )
    rows = vectors.select(
        F.col("vec_id").cast("long"), x.cast("array<double>").alias("embedding")
    ).filter(fit)
    return materialize(rows.distinct().withColumn("dim", F.size("embedding")), "vectors")


def cells(vectors: int, queries: int) -> tuple[int, int]:
    """The numbers of blocks and of groups of queries. Small tables are dealt by queries only."""
    blocks = max(1, -(-vectors // BLOCK_ROWS))
    few = min(-(-LEAST_CELLS // blocks), -(-queries // LEAST_QUERIES))
    return blocks, max(1, few, -(-queries // CELL_QUERIES))


def search(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) for stored ``usable`` rows."""
    blocks, groups = cells(vectors.count(), queries.count())

    def dealt(name: str, n: int):
        return F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(n)).cast("int").alias(name)

    def all_of(name: str, n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)

    columns = ["vec_id", "embedding", "dim"]
    left = vectors.select(*columns, dealt("block", blocks), all_of("part", groups))
    right = queries.select(*columns, dealt("part", groups), all_of("block", blocks))

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        found = [], [], []
        if rows.num_rows and asked.num_rows:
            dim = rows.column("dim")[0].as_py()
            (ids, x), (query_ids, q) = (
                (t.column("vec_id").to_numpy(), _matrix(t.column("embedding"), dim)) for t in (rows, asked)
            )
            order = np.argsort(ids, kind="stable")
            found = nearest_in_block(ids[order], x[order], query_ids, q, k)
        kinds = [("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]
        return pa.table({n: pa.array(v, t) for v, (n, t) in zip(found, kinds)})

    keys = ["dim", "block", "part"]
    best = (
        left.groupBy(*keys)
        .cogroup(right.groupBy(*keys))
        .applyInArrow(run, "query_id long, vec_id long, score double")
    )
    top = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        best.groupBy("query_id", "vec_id")
        .agg(F.max("score").alias("score"))
        .withColumn("rank", F.row_number().over(top))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(-1, dim)


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = usable(table(spark, sf_dir, "embeddings"))
    return search(vectors, vectors.filter("vec_id % 20 = 0"), 20)


QUERIES = [Query("op10_neighbours", op10_neighbours)]
