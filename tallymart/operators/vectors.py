"""Exact vector search: query blocks against vector partitions, one matrix product each, partial top-k before the shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .retrieval import top_k

#: Queries in a block; a block of 64-d vectors is about 1 MB.
BLOCK = 2048


def l2_normalize(vector):
    """Unit-norm array of doubles; a zero or null vector stays as it is."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double")))


def of_lengths(column) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) of an Arrow list column for each length that its lists have; nulls and empty lists are left out."""
    n = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, start = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False), np.cumsum(n) - n
    for dims in np.unique(n[n > 0]).tolist():
        rows = np.flatnonzero(n == dims)
        yield rows, flat[start[rows][:, None] + np.arange(dims)]


def packed(rows: DataFrame, id: str) -> DataFrame:
    """(dims, ids, x): vectors of one length in blocks of up to 2048. Nulls go here and not by a filter, below which Spark would compute the vectors again."""

    def run(batches):
        for batch in batches:
            for at, x in of_lengths(batch.column("vector")):
                ids = batch.column("id").to_numpy(zero_copy_only=False)[at]
                for first in range(0, len(at), BLOCK):
                    own = slice(first, first + BLOCK)
                    yield pa.RecordBatch.from_arrays([pa.array([x.shape[1]], pa.int32()), pa.array([ids[own].astype(np.int64).tobytes()]), pa.array([x[own].tobytes()])], names=["dims", "ids", "x"])

    return rows.select(F.col(id).cast("long").alias("id"), "vector").mapInArrow(run, "dims int, ids binary, x binary")


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int, other: bool = False, slices: int | None = None) -> DataFrame:
    """Cosine top-k: queries (query_id, vector) against vectors (product_id, vector), each of unit norm. Vectors of other lengths than the query's are not compared.

    Both are packed into blocks. The blocks of vectors are dealt to slices (by default four for each core of the
    cluster), and every block of queries goes to each slice (or, if Spark finds them small, to every task); a pair of blocks returns its
    best k per query. So a row is shuffled per query, block and k, never per pair. `other` leaves out the vector whose id is the query's.
    """
    slices = slices or 4 * queries.sparkSession.sparkContext.defaultParallelism
    left = packed(queries, "query_id").select("dims", F.col("ids").alias("q"), F.col("x").alias("qx"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"))
    pairs = left.join(packed(vectors, "product_id").select("dims", F.col("ids").alias("v"), F.col("x").alias("vx"), F.pmod(F.xxhash64("ids"), F.lit(slices)).cast("int").alias("slice")), ["slice", "dims"])

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                q, v = (np.frombuffer(row[c], np.int64) for c in "qv")
                yield from nearest_rows(q, np.frombuffer(row["qx"]).reshape(len(q), -1), v, np.frombuffer(row["vx"]).reshape(len(v), -1), k, other)

    return top_k(pairs.mapInArrow(run, FOUND), k)


FOUND = "query_id long, product_id long, score double"


def nearest_rows(q: np.ndarray, qx: np.ndarray, v: np.ndarray, vx: np.ndarray, k: int, other: bool = False) -> Iterator[pa.RecordBatch]:
    """The best k of one block of vectors for each query of a block. Scores are rounded, so that equal vectors tie, and ids decide."""
    scores = qx @ vx.T
    if other:
        scores[q[:, None] == v[None, :]] = -np.inf
    n, scores = min(len(v), k), np.round(scores, 6)
    order = np.lexsort((np.broadcast_to(v, scores.shape), -scores), axis=1)[:, :n]
    own = np.take_along_axis(scores, order, 1).ravel()
    keep = np.isfinite(own)
    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q, n)[keep]), pa.array(v[order.ravel()][keep]), pa.array(own[keep])], names=["query_id", "product_id", "score"])


def dense_topk(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """Best chunk per product among the first 3k chunks of a query, then the first k products. chunks: chunk_id, product_id, vector."""
    hits = vector_topk(queries, chunks.select(F.col("chunk_id").alias("product_id"), "vector"), 3 * k).withColumnRenamed("product_id", "chunk_id")
    named = hits.drop("rank").join(chunks.select("chunk_id", "product_id"), "chunk_id")
    return top_k(named.groupBy("query_id", "product_id").agg(F.max("score").alias("score")), k)
