"""An approximate vector index: cells around k-means centres, packed in blocks; a search probes the nearest blocks, as many as audited queries ask for."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .retrieval import top_k
from .vectors import BLOCK, FOUND, nearest_rows, of_lengths, vector_topk

#: Vectors that train the centres at most (chosen by hash, over all rows), centres at most, rounds of k-means.
TRAINED, CENTRES, ROUNDS = 65_536, 4096, 6
#: Audited queries (by hash), the recall they have to reach, queries that meet a block in one task.
AUDITED, RECALL, MEET = 64, 0.92, 4096


@dataclass(frozen=True)
class Cells:
    """blocks: block, dims, centre (array), ids, x (binary); vectors: what was indexed."""

    blocks: DataFrame
    vectors: DataFrame


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x @ centres.T).argmax(1)


def train_centres(vectors: DataFrame, cells: int, rounds: int = ROUNDS, trained: int = TRAINED) -> np.ndarray:
    """Spherical k-means of vectors of one length: tasks assign a hash sample of at most about `trained` rows and add up, Spark sums by cell; only centres come to the driver (4096 at most)."""
    n = vectors.count()
    share = min(1.0, trained / max(n, 1))
    sample = vectors.where(F.pmod(F.xxhash64(F.lit(1), "product_id"), F.lit(1_000_000)) < int(share * 1_000_000)) if share < 1 else vectors
    first = sample.orderBy(F.xxhash64(F.lit(2), "product_id"), "product_id").limit(cells).select("vector").collect()
    centres = np.array([r.vector for r in first], np.float64)
    for _ in range(rounds):
        def sums(batches, centres=centres):
            total, count = np.zeros_like(centres), np.zeros(len(centres), np.int64)
            for batch in batches:
                for _, x in of_lengths(batch.column("vector")):
                    own = nearest_centre(x, centres)
                    np.add.at(total, own, x)
                    count += np.bincount(own, minlength=len(centres))
            some = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(list(total[some]), pa.list_(pa.float64()))], names=["cell", "total"])

        # The sum of arrays, place by place; a row per task and cell.
        parts = sample.select("vector").mapInArrow(sums, "cell long, total array<double>").select("cell", F.posexplode("total").alias("at", "x"))
        summed = parts.groupBy("cell", "at").agg(F.sum("x").alias("x")).groupBy("cell").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda p: p["x"]).alias("total"))
        for r in summed.collect():
            norm = np.linalg.norm(r.total)
            if norm > 0:
                centres[r.cell] = np.array(r.total) / norm
    return centres


def build_cells(vectors: DataFrame, path: str, cells: int | None = None, rounds: int = ROUNDS) -> Cells:
    """Index vectors (product_id, vector) of unit norm and one length under `path`, which must be new.

    Every row goes to the cell of its nearest centre. A cell is cut by hash into blocks of about 2048 rows, so a large
    cell (copies, say) is many blocks and no task holds one. Each block keeps the mean of its own rows as centre.
    """
    vectors = vectors.where("vector is not null and size(vector) > 0").select(F.col("product_id").cast("long").alias("product_id"), "vector")
    n = vectors.count()
    if not n:
        return Cells(vectors.sparkSession.createDataFrame([], "block long, dims int, centre array<double>, ids binary, x binary"), vectors)
    centres = train_centres(vectors, cells or int(min(CENTRES, max(1, n**0.5))), rounds)

    def assign(batches):
        for batch in batches:
            cell = np.zeros(batch.num_rows, np.int64)
            for at, x in of_lengths(batch.column("vector")):
                cell[at] = nearest_centre(x, centres)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=["product_id", "vector", "cell"])

    vectors.mapInArrow(assign, "product_id long, vector array<double>, cell long").write.parquet(f"{path}/rows")
    rows = vectors.sparkSession.read.parquet(f"{path}/rows")
    parts = rows.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    dealt = rows.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("product_id"), F.col("parts")))

    def pack(table):
        (_, x), ids = next(of_lengths(table.column("vector").combine_chunks())), table.column("product_id").to_numpy()
        mean = x.mean(0)
        norm = np.linalg.norm(mean)
        return pa.table({"dims": pa.array([x.shape[1]], pa.int32()), "centre": pa.array([(mean / norm if norm else mean).tolist()], pa.list_(pa.float64())), "ids": pa.array([ids.tobytes()], pa.binary()), "x": pa.array([x.tobytes()], pa.binary())})

    packed = dealt.groupBy("cell", "part").applyInArrow(pack, "dims int, centre array<double>, ids binary, x binary")
    packed.select(F.xxhash64("ids").alias("block"), "*").write.parquet(f"{path}/blocks")
    return Cells(vectors.sparkSession.read.parquet(f"{path}/blocks"), rows.select("product_id", "vector"))


def probe(queries: DataFrame, index: Cells, k: int, probes: int, other: bool = False) -> DataFrame:
    """The best k rows among the `probes` blocks whose centres are nearest to each query. Queries travel to blocks; a block that many want is sent to several tasks."""
    heads = index.blocks.select(F.col("block").alias("product_id"), F.col("centre").alias("vector"))
    wanted = vector_topk(queries, heads, probes).select("query_id", F.col("product_id").alias("block"))
    asked = wanted.join(queries.select(F.col("query_id").cast("long").alias("query_id"), "vector"), "query_id")
    slices = wanted.groupBy("block").agg(F.ceil(F.count("*") / MEET).alias("slices"))
    none = lambda kind: F.lit(None).cast(kind)
    sent = asked.join(slices, "block").select("block", F.pmod(F.xxhash64("query_id"), F.col("slices")).alias("slice"), F.lit(1).alias("tag"), "query_id", "vector", none("binary").alias("ids"), none("binary").alias("x"))
    held = index.blocks.join(slices, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(0).alias("tag"), none("long").alias("query_id"), none("array<double>").alias("vector"), "ids", "x")
    met = held.unionByName(sent).repartition("block", "slice").sortWithinPartitions("block", "slice", "tag")

    def run(batches):
        ids = x = None
        for batch in batches:
            tag = batch.column("tag").to_numpy()
            edges = np.r_[0, np.flatnonzero(np.diff(tag) != 0) + 1, len(tag)] if len(tag) else [0]
            for low, high in zip(edges[:-1], edges[1:]):
                own = batch.slice(low, high - low)
                if not tag[low]:
                    last = own.num_rows - 1  # blocks that follow each other at once have no queries
                    ids = np.frombuffer(own.column("ids")[last].as_py(), np.int64)
                    x = np.frombuffer(own.column("x")[last].as_py()).reshape(len(ids), -1)
                    continue
                for at, q in of_lengths(own.column("vector")):
                    yield from nearest_rows(own.column("query_id").to_numpy(zero_copy_only=False)[at].astype(np.int64), q, ids, x, k, other)

    return top_k(met.mapInArrow(run, FOUND), k)


def cells_topk(queries: DataFrame, index: Cells, k: int, recall: float = RECALL, other: bool = False) -> DataFrame:
    """Approximate vector_topk() from an index: query_id, product_id, score, rank and recall.

    Up to 64 queries, chosen by hash, are answered exactly as well. The number of probed blocks doubles from two
    until those find `recall` of their true neighbours, or all blocks are probed; what they found is the column recall.
    """
    blocks = index.blocks.count()
    queries = queries.select(F.col("query_id").cast("long").alias("query_id"), "vector")
    audited = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(AUDITED)
    truth = {(r.query_id, r.product_id) for r in vector_topk(audited, index.vectors, k, other).select("query_id", "product_id").collect()}  # 64 * k rows at most
    probes, reached = 2, 1.0
    while True:
        if truth:
            found = {(r.query_id, r.product_id) for r in probe(audited, index, k, probes, other).select("query_id", "product_id").collect()}
            reached = len(truth & found) / len(truth)
        if reached >= recall or probes >= blocks:
            return probe(queries, index, k, probes, other).withColumn("recall", F.lit(round(reached, 6)))
        probes = min(2 * probes, blocks)
