"""Operator 13, nearest neighbours by inner product: a forest of hash strings per shard, sorted arrays, prefixes shortened in all trees at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, ranges

TREES, SYMBOLS, AXES, SEED = 48, 6, 64, 7
SHARD, SHARD_BYTES, QUERIES = 32_768, 16 << 20, 512
#: Entries that all trees together show a query at first; the audited recall that ends the climb; audited queries of a block and shard.
ENTRIES, RECALL, AUDITED = 256, 0.95, 16

INDEX_SQL = "dim int, shard long, rows long, ids binary, vectors binary, strings binary, places binary"
BLOCK_SQL = "dim int, block long, ids binary, vectors binary"
FOUND_SQL = "query_key long, query_id long, vec_id long, score double, audit_recall double"


def rotations(dim: int, trees: int = TREES) -> np.ndarray:
    """Random projections of dim + 1 numbers to at most 64 axes: one for each tree and symbol, the same in every task."""
    r = np.random.default_rng([SEED, dim])
    return r.normal(size=(trees, SYMBOLS, dim + 1, min(AXES, dim + 1))).astype(np.float32)


def hash_strings(x: np.ndarray, spins: np.ndarray) -> np.ndarray:
    """(trees, rows) strings of one byte per symbol, first symbol highest; a symbol is the nearest of the signed axes after a rotation."""
    out, x = np.zeros((len(spins), len(x)), np.uint64), x.astype(np.float32)
    at = np.arange(len(x))
    for t, own in enumerate(spins):
        for k, spin in enumerate(own):
            y = x @ spin
            axis = np.abs(y).argmax(1)
            out[t] |= (2 * axis + (y[at, axis] > 0)).astype(np.uint64) << np.uint64(8 * (7 - k))
    return out


def lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """Vectors with one number more, all of one length, so that the largest inner product is the smallest angle."""
    norm = (x * x).sum(1)
    return np.column_stack([x, np.sqrt(np.maximum(longest * longest - norm, 0))]) / (longest or 1)


class Forest:
    """Sorted arrays of hash strings over some vectors, one array a tree."""

    def __init__(self, x: np.ndarray, strings: np.ndarray, places: np.ndarray):
        self.x, self.strings, self.places = x, strings, places
        self.short = x.astype(np.float32)
        self.longest = float(np.sqrt((x * x).sum(1)).max(initial=0))

    @classmethod
    def build(cls, x: np.ndarray, spins: np.ndarray) -> Forest:
        strings = hash_strings(lifted(x, float(np.sqrt((x * x).sum(1)).max(initial=0))), spins)
        places = np.argsort(strings, axis=1, kind="stable").astype(np.int32)
        return cls(x, np.take_along_axis(strings, places.astype(np.int64), 1), places)

    def nodes(self, strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(levels, trees, queries) first and last entries that share so many symbols with each query's string; level 0 is a whole array."""
        shape = (SYMBOLS + 1, *strings.shape)
        low, high = np.zeros(shape, np.int64), np.full(shape, self.strings.shape[1], np.int64)
        for k in range(1, SYMBOLS + 1):
            free = np.uint64((1 << 8 * (8 - k)) - 1)
            for t, own in enumerate(self.strings):
                low[k, t] = np.searchsorted(own, strings[t] & ~free, "left")
                high[k, t] = np.searchsorted(own, strings[t] | free, "right")
        return low, high

    def best(self, q: np.ndarray, own: int, ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k of these rows with the largest inner product in double precision, but for rows named like the query; single precision only rules out."""
        rows = rows[ids[rows] != own]
        if len(rows) > k:
            near = self.short[rows] @ q.astype(np.float32)
            slack = 3e-7 * (len(q) + 2) * self.longest * float(np.sqrt(q @ q))
            rows = rows[near >= np.partition(near, -k)[-k] - slack]
        score = (self.x[rows] * q).sum(1)
        first = np.lexsort((ids[rows], -score))[:k]
        return rows[first], score[first]

    def search(self, queries: np.ndarray, own: np.ndarray, ids: np.ndarray, spins: np.ndarray, k: int) -> tuple[list, float]:
        """For each query its k best candidates, and the recall among audited queries.

        Every query starts at its longest prefixes and all its trees climb together until they show `entries`
        entries. Some queries are compared with all rows; until those find RECALL of what is there, entries double.
        """
        size = np.sqrt((queries * queries).sum(1, keepdims=True))
        strings = hash_strings(np.column_stack([queries / size, np.zeros(len(queries))]), spins)
        low, high = self.nodes(strings)
        shown = (high - low).sum(1)  # levels, queries
        n, seen = len(ids), np.zeros(len(ids), bool)

        def candidates(i: int, level: int) -> np.ndarray:
            if not level:
                return np.arange(n)
            seen[:] = False
            for t in range(len(self.places)):
                seen[self.places[t, low[level, t, i] : high[level, t, i]]] = True
            return np.flatnonzero(seen)

        audited = np.unique(np.linspace(0, len(queries) - 1, min(AUDITED, len(queries))).astype(int))
        truth = {i: self.best(queries[i], own[i], ids, np.arange(n), k)[0] for i in audited}
        entries = ENTRIES
        while True:
            level = np.where(shown[1:] >= entries, np.arange(1, SYMBOLS + 1)[:, None], 0).max(0)
            found = sum(len(np.intersect1d(truth[i], self.best(queries[i], own[i], ids, candidates(i, level[i]), k)[0])) for i in audited)
            whole = sum(map(len, truth.values()))
            if found >= RECALL * whole:
                break
            entries *= 2
        return [self.best(queries[i], own[i], ids, candidates(i, level[i]), k) for i in range(len(queries))], found / whole if whole else 1.0


def sound(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding and dim of the rows that take part."""
    e = F.col("embedding")
    finite = F.forall(e, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & finite & F.exists(e, lambda c: c != 0)).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.size(e).alias("dim"))


def packed(rows: DataFrame, parts: int, schema: str, most, make) -> DataFrame:
    """Deal rows out evenly and pack those of one length into pieces of at most most(dim) vectors; make(ids, x) gives the columns after dim and number."""

    def run(batches):
        held: dict[int, list] = {}
        number = TaskContext.get().partitionId() << 32

        def flush(dim):
            nonlocal number
            ids, x = (np.concatenate(c) for c in zip(*held.pop(dim)))
            number += 1
            names = ["dim", *[c.split()[0] for c in schema.split(", ")[1:]]]
            return pa.RecordBatch.from_pylist([dict(zip(names, [dim, number, *make(ids, x)]))], schema=kinds)

        for batch in batches:
            dims = batch.column("dim").to_numpy()
            flat, starts = batch.column("embedding").flatten().to_numpy(), np.cumsum(dims) - dims
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                ids, x = batch.column("vec_id").to_numpy()[at], flat[ranges(starts[at], dims[at])].reshape(-1, dim)
                while len(ids):
                    free = most(dim) - sum(len(i) for i, _ in held.get(dim, []))
                    held.setdefault(dim, []).append((ids[:free], x[:free]))
                    ids, x = ids[free:], x[free:]
                    if sum(len(i) for i, _ in held[dim]) >= most(dim):
                        yield flush(dim)
        for dim in list(held):
            yield flush(dim)

    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    kinds = pa.schema([(n, types[t]) for n, t in (c.split() for c in schema.split(", "))])
    return rows.repartition(parts).mapInArrow(run, schema)


def nearest(vectors: DataFrame, queries: DataFrame | None = None, k: int = 20) -> DataFrame:
    """The k rows of `vectors` with the largest inner product with each row of `queries` (by default the vectors whose vec_id is divisible by 20).

    Returns query_id, rank from 1, vec_id, score and audit_recall: the share of true neighbours that the audited queries
    of the same block found in the shard the neighbour comes from. Ties go to the smaller vec_id. A query is never its own
    neighbour: rows with its vec_id are left out. Vectors that are null, empty, zero or hold nulls or non-finite numbers, and rows
    without vec_id, take no part; vectors of other lengths than the query's are no candidates of it. Repeated rows
    are candidates each, and queries each. Other columns are ignored; an empty table gives no rows.

    Vectors are dealt evenly into shards of at most 32,768 (and 16 MB in single precision), whatever their ids or
    values, and each shard keeps 48 sorted arrays of hash strings of six symbols. A string's symbols are nearest signed axes
    after random rotations. Blocks of 512 queries stream past each shard, which is the only thing a task holds. Work
    is queries x shards; what a query costs in a shard is its candidates, and audits choose how many those are.
    """
    rows = sound(vectors)
    asked = rows.where("vec_id % 20 = 0") if queries is None else sound(queries)
    counts = {r.dim: r.n for r in rows.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # one row for each length of vectors

    def most(dim: int) -> int:
        return max(256, min(SHARD, SHARD_BYTES // (4 * dim)))

    def index(ids, x):
        forest = Forest.build(x, rotations(x.shape[1]))
        return len(ids), ids.tobytes(), x.tobytes(), forest.strings.tobytes(), forest.places.tobytes()

    shards = cut(packed(rows, max(1, sum(-(-n // most(d)) for d, n in counts.items())), INDEX_SQL, most, index))
    n_shards = max(1, shards.count())
    blocks = cut(packed(asked, max(1, sum(counts.values()) // (20 * 4 * QUERIES)), BLOCK_SQL, lambda d: QUERIES, lambda ids, x: (ids.tobytes(), x.tobytes())))
    cores = rows.sparkSession.sparkContext.defaultParallelism
    slices = max(1, 2 * cores // n_shards)

    def run(batches):
        forest, of = None, None
        for batch in batches:
            for r in batch.to_pylist():
                if r["strings"] is not None:
                    x = np.frombuffer(r["vectors"]).reshape(-1, r["dim"])
                    shape = (TREES, len(x))
                    forest, ids = Forest(x, np.frombuffer(r["strings"], np.uint64).reshape(shape), np.frombuffer(r["places"], np.int32).reshape(shape)), np.frombuffer(r["ids"], np.int64)
                    of, spins = (r["dim"], r["shard"]), rotations(r["dim"])
                    continue
                if of != (r["dim"], r["shard"]):
                    continue
                own, q = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["vectors"]).reshape(-1, r["dim"])
                found, recall = forest.search(q, own, ids, spins, k)
                n = np.array([len(f) for f, _ in found])
                key = np.repeat((r["block"] << 10) + np.arange(len(own)), n)
                at = np.concatenate([f for f, _ in found])
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.repeat(own, n)), pa.array(ids[at]), pa.array(np.concatenate([s for _, s in found])), pa.array(np.full(len(at), recall))], names=["query_key", "query_id", "vec_id", "score", "audit_recall"])

    names = shards.select("dim", "shard")
    sent = blocks.join(F.broadcast(names) if n_shards <= 100_000 else names, "dim").select("dim", "shard", (F.col("block") % slices).alias("slice"), F.lit(1).alias("tag"), "block", "ids", "vectors", F.lit(None).cast("binary").alias("strings"), F.lit(None).cast("binary").alias("places"))
    held = shards.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)).cast("array<long>"))).select("dim", "shard", "slice", F.lit(0).alias("tag"), F.lit(None).cast("long").alias("block"), "ids", "vectors", "strings", "places")
    met = held.unionByName(sent).repartition(max(cores, n_shards * slices), "shard", "slice").sortWithinPartitions("shard", "slice", "tag", "block")
    found = met.mapInArrow(run, FOUND_SQL)
    rank = F.row_number().over(Window.partitionBy("query_key").orderBy(F.desc("score"), "vec_id")).alias("rank")
    return found.select("*", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "audit_recall")
