"""Operator 9, embedding near-dedup: a small-world graph per shard, every shard queried, cosine verified, components.

Equal vectors of a label collapse to a class first, so a vector that a third
of all rows share is one node. Each shard of a label has a graph. The vectors
of a shard query their own graph and those of all later shards, so every pair
of shards meets once; a copy of a graph serves PER_GRAPH shards of queries, which carry
vectors only. Counts of links leave the task as one number per class and links as a
spanning forest, so a dense group costs rows in proportion to its size.

A beam is wide enough when an audit against all nodes of the shard finds RECALL of the
true links. A graph is audited once with made queries just above the limit of some
of its nodes, so that there is always something to find, and each shard of queries with
a part of its own vectors. A graph that no beam makes good is replaced by comparing all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import components
from .hnsw import Graph

#: Vectors in a shard, about, and shards of queries that share a copy of a graph.
SHARD, PER_GRAPH = 2048, 4
#: First beam, share of audited links to be found, and queries per audit.
BEAM, RECALL, AUDITED = 24, 0.995, 64


def classes_of(vectors: DataFrame) -> DataFrame:
    """Distinct usable vectors: label, embedding, rep (least vec_id), weight."""
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    usable = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & (square > 0)
    return vectors.where(usable).groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"))


def unit(raw: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision and without overflow."""
    x = raw.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def hits(graph: Graph, queries: np.ndarray, least: float, beam: int) -> np.ndarray:
    """Which nodes (columns) each query (row) finds; a beam as wide as the graph compares with all."""
    if beam >= len(graph.vectors):
        return queries @ graph.vectors.T >= least
    out = np.zeros((len(queries), len(graph.vectors)), bool)
    for i, q in enumerate(queries):
        out[i, graph.within(q, least, beam)] = True
    return out


def audited(graph: Graph, queries: np.ndarray, least: float, beam: int) -> int:
    """The first beam, doubling from `beam` on, that finds RECALL of the true links of these queries."""
    truth = queries @ graph.vectors.T >= least
    while beam < len(graph.vectors) and (hits(graph, queries, least, beam) & truth).sum() < RECALL * truth.sum():
        beam *= 2
    return beam


def edge_queries(nodes: np.ndarray, least: float) -> np.ndarray:
    """A query for each of some nodes, at a cosine just above the limit."""
    some = nodes[:: max(1, len(nodes) // AUDITED)]
    aside = np.random.default_rng(23).normal(size=some.shape)
    aside -= (aside * some).sum(1, keepdims=True) * some
    length = np.linalg.norm(aside, axis=1, keepdims=True)
    cosine = min(1.0, least + 1e-6)
    return np.where(length > 1e-9, cosine * some + (1 - cosine**2) ** 0.5 * aside / np.maximum(length, 1e-9), some)


def search(graph: Graph, queries: np.ndarray, least: float, beam: int) -> np.ndarray:
    """Which nodes (columns) each query (row) is linked with, by a beam that passes an audit of these queries too."""
    return hits(graph, queries, least, audited(graph, queries[:: max(1, len(queries) // AUDITED)], least, beam))


def shards(classes: DataFrame, size: int, least: float, kind: type) -> DataFrame:
    """A row per shard: label, dims, shards of the label, shard, ids, weights, vectors, packed graph and its beam."""
    classes = classes.withColumn("dims", F.size("embedding"))
    counts = classes.groupBy("label", "dims").agg(F.ceil(F.count("*") / size).cast("int").alias("shards"))
    placed = classes.join(counts, ["label", "dims"]).withColumn("shard", F.pmod(F.xxhash64("rep"), "shards").cast("int"))

    def run(key, table):
        table = table.sort_by("rep")
        raw = table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, key[1].as_py()).astype(kind)
        graph = Graph.build(unit(raw))
        beam = audited(graph, edge_queries(graph.vectors, least), least, BEAM)
        own = [*(k.as_py() for k in key), *(table.column(c).to_numpy().astype(np.int64).tobytes() for c in ("rep", "weight")), raw.tobytes(), graph.packed(), beam]
        kinds = (table.schema.field("label").type, pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 4, pa.int32())
        return pa.table([pa.array([v], k) for v, k in zip(own, kinds)], names=["label", "dims", "shards", "shard", "reps", "weights", "raw", "graph", "beam"])

    label = classes.schema["label"].dataType.simpleString()
    return placed.groupBy("label", "dims", "shards", "shard").applyInArrow(run, f"label {label}, dims int, shards int, shard int, reps binary, weights binary, raw binary, graph binary, beam int")


def forest(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect whatever the rows (left ids) and columns (right ids) of a matrix connect."""
    i, j = np.nonzero(linked)
    ids, at = np.unique(np.r_[left[i], right[j]], return_inverse=True)
    a, b = at[: len(i)], at[len(i) :]
    root = np.arange(len(ids))
    while len(a):
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        low = np.minimum(low, low[low])
        if (low == root).all():
            break
        root = low
    own = np.flatnonzero(root != np.arange(len(ids)))
    return ids[own], ids[root[own]]


def linked(rows: DataFrame, least: float, kind: type) -> DataFrame:
    """Rows (a, b, n): n links of class a if b is null, else a link of the forest."""
    meet, vectors = ["label", "dims", "target", "part"], ["shard", "reps", "weights", "raw"]
    graphs = rows.select("label", "dims", F.col("shard").alias("target"), F.explode(F.expr(f"sequence(0, int(shard div {PER_GRAPH}))")).alias("part"), F.lit(0).alias("role"), *vectors, "graph", "beam")
    queries = rows.select("label", "dims", F.explode(F.sequence("shard", F.col("shards") - 1)).alias("target"), F.expr(f"int(shard div {PER_GRAPH})").alias("part"), F.lit(1).alias("role"), *vectors, F.lit(None).cast("binary").alias("graph"), F.lit(None).cast("int").alias("beam"))

    def run(batches):
        graph = ids = weights = beam = None
        for batch in batches:
            for row in batch.to_pylist():
                own, weight = (np.frombuffer(row[c], np.int64) for c in ("reps", "weights"))
                x = unit(np.frombuffer(row["raw"], kind).reshape(-1, row["dims"]))
                if not row["role"]:
                    graph, ids, weights, beam = Graph.unpacked(x, row["graph"]), own, weight, row["beam"]
                    continue
                found = search(graph, x, least, beam)
                if row["shard"] == row["target"]:
                    found |= found.T
                    np.fill_diagonal(found, False)
                    counts = [(own, found @ weights)]
                else:
                    counts = [(own, found @ weights), (ids, found.T @ weight)]
                a, b = forest(found, own, ids)
                for who, n in counts:
                    some = n > 0
                    yield pa.RecordBatch.from_arrays([pa.array(who[some]), pa.nulls(int(some.sum()), pa.int64()), pa.array(n[some])], names=["a", "b", "n"])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.zeros(len(a), np.int64))], names=["a", "b", "n"])

    return graphs.unionByName(queries).repartition(*meet).sortWithinPartitions(*meet, "role", "shard").mapInArrow(run, "a long, b long, n long")


def vector_dedup(vectors: DataFrame, similarity: float = 0.98, shard: int = SHARD) -> DataFrame:
    """Link vectors of equal, non-null labels with a cosine (in double precision) of `similarity` or more.

    Returns a row per vector: vec_id, n_links (other vectors linked directly),
    component_id (least vec_id reachable over links) and kept (vec_id =
    component_id). Links are those found by the graphs, each verified; audits make the beams
    wide enough. Queries of a label grow with the square of its shards.

    Vectors that are null, empty, zero, or hold a null or a non-finite
    component, or have a null label or vec_id, link with nothing (their
    component_id is their vec_id, kept is true). Vectors of other lengths are
    not compared. Repeated rows are vectors like others, and
    linked. Other columns are ignored.
    """
    vectors = vectors.select("vec_id", "label", "embedding")
    kind = np.float32 if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else np.float64
    classes = cut(classes_of(vectors))
    found = cut(linked(cut(shards(classes, shard, similarity, kind)), similarity, kind))
    links = found.where("b is null").groupBy("a").agg(F.sum("n").alias("links"))
    groups = components(found.where("b is not null").select("a", "b"))
    placed = classes.join(links.withColumnRenamed("a", "rep"), "rep", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    placed = cut(placed.select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    sound = F.when(F.col("vec_id").isNotNull(), F.lit(True))
    out = vectors.withColumn("sound", sound).join(placed.withColumn("sound", F.lit(True)), ["label", "embedding", "sound"], "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
