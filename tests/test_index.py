"""Postings and cells: the same rows as the plain search, or the recall that is told."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymart.operators.cells import build_cells, cells_topk
from tallymart.operators.postings import build_postings, postings_topk
from tallymart.operators.retrieval import bm25_topk
from tallymart.operators.vectors import vector_topk


def texts(spark, n, words, seed):
    r = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(words)] + ["耳机", "蓝牙耳机"]
    weights = 1 / np.arange(1, len(vocabulary) + 1)
    rows = [(int(i), " ".join(r.choice(vocabulary, r.integers(1, 30), p=weights / weights.sum()))) for i in range(n)] + [(n, None), (n + 1, ""), (n + 2, "only here")]
    return spark.createDataFrame(rows, "product_id long, text string")


def rows(df):
    return sorted(tuple(r) for r in df.select("query_id", "product_id", "score", "rank").collect())


@pytest.mark.parametrize("block", [1, 16, 10_000])
def test_postings_give_the_rows_of_a_full_scan(spark, tmp_path, block):
    docs = texts(spark, 400, 60, 1)
    queries = texts(spark, 25, 60, 2).withColumnRenamed("product_id", "query_id")
    index = build_postings(docs, str(tmp_path / "index"), block=block, buckets=3)
    assert rows(postings_topk(queries, index, 7)) == rows(bm25_topk(queries, docs, 7))
    odd = lambda scored: scored.where("product_id % 2 = 1")
    assert rows(postings_topk(queries, index, 7, odd)) == rows(bm25_topk(queries, docs, 7, keep=odd))


def test_blocks_under_the_bound_are_not_read(spark, tmp_path):
    r = np.random.default_rng(3)
    docs = spark.createDataFrame([(i, "rare " * 5 if i < 3 else " ".join(f"w{c}" for c in r.integers(0, 50, 40)) + (" rare" if i % 10 == 0 else "")) for i in range(2000)], "product_id long, text string")
    index = build_postings(docs, str(tmp_path / "index"), block=10, buckets=3)
    queries = spark.createDataFrame([(1, "rare")], "query_id long, text string")
    best = postings_topk(queries, index, 3)
    assert [x.product_id for x in best.orderBy("rank").collect()] == [0, 1, 2]
    weighed = index.terms.where("term = 'rare'").select(F.col("idf")).first().idf
    bounds = [x.most * weighed for x in index.maxima.where("term = 'rare'").collect()]
    least = min(x.score for x in best.collect())
    assert len(bounds) > 100 and sum(b >= least for b in bounds) <= 3


def test_joins_of_entries_use_the_buckets(spark, tmp_path):
    index = build_postings(texts(spark, 50, 20, 1), str(tmp_path / "index"), buckets=3)
    plan = index.entries.groupBy("term", "block").agg(F.max("impact"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_empty_postings(spark, tmp_path):
    none = spark.createDataFrame([], "product_id long, text string")
    index = build_postings(none, str(tmp_path / "index"))
    assert rows(postings_topk(spark.createDataFrame([(1, "a")], "query_id long, text string"), index)) == []


def vectors(spark, n=3000, dims=16, seed=4):
    r = np.random.default_rng(seed)
    x = r.normal(size=(20, dims))[r.integers(0, 20, n)] + r.normal(scale=0.5, size=(n, dims))
    x[100:1100] = x[100]  # a third are copies
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(n, None)], "product_id long, vector array<double>")


def test_cells_find_what_they_say(spark, tmp_path):
    df = vectors(spark)
    queries = df.where("product_id % 15 = 0").withColumnRenamed("product_id", "query_id")
    index = build_cells(df, str(tmp_path / "cells"), cells=24, rounds=3)
    got, truth = cells_topk(queries, index, 5).collect(), vector_topk(queries, df, 5).collect()
    assert {(r.query_id, r.rank) for r in got} == {(r.query_id, r.rank) for r in truth}
    recall = len({(r.query_id, r.product_id) for r in got} & {(r.query_id, r.product_id) for r in truth}) / len(truth)
    assert recall >= 0.9 and min(r.recall for r in got) >= 0.92
    assert index.blocks.agg(F.max(F.length("ids"))).first()[0] <= 8 * 2048 * 1.2


def test_vectors_of_several_lengths_and_none(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0]), (4, None), (5, [])], "product_id long, vector array<double>")
    queries = df.withColumnRenamed("product_id", "query_id")
    got = {(r.query_id, r.product_id): r.score for r in vector_topk(queries, df, 2).collect()}
    assert got == {(1, 1): 1.0, (1, 2): 0.0, (2, 2): 1.0, (2, 1): 0.0, (3, 3): 1.0}
    index = build_cells(df.where("product_id = 9"), str(tmp_path / "none"))
    assert cells_topk(queries, index, 2).collect() == []
