import math
import os

import numpy as np
import pytest

from tallymart.llm import forest, queries
from tallymart.llm.forest import Forest, nearest, rotations

SCHEMA = "vec_id long, embedding array<float>, label int, rank string, dim int"
SF = "/root/testdata/sf0.01"


def table(spark, x, ids=None):
    return spark.createDataFrame([(int(i), None if v is None else [None if c is None else float(c) for c in v], 1, "x", 9) for i, v in zip(range(len(x)) if ids is None else ids, x)], SCHEMA)


def brute(rows, k=20):
    out = {}
    for q, x in rows:
        if q % 20 == 0:
            own = sorted((-float(np.dot(np.array(x, np.float64), np.array(y, np.float64))), i) for i, y in rows if i != q and len(y) == len(x))
            out[q] = [(i, -s) for s, i in own[:k]]
    return out


def recall(got, truth):
    return sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in t}) for q, t in truth.items()) / sum(map(len, truth.values()))


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_finds_neighbours_in_several_shards(spark, monkeypatch):
    monkeypatch.setattr(forest, "SHARD", 700)
    r = np.random.default_rng(4)
    x = r.normal(size=(2000, 24)) * r.uniform(0.2, 3, size=(2000, 1))  # lengths differ: the largest product is not the smallest angle
    x[100:400] = x[100] + r.normal(scale=0.1, size=(300, 24))  # a dense group
    x[500:900] = x[500]  # copies
    x = x.astype(np.float32)
    got, truth = answers(nearest(table(spark, x))), brute(list(enumerate(x)))
    assert set(got) == set(truth) and all(len(v) == 20 for v in got.values())
    assert recall(got, truth) >= 0.9
    for q, own in got.items():
        assert all(i != q and abs(s - np.dot(x[q].astype(np.float64), x[i].astype(np.float64))) < 1e-9 for i, s in own)
        assert own == sorted(own, key=lambda p: (-p[1], p[0]))
    assert [i for i, _ in got[500]] == [i for i, _ in truth[500]]  # ties go to the smallest ids


def test_rows_that_take_no_part(spark):
    x = [[1.0, 2.0], None, [], [0.0, 0.0], [math.nan, 1.0], [math.inf, 1.0], [None, 1.0], [1.0, 0.5], [3.0], [2.0], [1.0, 2.0]]
    df = table(spark, x, [0, 20, 40, 60, 80, 100, 120, 7, 160, 9, 7]).unionByName(table(spark, [[5.0, 5.0]], [11]))
    got = answers(nearest(df.union(spark.createDataFrame([(None, [9.0, 9.0], 1, "x", 1)], SCHEMA))))
    assert got == {0: [(11, 15.0), (7, 5.0), (7, 2.0)], 160: [(9, 6.0)]}


def test_empty_table(spark):
    assert nearest(table(spark, [])).collect() == []


def test_prefixes_in_sorted_arrays():
    x = np.random.default_rng(1).normal(size=(300, 10))
    tree = Forest.build(x, rotations(10, 3))
    strings = np.take_along_axis(tree.strings, np.argsort(tree.places, axis=1), 1)
    low, high = tree.nodes(strings[:, :5])
    for k in range(7):
        for t in range(3):
            for i in range(5):
                same = {j for j in range(300) if (int(strings[t, j]) >> 8 * (8 - k) if k else 0) == (int(strings[t, i]) >> 8 * (8 - k) if k else 0)}
                assert set(tree.places[t, low[k, t, i] : high[k, t, i]].tolist()) == same


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
def test_registered_query_has_the_recall(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got, truth = answers(queries.op13_nearest(spark, SF)), brute(rows)
    assert set(got) == set(truth) and recall(got, truth) >= 0.9
