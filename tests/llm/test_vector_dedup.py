import math

import numpy as np

from tallymart.llm.hnsw import Graph
from tallymart.llm.vector_dedup import audited, edge_queries, search, unit, vector_dedup

SCHEMA = "vec_id long, embedding array<float>, label int, rep string, n_links int"


def table(spark, seed=1, n=300, d=8):
    r = np.random.default_rng(seed)
    base = r.normal(size=(n // 3, d))
    x = np.concatenate([base, base + r.normal(scale=0.07, size=base.shape), base + r.normal(scale=0.15, size=base.shape)]).astype(np.float32)
    x[5:40] = x[4]  # copies
    x[60:90] = x[60] + r.normal(scale=0.02, size=(30, d)).astype(np.float32)  # a dense group
    rows = [(int(i * 7 % 1009), [float(c) for c in v], int(k), "x", 1) for (i, v), k in zip(enumerate(x), r.integers(0, 3, len(x)))]
    bad = [None, [], [0.0] * d, [math.nan] * d, [math.inf] + [1.0] * (d - 1), [None] + [1.0] * (d - 1)]
    rows += [(2000 + i, v, 1, None, None) for i, v in enumerate(bad)] + [(3000, rows[0][1], None, None, None), (3001, rows[0][1], None, None, None), rows[7], (None, rows[7][1], rows[7][2], None, None)]
    return spark.createDataFrame(rows, SCHEMA), rows


def brute(rows, least=0.98):
    sound = [i for i, (v, x, k, *_) in enumerate(rows) if v is not None and k is not None and x and None not in x and np.isfinite(x).all() and any(x)]
    links, of = {i: set() for i in range(len(rows))}, {r[0]: r[0] for r in rows}

    def find(v):
        while of[v] != v:
            v = of[v]
        return v

    for a in sound:
        for b in sound:
            if a < b and rows[a][2] == rows[b][2]:
                x, y = np.array(rows[a][1], np.float64), np.array(rows[b][1], np.float64)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                    links[a].add(b)
                    links[b].add(a)
                    low, high = sorted((find(rows[a][0]), find(rows[b][0])))
                    of[high] = low
    return sorted(((-1 if r[0] is None else r[0]), len(links[i]), (-1 if r[0] is None else find(r[0])), r[0] is None or find(r[0]) == r[0]) for i, r in enumerate(rows))


def test_equals_brute_force_in_one_and_in_several_shards(spark):
    df, rows = table(spark)
    for shard in (8192, 40):
        got = sorted(tuple(-1 if c is None else c for c in r) for r in vector_dedup(df, shard=shard).collect())
        assert got == brute(rows)


def test_few_links_between_large_shards_are_found(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(3000, 32))
    x[1500:1560] = x[:60] + r.normal(scale=0.17, size=(60, 32))
    u = x.astype(np.float32).astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    truth = (u @ u.T >= 0.98).sum(1) - 1
    assert 60 <= truth.sum() <= 120
    df = spark.createDataFrame([(i, [float(c) for c in v], 1) for i, v in enumerate(x.astype(np.float32))], "vec_id long, embedding array<float>, label int")
    got = {row.vec_id: row.n_links for row in vector_dedup(df, shard=1500).select("vec_id", "n_links").collect()}
    assert [got[i] for i in range(3000)] == truth.tolist()


def test_graph_finds_neighbours():
    r = np.random.default_rng(3)
    x = r.normal(size=(1500, 16))
    x[200:700] = x[200] + r.normal(scale=0.03, size=(500, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph, truth = Graph.build(x), x @ x.T >= 0.98
    got = sum(truth[i, graph.within(x[i], 0.98, 48)].sum() for i in range(0, 1500, 10))
    assert got >= 0.98 * truth[::10].sum()


def test_empty_table(spark):
    assert vector_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def test_beams_widen_until_audits_pass():
    r = np.random.default_rng(7)
    x = unit(r.normal(size=(400, 48)))
    poor = Graph(x, [{i: [] for i in range(400)}])  # no link leads anywhere
    assert audited(poor, edge_queries(x, 0.98), 0.98, 24) >= 400
    assert (search(poor, x[:50], 0.98, 24) == (x[:50] @ x.T >= 0.98)).all()
    asked = edge_queries(x, 0.98)
    assert np.allclose((asked * x[:: 400 // 64]).sum(1), 0.98, atol=1e-4) and ((asked * x[:: 400 // 64]).sum(1) >= 0.98).all()
    graph = Graph.build(x)
    again = Graph.unpacked(x, graph.packed())
    assert all(graph.within(q, 0.98, 30) == again.within(q, 0.98, 30) for q in asked[:20])
