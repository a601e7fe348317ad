"""Every registered query with SQL gives the rows of its SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallymart.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.sql("SET timezone = 'UTC'")
    for name in os.listdir(SF):
        if name.endswith(".parquet"):
            connection.sql(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{SF}/{name}'")
    return connection


def cell(v):
    if v is None or not hasattr(v, "__len__") and pd.isna(v):
        return "~"
    if isinstance(v, bool) or type(v).__name__ == "bool":
        return str(bool(v))
    try:
        return f"{float(v):.5f}"
    except (TypeError, ValueError):
        return str(v)


def rows(df):
    return sorted(tuple(cell(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_sql(spark, duck, name):
    got, expected = registry.QUERIES[name](spark, SF).toPandas(), duck.sql(registry.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)


def test_coverage_brings_every_entity_with_a_product_into_the_first_five(spark):
    """e12, in words. Titles come last, so no later entity takes their place."""
    from tallymart.operators.retrieval import top_k
    from tallymart.operators.search import catalog_fallback
    from tallymart.plans.base import catalog_view
    from tallymart.plans.catalog import bought
    from tallymart.plans.messages import entities

    assert set(registry.QUERIES) - set(registry.ORACLE) == {"e3_probed_topk", "i7_rolled_latency"}
    shelf = {r.product_id: r for r in catalog_view(spark, SF).collect()}
    before, got = {}, {}
    for r in top_k(bought(spark, SF), 20, order=[F.asc("product_id")]).collect():
        before.setdefault(r.query_id, set()).add(r.product_id)
    for r in registry.QUERIES["e12_brand_coverage"](spark, SF).orderBy("query_id", "position").collect():
        got.setdefault(r.query_id, []).append(r.product_id)
    spare = {(r.query_id, r.entity): r.product_id for r in catalog_fallback(entities(spark, SF), catalog_view(spark, SF)).collect()}
    named = entities(spark, SF).collect()
    assert set(got) == set(before) and named
    for query, rows in got.items():
        added = set(rows) - before[query]
        assert before[query] <= set(rows) and len(rows) == len(set(rows)) and added <= {p for (q, _), p in spare.items() if q == query}

    def names(entity, product):
        if entity.kind == "title":
            return entity.entity.lower() in product.title.lower()
        a, b = entity.entity.lower(), product.brand.lower()
        return a in b or b in a

    seen = 0
    for e in named:
        if e.kind == "title" and e.query_id in got and ((e.query_id, e.entity) in spare or any(names(e, shelf[p]) for p in before[e.query_id])):
            assert any(names(e, shelf[p]) for p in got[e.query_id][:5])
            seen += 1
    assert seen > 5
