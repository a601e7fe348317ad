"""What only large tables show, on small ones that are made so: queries against their SQL, and plans."""

from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from tallymart.plans import registry

DAY = datetime(1998, 3, 1)


@pytest.fixture
def differs(spark, tmp_path):
    """Writes tables (name to (schema, rows)) and says which rows a query and its SQL do not share."""

    def run(name, **tables):
        duck = duckdb.connect()
        duck.sql("SET timezone = 'UTC'")
        for table, (kinds, rows) in tables.items():
            spark.createDataFrame(rows, kinds).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/{table}.parquet")
            duck.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
        got, want = registry.QUERIES[name](spark, str(tmp_path)).toPandas(), duck.sql(registry.ORACLE[name]).df()
        assert len(want)
        as_rows = lambda df: sorted(tuple(map(str, r)) for r in df[sorted(df.columns)].itertuples(index=False))
        got, want = as_rows(got), as_rows(want)
        return [(a, b) for a, b in zip(got, want) if a != b] or len(got) - len(want)

    return run


LINES = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double"
ORDERS = "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz"


def test_watches_are_updated_by_line_whatever_the_size_of_ids(differs):
    """Product ids of a million and more, and order keys that make ids beyond 2^53."""
    lines = [(10_000_000 + i % 7, 1_200_001 + i % 3, 5, 1 + i % 7, 2.0, 50.0) for i in range(60)]
    orders = [(10_000_000 + i, 1, DAY + timedelta(days=11 * i % 17)) for i in range(7)]
    assert not differs("j5_upsert_watches", lineitem=(LINES, lines), orders=(ORDERS, orders))


@pytest.mark.parametrize("name", ["k4_request_metrics", "k4_sliding_metrics"])
def test_percentiles_of_a_full_window_are_exact(differs, name):
    """More requests in a window, all of other latencies, than a sketch keeps."""
    events = [(i, DAY + timedelta(milliseconds=50 * i), "view" if i % 3 else "click", float(i * 7919 % 60_013)) for i in range(60_000)]
    assert not differs(name, events=("event_id long, ts timestamp_ntz, event_type string, value double", events))


def test_products_meet_requests_and_not_queries(spark):
    """Many queries that name the same entities: no join of the fallback has a row per query and product."""
    from tallymart.operators.search import catalog_fallback

    catalog = spark.range(3000).selectExpr("id AS product_id", "concat('a ring ', id % 3) AS title", "concat('Brand#', id % 4) AS brand", "concat('s', id % 5) AS sub_category")
    entities = spark.range(1000).selectExpr("id AS query_id", "'ring' AS entity", "'title' AS kind", "CASE id % 3 WHEN 0 THEN array('s3') WHEN 1 THEN array('s2', 's9') END AS prefer")
    for keep in (None, lambda rows: rows.where("product_id > 9")):
        got = catalog_fallback(entities.withColumn("same", F.col("query_id") % 3), catalog, keep, "same")
        got.write.format("noop").mode("overwrite").save()
        first = {0: 13, 1: 12, 2: 10} if keep else {0: 3, 1: 2, 2: 0}
        rows = got.collect()
        assert len(rows) == 1000 and all(r.product_id == first[r.query_id % 3] and r.title == f"a ring {r.product_id % 3}" for r in rows)
        most, plan = 0, [got._jdf.queryExecution().executedPlan()]
        while plan:
            node = plan.pop()
            if node.nodeName().startswith("AdaptiveSparkPlan"):
                plan.append(node.executedPlan())
            if node.nodeName().endswith("QueryStage"):
                plan.append(node.plan())
            if node.metrics().contains("numOutputRows"):
                most = max(most, node.metrics().apply("numOutputRows").value())
            plan += [node.children().apply(i) for i in range(node.children().size())]
        assert 1000 <= most < 20_000


def test_equal_searches_are_answered_once(spark):
    """Texts that differ by a word that no product has share one scoring; other filters do not."""
    from tallymart.operators.search import search

    catalog = spark.createDataFrame([(i, f"red ring {i % 2}", f"B{i % 3}", "c", "s", "d", 10.0 * i, 10.0 * i, "CNY", "CN") for i in range(1, 9)] + [(i, f"bolt w{i}", "B9", "c", "s", "d", 10.0, 10.0, "CNY", "CN") for i in range(9, 40)], "product_id long, title string, brand string, category string, sub_category string, description string, base_price double, price_cny double, currency string, origin string")
    texts = ["red ring", "red ring zzz", "ring red", "red ring under 30", "red ring under 30 please"]
    queries = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "query_id long, user_id long, text string")
    seen = []
    got = search(queries, catalog, keep=lambda df: seen.append(df) or df)
    rows = {i: [] for i in range(5)}
    for r in sorted(got.collect(), key=lambda r: (r.query_id, r.rank)):
        rows[r.query_id].append(r.product_id)
    assert rows[0] == rows[1] == rows[2] and rows[3] == rows[4] and rows[0] != rows[3] and set(rows[3]) <= {1, 2, 3} and len(rows[0]) == 5, rows
    shared = next(df for df in seen if df.columns == ["vid", "asks"])
    assert shared.count() == 5 and shared.select("asks").distinct().count() == 2


def test_scan_equals_search_by_joins_and_shuffles_no_texts(spark):
    """Ties, words that are in most documents, several blocks of queries; and the plan of the cases has no shuffle that carries documents."""
    from tallymart.operators import scan
    from tallymart.operators.retrieval import bm25_topk
    from tallymart.plans.search import holding

    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 23}" for j in range(1, 2 + i % 9)) + " all 防晒霜" * (i % 2)) for i in range(200)] + [(999, None)], "product_id long, text string")
    queries = spark.createDataFrame([(i, f"w{i} all w{i * 7 % 23} 防晒 none") for i in range(30)] + [(40, ""), (41, None)], "query_id long, text string")
    old, scan.QUERIES = scan.QUERIES, 8
    try:
        got = scan.bm25_scan(queries, docs, 5)
    finally:
        scan.QUERIES = old
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(got) == rows(bm25_topk(queries, docs, 5)) and got.count() > 100
    plan = holding(docs, queries)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
