"""Facts about single operators on hand-made rows."""

import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tallymart.plans.base import written
from tallymart.functions import parsing as ps
from tallymart.functions import text as tx
from tallymart.operators import conversation as cv
from tallymart.operators import evaluation as ev
from tallymart.operators import filters as fl
from tallymart.operators import hooks
from tallymart.operators import joins as jn
from tallymart.operators import lifecycle as lc
from tallymart.operators import retrieval as rt
from tallymart.operators import search as se
from tallymart.operators.vectors import vector_topk

T0 = datetime(2024, 1, 1)


def one(spark, expr, text):
    return spark.createDataFrame([(text,)], "text string").select(expr.alias("x")).first().x


def test_tokens_have_words_and_cjk_bigrams(spark):
    assert one(spark, tx.tokens("text"), "Red_ring X1 蓝牙耳机 a好b") == ["red_ring", "x1", "a", "b", "蓝牙", "牙耳", "耳机", "好"]
    assert one(spark, tx.tokens("text"), None) == []


def test_prices_convert_and_a_missing_rate_fails_bounds(spark):
    rows = [("a", 72.0, "USD", [("s", 80.0)]), ("b", 89.0, "CNY", []), ("c", 5.0, "EUR", []), ("d", 5.0, None, [])]
    catalog = spark.createDataFrame(rows, "product_id string, base_price double, currency string, skus array<struct<sku_id:string,price:double>>")
    out = {r.product_id: r for r in jn.convert_prices(catalog, spark.createDataFrame([("USD", 7.0)], "currency string, rate double")).collect()}
    assert float(out["a"].price_cny) == 504.0 and float(out["a"].skus[0].price_cny) == 560.0 and float(out["b"].price_cny) == 89.0 and out["c"].price_cny is None and float(out["d"].price_cny) == 5.0
    gate = spark.createDataFrame([(None, "USD", 9.0, 1.0, None), (2.0, "USD", 9.0, 1.0, 2.0)], "price_cny double, currency string, base_price double, price_min double, price_max double")
    assert [tuple(r) for r in gate.select(fl.price_gate(True), fl.price_gate(False)).collect()] == [(False, True), (True, True)]


def test_snooze_hides_for_a_day(spark):
    rows = [(1, "u", "p", T0 - timedelta(days=5), T0), (2, "u", "q", T0 - timedelta(days=30), None)]
    bought = spark.createDataFrame(rows, "id long, user_id string, product_id string, next_due_at timestamp, last_shown_at timestamp")
    at = lambda t: F.lit(t.isoformat(sep=" ")).cast("timestamp")
    assert [r.id for r in lc.due_rows(bought, at(T0 + timedelta(seconds=60)), 3).collect()] == [2]
    assert [r.id for r in lc.due_rows(bought, at(T0 + timedelta(hours=25)), 3).orderBy("position").collect()] == [2, 1]
    overdue = spark.createDataFrame([(i, "u", "p", T0 - timedelta(days=d), None) for i, d in enumerate((5, 30, 2, 20))], bought.schema)
    catalog = spark.createDataFrame([("p", "t")], "product_id string, title string")
    assert [r.days_overdue for r in lc.due_reminders(overdue, catalog, at(T0), 3).orderBy("position").collect()] == [30, 20, 5]


def test_scores_clamp_at_every_event(spark):
    catalog = spark.createDataFrame([("p", "b", None, "")], "product_id string, brand string, category string, sub_category string")
    rows = [("u", "p", T0 + timedelta(hours=7 * i), i, 1) for i in range(13)] + [("u", "p", T0 + timedelta(days=9), 99, -1)]
    feedback = spark.createDataFrame(rows, "user_id string, product_id string, ts timestamp, id long, signal int")
    assert [tuple(r) for r in lc.preference_scores(feedback, catalog).collect()] == [("u", "brand", "b", 8)]


def test_fusion_scores(spark):
    ranks = "query_id long, product_id long, rank int"
    out = {r.product_id: r for r in rt.rrf(spark.createDataFrame([(1, 1, 1), (1, 2, 2)], ranks), spark.createDataFrame([(1, 1, 1), (1, 3, 2)], ranks)).collect()}
    assert round(out[1].score, 6) == round(2 / 61, 6) and [out[i].rank for i in (1, 2, 3)] == [1, 2, 3] and out[3].dense_rank is None


def test_metrics_of_a_case(spark):
    cases = spark.createDataFrame([(1, ["a", "b"], ["x"]), (2, [], None), (3, None, ["x"])], "query_id long, expected array<string>, forbidden array<string>")
    results = spark.createDataFrame([(1, "x", 1), (1, "a", 2)], "query_id long, product_id string, rank int")
    got = {r.query_id: tuple(r)[1:] for r in ev.case_metrics(results, cases).collect()}
    assert got == {1: (0.5, 0.5, 0.5, 0.2, 0.5), 2: (None,) * 5, 3: (None, None, None, None, 1.0)}


def test_fail_soft_keeps_a_list_that_would_be_empty(spark):
    pairs = spark.createDataFrame([(1, "CN"), (1, "US"), (2, "US"), (3, None)], "query_id long, origin string").withColumn("domestic", F.lit(True))
    assert sorted((r.query_id, r.origin or "") for r in fl.domestic_only(pairs).collect()) == [(1, "CN"), (2, "US"), (3, "")]


def test_brand_mentions():
    texts = ["推荐耐克的鞋", "不要耐克", "华为以外还有吗", "小米的就算了", "不要苹果的耳机", "苹果的不要太贵", "laptop for programming", "iphone13 please", None, "不要索尼的、苹果的"]
    brands = {"Nike": ["耐克"], "华为": [], "小米": ["mi"], "Apple": ["苹果", "iphone"], "索尼": []}
    got = ps.mentions(pd.Series(texts), ps.Names(brands))
    assert got.included.tolist() == [["Nike"], [], [], [], [], ["Apple"], [], ["Apple"], [], []]
    assert got.excluded.tolist() == [[], ["Nike"], ["华为"], ["小米"], ["Apple"], [], [], [], [], ["Apple", "索尼"]]


def test_cart_phrases(spark):
    cases = {"帮我下单": ("checkout", None, None), "先不要下单": (None, None, None), "买单反相机": (None, None, None), "check out these headphones": (None, None, None), "清空购物车": ("clear", None, None), "把数量改成2": ("set_quantity", -1, 2), "第二个改成十二个": ("set_quantity", 2, 12), "要2个面霜": (None, None, None), "删掉最后一个": ("remove", -1, None), "不要第二个": (None, None, None), "购物车里不要第二个": ("remove", 2, None), "add it to my cart": ("add", None, None), "": (None, None, None)}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, text string").select("i", ps.parse_cart_intent("text").alias("x")).orderBy("i")
    assert [tuple(r.x) for r in df.collect()] == list(cases.values())


def test_price_words(spark):
    cases = {"这些太便宜了，推荐一些贵的": "expensive", "太贵了": "cheap", "any cheaper ones?": "cheap", "500以内": "cheap", "500以上": "expensive", "好看的": None, "0元以内": "cheap"}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, text string").select("i", tx.price_intent("text").alias("x"), tx.price_max("text").alias("m")).orderBy("i")
    assert [r.x.direction for r in df.collect()] == list(cases.values()) and df.collect()[-1].m is None


def test_turns_are_carried_replaced_and_cancelled(spark):
    talks = {1: ["推荐护肤 300以内 耐克", "不要耐克", "预算不限"], 2: ["数码产品 耐克 1000以上", "换个别的", "推荐化妆品"], 3: ["你好"], 4: ["不要日系", "国别不限"]}
    rows = [(c, 2 * i, "user", t) for c, own in talks.items() for i, t in enumerate(own)]
    out = {r.conv_id: r for r in cv.conversation_filter(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), {"Nike": ["耐克"]}, {"nike": {"数码电子"}}).collect()}
    assert (out[1].category, out[1].price_max, out[1].brand_include, out[1].brand_exclude) == ("美妆护肤", None, None, ["Nike"])
    assert (out[2].category, out[2].price_min, out[2].brand_include) == ("美妆护肤", None, None)
    assert out[3].category is None and out[4].exclude_keywords is None


def test_any_refused_mention_excludes_and_terms_may_overlap():
    got = ps.mentions(pd.Series(["小米好，不要小米", "Brand#12", "xbrand#1", "brand#1b", "小米有品"]), ps.Names({"小米": [], "有品": ["小米有品"], "Brand#1": [], "Brand#12": []}))
    assert got.included.tolist() == [[], ["Brand#1", "Brand#12"], [], [], ["小米", "有品"]] and got.excluded.tolist() == [["小米"], [], [], [], []]


def test_windows_carry_what_turns_one_by_one_carry(spark):
    r = random.Random(8)
    parts = ["推荐护肤", "数码产品", "家居", "耐克", "华为", "不要华为", "不要耐克", "除了小米以外", "小米", "300以内", "50元以上", "不要日系", "不要美货", "预算不限", "品牌不限", "品类不限", "国别不限", "也可以", "换个别的", "洗面奶", "手机壳", "你好"]
    rows = [(c, t, "user" if r.random() < 0.8 else "assistant", "，".join(r.sample(parts, r.randint(1, 4)))) for c in range(150) for t in range(r.randint(1, 9))]
    brands = {"Nike": ["耐克"], "华为": [], "小米": []}
    shelves, subs = {"nike": {"数码电子", "家居家具"}, "华为": {"数码电子"}}, {"美妆护肤": {"洁面"}, "数码电子": {"手机配件"}}
    rules = [(("洗面奶",), ("洁面",)), (("手机壳",), ("手机配件", "壳"))]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    expected = {}
    for row in cv.turn_columns(turns, brands, rules).orderBy("conv_id", "turn").collect():
        expected[row.conv_id] = cv.next_filter(expected.get(row.conv_id, cv.EMPTY), row.asDict(), shelves, subs)
    got = {x.conv_id: {k: x[k] for k in cv.EMPTY} for x in cv.conversation_filter(turns, brands, shelves, subs, rules).collect()}
    assert got == expected and sum(bool(x["brand_include"]) for x in got.values()) > 9 and sum(bool(x["brand_exclude"]) for x in got.values()) > 9


def test_relaxed_prices_and_stripped_clauses(spark):
    assert one(spark, ps.strip_price("text"), "1000以内的耳机") == "耳机" and one(spark, ps.strip_price("text"), "headphones under 1000") == "headphones"
    assert one(spark, ps.strip_negation("text"), "推荐咖啡,不要速溶的") == "推荐咖啡" and one(spark, ps.reorder_negation("text"), "不要苹果的耳机") == "耳机 不要苹果"


def test_coverage_promotes_from_the_tail_and_the_catalog(spark):
    ranked = spark.createDataFrame([(1, i, i, f"t{i}", "a" if i < 6 else "b") for i in range(1, 9)], "query_id long, product_id long, rank int, title string, brand string")
    entities = spark.createDataFrame([(1, "a", "brand"), (1, "b", "brand"), (1, "phone", "title")], "query_id long, entity string, kind string")
    spare = spark.createDataFrame([(1, "phone", "title", 77, "a phone", "c", "s")], "query_id long, entity string, kind string, product_id long, title string, brand string, sub_category string")
    got = [r.product_id for r in se.brand_coverage(ranked, entities, spare).orderBy("position").collect()]
    assert set(got[:5]) == {1, 2, 3, 6, 77} and sorted(got) == [1, 2, 3, 4, 5, 6, 7, 8, 77]


def test_user_ids_move_unless_they_collide(spark):
    table = spark.createDataFrame([("anon", "x"), ("acct", "x"), ("anon2", "y"), ("z", "q")], "user_id string, product_id string")
    mapping = spark.createDataFrame([("anon", "acct"), ("anon2", "acct"), ("z", "z"), (None, "a")], "old_id string, new_id string")
    assert sorted(map(tuple, jn.rekey_users(table, mapping, ["product_id"]).collect())) == [("acct", "x"), ("acct", "y"), ("anon", "x"), ("z", "q")]


def test_vector_topk_equals_a_full_sort(spark):
    x = np.random.default_rng(1).normal(size=(300, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    v = spark.createDataFrame([(i, [float(c) for c in row]) for i, row in enumerate(x)], "product_id long, vector array<double>").repartition(5)
    got = {(r.query_id, r["rank"]): r.product_id for r in vector_topk(v.where("product_id < 20").withColumnRenamed("product_id", "query_id"), v, 4, other=True).collect()}
    s = np.round(x[:20] @ x.T, 6)
    s[np.arange(20), np.arange(20)] = -9
    assert got == {(i, r + 1): int(j) for i in range(20) for r, j in enumerate(np.lexsort((np.arange(300), -s[i]))[:4])}


def test_no_cartesian_product_over_rows_in_search(spark):
    docs = spark.range(100).select(F.col("id").alias("product_id"), F.concat(F.lit("word"), "id").alias("text"))
    plan = rt.bm25_topk(docs.withColumnRenamed("product_id", "query_id"), docs)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan


def test_hooks(spark):
    df = spark.createDataFrame([("a b", "a c"), (None, "x"), ("a b", "a c")], "text string, rerank_text string")
    assert all(len(r.vector) == 64 for r in hooks.encode(df, "text", hooks.hashed_tokens).collect())
    assert [r.score for r in hooks.score_pairs(df, lambda q, d: [len(set(a.split()) & set(b.split())) / 2 for a, b in zip(q, d)]).collect()] == [0.5, 0.0, 0.5]
    assert df.select(hooks.tokenize("text", str.split).alias("t")).first().t == ["a", "b"]


def test_search_relaxes_a_budget_that_empties_the_list(spark):
    rows = [(1, "red ring", "a", "x", "ring", "d", 10.0, 10.0, "CNY", None), (2, "red bolt", "b", "x", "bolt", "d", 900.0, 900.0, "CNY", None), (3, "blue gear", "b", "y", "gear", "d", 5.0, 5.0, "CNY", "JP"), (4, "old rod", "b", "y", "rod", "d", 5.0, 5.0, "CNY", None), (5, "new rod", "b", "y", "rod", "d", 6.0, None, "USD", None)]
    catalog = spark.createDataFrame(rows, "product_id long, title string, brand string, category string, sub_category string, description string, base_price double, price_cny double, currency string, origin string")
    queries = spark.createDataFrame([(1, 7, "red"), (2, 7, "bolt under 20"), (3, 7, "zzz"), (4, 7, "red under 20"), (5, 7, "gear 不要日系"), (6, 7, "new under 9")], "query_id long, user_id long, text string")
    got = {}
    for r in se.search_relaxed(queries, catalog, keep=written).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.product_id, r.note))
    assert {k: sorted(v, key=str) for k, v in got.items()} == {1: [(1, 1, None), (2, 2, None)], 2: [(1, 2, "budget_relaxed")], 3: [(None, None, "no_match")], 4: [(1, 1, None)], 5: [(None, None, "no_match")], 6: [(1, 5, "budget_relaxed")]}


SHOP = "product_id long, title string, brand string, category string, sub_category string, description string, base_price double, price_cny double, currency string, origin string"


def test_search_filters_before_it_cuts(spark):
    rows = [(i, "blue bolt", "b", "x", "bolt", "d", 2000.0, 2000.0, "CNY", None) for i in range(40)] + [(i, "blue bolt", "b", "x", "bolt", "d", 900.0, 900.0, "CNY", None) for i in range(40, 60)] + [(i, "old rod", "b", "y", "rod", "d", 900.0, 900.0, "CNY", None) for i in range(60, 200)]
    queries = spark.createDataFrame([(1, 7, "blue bolt under 950")], "query_id long, user_id long, text string")
    catalog = spark.createDataFrame(rows, SHOP)
    assert sorted((r["rank"], r.product_id) for r in se.search(queries, catalog, keep=written).collect()) == [(i + 1, 40 + i) for i in range(5)]
    assert {r.note for r in se.search_relaxed(queries, catalog, keep=written).collect()} == {None}
    dense = spark.createDataFrame([(1, i, i + 1) for i in range(50)], "query_id long, product_id long, rank int")
    assert sorted(r.product_id for r in se.search(queries, catalog, keep=written, dense=dense).collect()) == list(range(40, 45))


def test_search_applies_brands_carried_filters_and_coverage(spark):
    rows = [(i, "red ring", b, "x", "ring", d, float(10 + i), float(10 + i), "CNY", o) for i, (b, d, o) in enumerate([("Acme", "d", "CN"), ("Acme", "wool", "CN"), ("Bolt", "d", "JP"), ("Bolt", "d", "JP"), ("Coil", "d", "US"), ("Coil", "d", None)])] + [(i, "old rod", "Dune", "y", "rod", "d", 9.0, 9.0, "CNY", None) for i in range(10, 20)]
    catalog = spark.createDataFrame(rows, SHOP)
    asked = [
        (1, "red ring", None, None, None, None, False), (2, "red ring Acme", None, None, None, None, False), (3, "red ring 不要 Bolt", None, None, None, None, False), (4, "red ring", ["wool"], None, None, None, False),
        (5, "red ring", None, ["Coil"], 14.0, None, False), (6, "red ring", None, ["Coil"], 14.0, None, True), (7, "red ring 国产", None, None, None, None, False), (8, "red ring Acme以外", None, None, None, None, False),
        (9, "red ring", ["日系"], None, None, None, False), (10, "red ring", None, None, None, [("Dune", "brand"), ("Acme", "brand")], False),
    ]
    queries = spark.createDataFrame([(q, 7, *r) for q, *r in asked], "query_id long, user_id long, text string, ex_keywords array<string>, brand_include array<string>, price_max double, entities array<struct<entity: string, kind: string>>, switched boolean")
    got = {}
    for r in se.search(queries, catalog, keep=written, k=9, brands={"Acme": [], "Bolt": [], "Coil": [], "Dune": []}).collect():
        got.setdefault(r.query_id, set()).add(r.product_id)
    every = set(range(6))
    assert got == {1: every, 2: {0, 1}, 3: {0, 1, 4, 5}, 4: every - {1}, 5: {4}, 6: every, 7: {0, 1, 5}, 8: {2, 3, 4, 5}, 9: every - {2, 3}, 10: every | {10}}


def test_search_relaxed_tells_what_exclusions_emptied(spark):
    catalog = spark.createDataFrame([(3, "blue gear", "b", "y", "gear", "d", 5.0, 5.0, "CNY", "JP")] + [(i, "old rod", "b", "y", "rod", "d", 5.0, 5.0, "CNY", None) for i in range(4, 9)], SHOP)
    queries = spark.createDataFrame([(1, 7, "gear 不要日系", None), (2, 7, "zzz 不要日系", None), (3, 7, "gear", 2.0)], "query_id long, user_id long, text string, price_max double")
    got = {r.query_id: (r.product_id, r.note, r.emptied) for r in se.search_relaxed(queries, catalog, keep=written).collect()}
    assert got == {1: (None, "no_match", [3]), 2: (None, "no_match", None), 3: (3, "budget_relaxed", None)}


def test_build_filter_guards_the_category(spark):
    pairs = spark.createDataFrame([("户外运动", "帐篷", "Acme"), ("美妆护肤", "防晒", "Bolt")], "category string, sub_category string, brand string")
    queries = spark.createDataFrame([(1, "户外 防晒"), (2, "户外 帐篷"), (3, "户外 Bolt"), (4, "户外 Acme"), (5, "户外")], "query_id long, text string")
    got = se.build_filter(queries, pairs, brands={"Acme": [], "Bolt": []}, sub_rules=[(["防晒"], ["防晒"]), (["帐篷"], ["帐篷"])])
    assert {r.query_id: r.want_category for r in got.collect()} == {1: None, 2: "户外运动", 3: None, 4: "户外运动", 5: "户外运动"}


def test_short_passages_and_parts_of_words_are_found_in_documents(spark):
    from tallymart.plans.search import holding

    docs = [(1, "one two three four five six seven eight nine ten eleven twelve"), (2, "two three"), (3, "ring"), (4, "xone two three four five six seven eight nine tens"), (5, None), (6, "Two Three"), (7, ""), (8, "a 蓝牙耳机 b 好 c d 红")]
    items = [(1, "two three"), (2, "three four five"), (3, "ring"), (4, "one two three four five six seven eight nine ten"), (5, "e t"), (6, "wo three fo"), (7, "absent"), (8, None), (9, "in"), (10, ""), (11, "牙耳机 b 好 c d"), (12, "Two Three")]
    got = holding(spark.createDataFrame(docs, "product_id long, text string"), spark.createDataFrame(items, "query_id long, text string")).collect()
    assert sorted((r.query_id, r.product_id) for r in got) == sorted((q, d) for q, p in items for d, t in docs if p is not None and t is not None and p in t)


def test_an_order_of_many_products_is_judged_whole(spark, tmp_path):
    from tallymart.plans.catalog import g3_dominant_category
    from tallymart.plans.events import e10_preference_rerank

    spark.range(1, 1501).selectExpr("1L AS l_orderkey", "id AS l_partkey").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(1, 1501).selectExpr("id AS p_partkey", "'old rod' AS p_name", "'Brand#9' AS p_brand", "CASE WHEN id <= 501 THEN 'SMALL' ELSE 'LARGE' END AS p_type", "1 AS p_size", "5.0D AS p_retailprice").write.parquet(f"{tmp_path}/part.parquet")
    assert [tuple(r) for r in g3_dominant_category(spark, str(tmp_path)).collect()] == [(1, "LARGE")]
    spark.range(3).selectExpr("id AS event_id", "timestamp '2024-01-01' AS ts", "1L AS user_id", "'click' AS event_type", "1.0D AS value", """concat('{"k": ', id + 1, '}') AS props""").write.parquet(f"{tmp_path}/events.parquet")
    assert "<= 1000000)" not in e10_preference_rerank(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()


def test_containment_and_price_slices(spark):
    wholes = spark.createDataFrame([("abcde",), ("xy",), ("",), (None,), ("abc",)], "whole string")
    parts = spark.createDataFrame([("bcd",), ("y",), ("xy",), ("abcdef",), ("",), (None,)], "part string")
    assert sorted(map(tuple, jn.containing(wholes, parts).collect())) == [("abcde", "bcd"), ("xy", "xy"), ("xy", "y")]
    filters = spark.createDataFrame([(1, None, 10.0, 20.0), (2, None, None, None), (3, "a", None, 15.0), (4, None, 30.0, 20.0), (5, None, 99.0, None), (6, None, None, -5.0)], "query_id long, want_category string, price_min double, price_max double")
    catalog = spark.createDataFrame([(1, "a", 10.0), (2, "b", 20.0), (3, "a", 20.5), (4, "b", None)], "product_id long, category string, base_price double")
    for slices in (1, 4, 256):
        assert sorted(map(tuple, jn.match_filters(filters, catalog, slices).collect())) == [(1, 1), (1, 2), (2, 1), (2, 2), (2, 3), (2, 4), (3, 1)]


def test_rates_as_of_carry_over_hours(spark):
    at = datetime(2024, 1, 1)
    events = spark.createDataFrame([(1, at + timedelta(minutes=30), "USD"), (2, at + timedelta(hours=5), "USD"), (3, at, "USD"), (4, at, "CNY"), (5, at - timedelta(minutes=1), "USD"), (6, at, None)], "id long, ts timestamp, currency string")
    quotes = spark.createDataFrame([("USD", at, 7.0), ("USD", at + timedelta(minutes=40), 7.5), ("EUR", at, 8.0)], "currency string, quoted_at timestamp, rate double")
    got = {r.id: (r.rate, r.stale) for r in jn.rate_asof(events, quotes).collect()}
    assert got == {1: (7.0, False), 2: (7.5, True), 3: (7.0, False), 4: (1.0, False), 5: (None, None), 6: (None, None)}


def test_settled_totals_round_each_line(spark):
    cart = spark.createDataFrame([(1, 0.35, "CNY", 1), (1, 0.35, "CNY", 1), (1, 2.0, "JPY", 3)], "user_id long, unit_price double, currency string, quantity long")
    pairs = spark.createDataFrame([("CNY", "USD", "0.1")], "currency string, target string, rate string").withColumn("rate", F.col("rate").cast("decimal(18,6)"))
    row = lc.settle_total(cart, pairs, "USD").first()
    assert (float(row.total), row.unresolved) == (0.08, 1)
    totals = lc.cart_totals(cart, spark.createDataFrame([("USD", 7.0)], "currency string, rate double")).first()
    assert (float(totals.total_cny), totals.unresolved, [(x.currency, float(x.total)) for x in totals.unresolved_totals]) == (0.7, 1, [("JPY", 6.0)])


def test_hybrid_keeps_allowed_pairs_only(spark):
    docs = spark.createDataFrame([(1, "red ring", [1.0, 0.0]), (2, "red bolt", [0.0, 1.0]), (3, "blue ring", [0.6, 0.8])], "product_id long, text string, vector array<double>")
    queries = spark.createDataFrame([(9, "red", [1.0, 0.0])], "query_id long, text string, vector array<double>")
    every = [r.product_id for r in se.hybrid_topk(queries, docs, 3).orderBy("rank").collect()]
    assert every[0] == 1 and set(every) == {1, 2, 3}
    allowed = spark.createDataFrame([(9, 2), (9, 3)], "query_id long, product_id long")
    assert {r.product_id for r in se.hybrid_topk(queries, docs, 3, allowed=allowed).collect()} == {2, 3}
