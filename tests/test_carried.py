"""Filters carried over conversations into a search; folds and sketches that add up."""

import numpy as np
from pyspark.sql import functions as F

from tallymart.operators import evaluation as ev
from tallymart.operators import lifecycle as lc
from tallymart.operators import search as se
from tallymart.operators.conversation import conversation_filter
from tallymart.plans.base import written

TURNS = "conv_id long, turn long, role string, text string"
INFERRED = (("数码电子", ("耳机",)),)


def test_explicit_values_and_inferred_words(spark):
    turns = spark.createDataFrame([(1, 0, "user", "推荐防晒霜 100元以内, 喜欢Acme"), (1, 1, "assistant", "..."), (1, 2, "user", "便宜的"), (2, 0, "user", "耳机"), (3, 0, "user", "headphones")], TURNS)
    explicit = spark.createDataFrame([(1, "家居家具", None, ["Bolt"], ["acme"], None)], "conv_id long, category string, sub_category string, include_brands array<string>, exclude_brands array<string>, price_max double")
    rules = [(("防晒",), ("防晒霜",))]
    rows = {r.conv_id: r for r in conversation_filter(turns, {"Acme": [], "Bolt": []}, sub_rules=rules, inferred=INFERRED).collect()}
    assert rows[1].sub_categories == ["防晒霜"] and rows[1].brand_include == ["Acme"] and rows[1].price_max == 100
    assert rows[2].category == rows[3].category == "数码电子"
    over = {r.conv_id: r for r in conversation_filter(turns, {"Acme": [], "Bolt": []}, sub_rules=rules, inferred=INFERRED, explicit=explicit).collect()}
    assert (over[1].category, over[1].sub_categories, over[1].brand_include, over[1].brand_exclude, over[1].price_max) == ("家居家具", None, ["Bolt"], ["acme"], 100)
    assert over[2] == rows[2]


def test_search_of_conversations(spark):
    kinds = "product_id long, title string, brand string, category string, sub_category string, description string, base_price double, price_cny double, currency string, origin string"
    rows = [(i, f"防晒霜 {i}", "Acme" if i % 2 else "Bolt", "美妆护肤", "防晒霜", "", 50.0 * i, 50.0 * i, "CNY", "CN") for i in range(1, 7)] + [(10 + i, f"蓝牙耳机 {i}", "Coil", "数码电子", "耳机", "", 90.0, 90.0, "CNY", "CN") for i in range(3)]
    catalog = spark.createDataFrame(rows, kinds)
    turns = [
        (1, 0, "user", "推荐防晒霜 200元以内"), (1, 1, "assistant", "好"), (1, 2, "user", "不要Acme"),  # both hold
        (2, 0, "user", "推荐防晒霜 200元以内"), (2, 1, "user", "蓝牙耳机"),  # another topic: nothing is held
        (3, 0, "user", "推荐防晒霜"), (3, 1, "user", "便宜的"),
    ]
    asked = dict(brands={"Acme": [], "Bolt": [], "Coil": []}, inferred=INFERRED, lines=("蓝牙",))
    got = {}
    users = spark.createDataFrame([(i, i) for i in (1, 2, 3)], "conv_id long, user_id long")
    for r in se.conversation_search(spark.createDataFrame(turns, TURNS), catalog, users, keep=written, **asked).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.product_id)
    assert set(got[1]) == {2, 4} and set(got[2]) == {10, 11, 12} and got[3] == [1, 2, 3, 4, 5]
    queries = {r.query_id: r for r in se.conversation_queries(spark.createDataFrame(turns, TURNS), catalog, **asked).collect()}
    assert [queries[i].switched for i in (1, 2, 3)] == [False, True, False] and queries[1].price_max == 200


def test_one_new_day_and_one_late_day_equal_the_full_fold(spark, tmp_path):
    r = np.random.default_rng(3)
    rows = [(i, int(r.integers(0, 4)), 1 if r.random() < 0.7 else -1, f"2024-01-{1 + int(d):02d} {int(h):02d}:00:00") for i, (d, h) in enumerate(zip(r.integers(0, 6, 900), r.integers(0, 24, 900)))]
    likes = spark.createDataFrame([(i, p % 2, p, s, t) for i, p, s, t in rows], "id long, user_id long, product_id long, signal int, t string").withColumn("ts", F.col("t").cast("timestamp")).drop("t")
    catalog = spark.createDataFrame([(p, f"b{p % 2}", "c", "s") for p in range(4)], "product_id long, brand string, category string, sub_category string")
    day = F.date_format("ts", "yyyy-MM-dd")
    stored = lc.fold_table(spark, str(tmp_path / "folds"), lc.preference_folds(likes.where((day < "2024-01-06") & ((day != "2024-01-03") | (F.col("id") % 3 == 0))), catalog))
    for late in ("2024-01-06", "2024-01-03"):
        new = lc.preference_folds(likes.where(day == late), catalog)
        assert lc.replace_days(stored, new, {late}) == {late}
    full = sorted(tuple(x) for x in lc.preference_scores(likes, catalog).collect())
    assert sorted(tuple(x) for x in lc.scores_of(stored.rows()).collect()) == full and len({x[-1] for x in full}) > 1


def test_rolled_up_quantiles_are_within_the_bound(spark):
    r = np.random.default_rng(1)
    values = r.lognormal(3, 1, 20_000)
    rows = spark.createDataFrame([(["a", "b"][i % 2], int(i), float(v)) for i, v in enumerate(values)], "kind string, i long, ms double").withColumn("ts", F.timestamp_seconds(1_700_000_000 + F.col("i") * 9))
    got = {x.kind: x for x in ev.rolled_latency(ev.latency_sketches(rows, "ms", ["kind"], "ts"), ["kind"]).collect()}
    for n, kind in enumerate("ab"):
        own = np.sort(values[n::2])
        assert got[kind].n == len(own) and abs(got[kind].max - own[-1]) < 1e-9 and abs(got[kind]["mean"] - own.mean()) < 1e-5
        for share in (0.5, 0.95, 0.99):
            rank = np.searchsorted(own, got[kind][f"p{round(100 * share)}"]) / len(own)
            assert abs(rank - share) <= ev.SKETCH_ERROR
    assert ev.rolled_latency(ev.latency_sketches(rows, "ms", ["kind"], "ts"), ["kind"], "1 day").count() >= 4
