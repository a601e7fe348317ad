import random

import numpy as np
from pyspark.sql import functions as F

from tallymart.llm.langid import gram_buckets, held_out, identify, learn

from . import brute

SYLLABLES = {"aa": ["tha", "ing", "ed", "ou"], "bb": ["ção", "lho", "eis", "na"], "cc": ["sch", "ung", "ei", "ß"]}


def table(spark, n=150):
    r = random.Random(1)
    rows = []
    for i in range(n):
        lang = r.choice(list(SYLLABLES))
        text = " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 3))) for _ in range(r.randint(5, 60)))
        rows.append((i, text, lang, "s", None, "x", 1))
    return spark.createDataFrame(rows, brute.DOCS), {r[0]: r[2] for r in rows}


def test_grams_stay_inside_words():
    found, counts = gram_buckets(["ab", "c", "漢字かな"])
    assert counts.tolist() == [3 + 2 + 1, 2 + 1, 5 + 4 + 3]
    assert found[:6].tolist() == gram_buckets(["ab"])[0].tolist() and found[6:9].tolist() == gram_buckets(["c"])[0].tolist()


def test_held_out_accuracy_and_rejection(spark):
    docs, truth = table(spark)
    mine = docs.withColumn("held_out", held_out())
    assert 20 < mine.where("held_out").count() < 60
    model = learn(mine.where("not held_out"))
    got = {r.doc_id: r for r in identify(docs, mine.where("not held_out")).collect()}
    assert np.mean([got[i].lang_pred == lang for i, lang in truth.items()]) > 0.98
    assert np.mean([got[i].accepted for i in truth]) > 0.95 and 0 <= model.least <= 0.5
    assert all(0 <= r.score <= 1 for r in got.values())


def test_awkward_texts_and_empty_tables(spark):
    docs, _ = table(spark)
    odd = brute.docs(spark, [None, "", "123 ... !!", "thaing ed", "thaing ed"], [None, 1, 2, 3, 3])
    got = [(r.doc_id, r.lang_pred, r.accepted) for r in identify(odd, docs).orderBy(F.col("doc_id").asc_nulls_first()).collect()]
    assert got[:3] == [(None, "und", False), (1, "und", False), (2, "und", False)] and {g[1] for g in got[3:]} == {"aa"}
    assert identify(brute.docs(spark, []), docs).collect() == []
    assert {r.lang_pred for r in identify(docs, brute.docs(spark, [])).collect()} == {"und"}
