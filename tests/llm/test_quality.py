import random

import numpy as np

from tallymart.llm.quality import BUCKETS, fit, grade_documents

from . import brute


def table(spark, n=260):
    r = random.Random(4)
    rows, grades = [], []
    for i in range(n):
        words = [r.choice(["the", "of", "and", "tree", "river", "stone", "light"]) for _ in range(r.randint(3, 60))]
        grade = r.choice([0, 1, 2, 2, 2])
        if grade == 1:
            words = [w + r.choice(["%%%", "***"]) for w in words]
        if grade == 0:
            words[r.randrange(len(words))] = "nasty"
        rows.append(" ".join(words))
        grades.append((i, grade, "extra"))
    return brute.docs(spark, rows), spark.createDataFrame(grades, "doc_id long, grade int, text string"), {i: g for i, g, _ in grades}


def test_held_out_grades(spark):
    docs, ratings, truth = table(spark)
    got = {r.doc_id: r for r in grade_documents(docs, ratings.where("doc_id % 3 > 0")).collect()}
    held = [i for i in truth if i % 3 == 0]
    assert np.mean([got[i].kept == (truth[i] == 2) for i in held]) > 0.95
    mean = [np.mean([got[i].expected_grade for i in held if truth[i] == g]) for g in (0, 1, 2)]
    assert mean[0] < mean[1] < mean[2] and all(0 <= r.tail_prob <= r.expected_grade <= 2 for r in got.values())


def test_cuts_rise_and_fit_the_shares_without_features():
    grades = np.array([0] * 10 + [1] * 30 + [2] * 60 + [3] * 100)
    model = fit(np.arange(200), np.full(200, 7), grades, 3)
    assert (np.diff(model.cuts) > 0).all() and len(model.weights) == BUCKETS
    assert np.allclose(model.at_least(model.weights[[7]])[0], [0.95, 0.8, 0.5], atol=0.1)


def test_empty_tables_nulls_and_one_grade(spark):
    docs, ratings, _ = table(spark, 60)
    none = spark.createDataFrame([], "doc_id long, grade int")
    odd = brute.docs(spark, [None, "", "x" * 10_000, "the"], [None, 2, 2, 3])
    assert {(r.expected_grade, r.kept) for r in grade_documents(odd, none).collect()} == {(None, True)}
    assert {r.kept for r in grade_documents(docs, ratings.where("grade = 2")).collect()} == {True}
    assert grade_documents(brute.docs(spark, []), ratings).collect() == []
    both = docs.unionByName(brute.docs(spark, [None, "", "x" * 10_000], [None, 1000, 1000]))
    assert grade_documents(both, ratings).where("tail_prob is null").count() == 0
