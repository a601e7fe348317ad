from pyspark.sql import functions as F

from tallymart.llm import decontaminate as module
from tallymart.llm.decontaminate import decontaminate

from . import brute


def bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string, doc_id string")


def items(texts):
    w = [t.split() for t in texts if t and len(t.split()) > 20][:6]
    return [(n * 7, " ".join(x[2 : 2 + n + 8]), "x") for n, x in enumerate(w)] + [(100, "漢é ß", "x"), (101, None, "x"), (None, "a b", "x"), (102, "!!", "x"), (103, "one", "x"), (9, " ".join(w[0][2:10]), "x")]


def result(df):
    return sorted(map(tuple, df.select("doc_id", "n_words", "n_hit", F.size("items"), F.sha2(F.array_join("items", ","), 256), "contaminated").collect()))


def test_equals_brute_force_in_one_and_in_several_automata(spark, monkeypatch):
    texts = brute.sample(4)
    rows, own = list(enumerate(texts)), items(texts)
    expected = sorted(brute.leaks(rows, [(i, t) for i, t, _ in own if i is not None and t]))
    assert sum(x[-1] for x in expected) > 1
    docs = brute.docs(spark, texts)
    assert result(decontaminate(docs, bench(spark, own))) == expected
    monkeypatch.setattr(module, "BLOCK_OF_ITEMS", 60)
    assert result(decontaminate(docs, bench(spark, own))) == expected


def test_offsets_point_into_the_original(spark):
    text = "Éa -- Alpha, BETA!gamma é x alpha beta"
    row = decontaminate(brute.docs(spark, [text]), bench(spark, [(1, "alpha beta gamma", "")])).first()
    assert [text[h.start : h.end] for h in row.hits] == ["Alpha, BETA!gamma"] and row.n_hit == 3


def test_empty_tables(spark):
    assert decontaminate(brute.docs(spark, []), bench(spark, [(1, "a", "")])).collect() == []
    assert not any(r.contaminated for r in decontaminate(brute.docs(spark, ["a b", None], [None, 2]), bench(spark, [])).collect())
