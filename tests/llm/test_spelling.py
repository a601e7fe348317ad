import os
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from tallymart.llm import queries, spelling
from tallymart.llm.spelling import numbered, spelling_variants, word_counts

from . import brute

SF = "/root/testdata/sf0.001"


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(counts, ratio=2):
    form, out = {}, {}
    for w in counts:
        own = [x for x in counts if near(w, x)]
        best = min(own, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= ratio * counts[w] else None
        out[w] = len(own)
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        yield w, form[w], root, counts[w], out[w], counts[form[w]] if form[w] else None


def counted(rows, slip=97):
    out = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if not h % slip:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                out[run] += 1
    return {w: n for w, n in out.items() if n >= 3}


def order(rows):
    return sorted(tuple(r) for r in rows)


def made(seed=2, n=400):
    r = np.random.default_rng(seed)
    words = {"".join(r.choice(list("abéÿ"), r.integers(1, 7))): int(r.integers(1, 200)) for _ in range(n)}
    return words | {"aaaa": 5, "aaaaa": 50, "aaa": 5, "é" * 300: 4, "é" * 299: 9, "é" * 150 + "a" + "é" * 149: 2, "漢字a": 3, "漢字b": 3, "x": 1}


@pytest.mark.parametrize("parts", [1, 7])
def test_equals_brute_force(spark, parts):
    words = made()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame([(w, n, "x", 1) for w, n in words.items()] + [("", 3, "x", 1), (None, 3, "x", 1)], "word string, n long, no string, part int")
        assert order(spelling_variants(df).collect()) == order(variants(words))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_equal_numbers_mean_equal_prefixes_over_all_ranges(spark):
    words = made(5)
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(6)
    for back in (False, True):
        of = {}
        for r in numbered(df, back).collect():
            own = r.word[::-1] if back else r.word
            real = [r.spine[c - (r.part << spelling.SHIFT)] if c - (r.part << spelling.SHIFT) < len(r.spine) else c for c in r.nodes]
            assert len(real) == len(own) + 1
            for i, c in enumerate(real):
                assert of.setdefault(c, own[:i]) == own[:i]
        assert len(of) == len(set(of.values()))


def test_counts_words_of_awkward_texts(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 5)
    texts = ["Étage étage ÉTAGE hello", "HELLO-hello hello1hello", None, "", "×÷×÷×", "a" * 2_000_000 + " hello", "hello " * 500, "hell hell hell", "漢字漢字漢字"] * 3
    ids = [None if i == 4 else i for i in range(len(texts))]
    docs = brute.docs(spark, texts, ids)
    assert {r.word: r.n for r in word_counts(docs, slip=3).collect()} == counted(zip(ids, texts), 3)
    assert word_counts(brute.docs(spark, [])).collect() == spelling_variants(word_counts(brute.docs(spark, []))).collect() == []


def test_long_words_stay_linear(spark):
    long = "ab" * 50_000
    rows = spelling_variants(spark.createDataFrame([(long, 3), (long[:-1], 7), ("x" + long[1:], 3)], "word string, n long")).collect()
    assert {(len(r.word), r.word[0]): (r.n_near, r.form_n) for r in rows} == {(100_000, "a"): (2, 7), (99_999, "a"): (1, None), (100_000, "x"): (1, None)}


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
def test_registered_query_equals_brute_force_and_sql(spark):
    got = order(queries.op12_spelling_variants(spark, SF).collect())
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert [r[:1] + r[3:4] for r in got] == sorted(counted(rows).items())
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert got == order(duck.sql(queries.ORACLE["op12_spelling_variants"]).fetchall())
