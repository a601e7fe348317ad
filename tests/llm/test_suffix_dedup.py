import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallymart.llm import cover, suffix_dedup as module
from tallymart.llm.suffix_dedup import suffix_dedup

from . import brute


def result(df):
    return sorted(map(tuple, df.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_suffixes_come_in_order(seed, monkeypatch):
    monkeypatch.setattr(cover, "BATCH", 50)
    r = np.random.default_rng(seed)
    text = r.integers(97, 99, 700, np.uint8) if seed < 3 else np.full(400, 97, np.uint8)
    text[100:200], text[300:400] = text[:100].copy(), text[:100].copy()
    raw = text.tobytes()
    at = np.arange(len(text))
    got = np.concatenate([own for own, _ in cover.suffix_buckets(text, at)])
    assert got.tolist() == sorted(at, key=lambda p: raw[p:])


@pytest.mark.parametrize("hot", [20_000, 2])
def test_equals_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(module, "HOT", hot)
    for seed in (1, 6):
        texts = brute.sample(seed, vocabulary=60) + ["abc" * 60, "xabc" + "abc" * 50, "b" * 49, "b" * 50, "b" * 200, "é" * 40, "x" + "é" * 40]
        ids = [(11 * i) % 97 - 9 for i in range(len(texts))]
        assert result(suffix_dedup(brute.docs(spark, texts, ids))) == sorted(brute.byte_strings(list(zip(ids, texts))))


def test_long_texts_are_cut_with_overlap(spark, monkeypatch):
    monkeypatch.setattr(module, "SEGMENT", 64)
    texts = brute.sample(7, n=30, vocabulary=40)
    assert result(suffix_dedup(brute.docs(spark, texts))) == sorted(brute.byte_strings(list(enumerate(texts))))


def test_empty_table_null_id_and_repeated_rows(spark):
    assert suffix_dedup(brute.docs(spark, [])).collect() == []
    text = "The quick brown fox jumps over the lazy dog, and once more."
    rows = suffix_dedup(brute.docs(spark, [text] * 4, [None, 2, 2, 3])).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in rows) == [(0, 0), (2, 0), (2, 0), (3, len(text))]
    with pytest.raises(ValueError):
        suffix_dedup(brute.docs(spark, []), 10)


def test_equal_hashes_of_different_bytes_remove_nothing():
    data = np.frombuffer(b"a" * 60 + b"b" * 60 + b"a" * 60, np.uint8)
    place, length, doc = np.array([0, 60, 120]), np.array([60, 60, 60]), np.array([1, 2, 3])
    assert module.copies(data, place, length, np.array([7, 7, 7], np.uint64), doc).tolist() == [False, False, False]
    assert module.copies(data, place, length, np.array([7, 8, 7], np.uint64), doc).tolist() == [False, False, True]
    assert module.copies(data, place, np.array([60, 60, 52]), np.array([7, 8, 7], np.uint64), doc).tolist() == [False, False, False]
    sent = pa.table({"what": [3], "ids": [np.array([5], np.int64).tobytes()], "counts": [np.array([2], np.int64).tobytes()], "gaps": [np.array([3], np.int64).tobytes()], "text": [b"x" * 52]})
    assert module.same_bytes(sent, {5: b"..x" + b"x" * 60}, 50) == {5: [(2, 3)]} and module.same_bytes(sent, {5: b"..y" + b"x" * 60}, 50) == {}
