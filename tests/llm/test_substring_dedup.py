from pyspark.sql import functions as F

from tallymart.llm import queries
from tallymart.llm.substring_dedup import substring_dedup

from . import brute


def result(df):
    return sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")).collect())


def test_equals_brute_force(spark):
    for seed in (1, 2):
        texts = brute.sample(seed)
        ids = [(7 * i) % 101 - 20 for i in range(len(texts))]
        assert result(substring_dedup(brute.docs(spark, texts, ids))) == sorted(brute.substring(list(zip(ids, texts))))


def test_spans_are_maximal_and_match_the_kept_text(spark):
    shared = " ".join(f"w{i}" for i in range(20))
    rows = substring_dedup(brute.docs(spark, [shared, "a b " + shared + " c", shared + " x " + shared])).orderBy("doc_id").collect()
    assert [[tuple(s) for s in r.removed] for r in rows] == [[], [(2, 22)], [(0, 20), (21, 41)]]
    assert [r.kept for r in rows] == [shared, "a b c", "x"]


def test_empty_table_null_id_and_repeated_row(spark):
    assert substring_dedup(brute.docs(spark, [])).collect() == []
    long = " ".join(f"w{i}" for i in range(30))
    rows = substring_dedup(brute.docs(spark, [long, long, long, long], [None, 4, 4, 9])).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_removed) for r in rows) == [(-1, 0), (4, 0), (4, 0), (9, 30)]


def test_query_on_the_given_table(spark, tmp_path):
    brute.docs(spark, brute.sample(5)).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op1_substring_dedup(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(brute.substring(list(enumerate(brute.sample(5)))))
