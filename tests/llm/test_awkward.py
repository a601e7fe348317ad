"""Cases that concern several operators: bytes that are not UTF-8, carried columns with clashing names, very long texts, the registered queries on the given tables."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymart.llm import langid, queries
from tallymart.llm.decontaminate import decontaminate
from tallymart.llm.line_dedup import line_dedup
from tallymart.llm.minhash import minhash_dedup
from tallymart.llm.packing import best_fit_packing
from tallymart.llm.quality import grade_documents, grade_of
from tallymart.llm.substring_dedup import substring_dedup
from tallymart.llm.suffix_dedup import suffix_dedup
from tallymart.llm.token_counts import token_counts

from . import brute

SF = "/root/testdata/sf0.001"
given = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


def test_bytes_that_are_not_utf8_stay_as_they_are(spark):
    import public_tokenizers

    words = " ".join(f"w{i}" for i in range(20)).encode()
    raw = [b"a line of some length \xff\n" + words, b"a line of some length \xff\nother", b"\xe4\xb8", words + b" \xfe"]
    docs = spark.createDataFrame([(i, bytearray(t)) for i, t in enumerate(raw)], "doc_id long, b binary").select("doc_id", F.col("b").cast("string").alias("text"))
    back = lambda df, c="kept": [bytes(r.b) for r in df.select("doc_id", F.col(c).cast("binary").alias("b")).orderBy("doc_id").collect()]
    assert back(line_dedup(docs, text=True)) == [raw[0], b"other", *raw[2:]]
    assert back(substring_dedup(docs)) == [b" ".join(raw[0].split()), b" ".join(raw[1].split()), raw[2], b"\xfe"]
    assert [r.n_bytes for r in suffix_dedup(docs).orderBy("doc_id").collect()] == [len(t) for t in raw]
    items = spark.createDataFrame([(1, "length other")], "item_id long, text string")
    assert minhash_dedup(docs).count() == decontaminate(docs, items).count() == 4
    assert {r.doc_id for r in best_fit_packing(docs, public_tokenizers.path("word_bpe_49k.json")).collect()} == {0, 1, 2, 3}
    assert token_counts(docs, public_tokenizers.path("word_bpe_49k.json")).count() == langid.identify(docs.withColumn("lang", F.lit("x")), docs.withColumn("lang", F.lit("x"))).count() == 4
    assert grade_documents(docs, spark.createDataFrame([(0, 0), (1, 1), (3, 1)], "doc_id long, grade int")).count() == 4


def test_carried_columns_named_like_results_are_left_out(spark):
    docs = brute.docs(spark, ["a b", "c d"]).select("doc_id", "text", "source", *(F.lit("x").alias(c) for c in ("score", "Accepted", "items", "hits", "keep", "n_lines")))
    names = ["doc_id", "source", "score", "Accepted", "items", "hits", "keep", "n_lines"]
    assert langid.identify(docs.withColumn("lang", F.lit("en")), docs.withColumn("lang", F.lit("en")), extra=names).columns == ["doc_id", "lang_pred", "score", "accepted", "source", "items", "hits", "keep", "n_lines"]
    assert line_dedup(docs, extra=names).columns == ["doc_id", "n_lines", "n_dropped", "keep", "source", "score", "Accepted", "items", "hits"]
    out = decontaminate(docs, spark.createDataFrame([(1, "a b")], "item_id long, text string"), extra=names)
    assert out.columns == ["doc_id", "n_words", "n_hit", "items", "hits", "contaminated", "source", "score", "Accepted", "keep", "n_lines"]
    assert sorted((r.doc_id, r.items, r.score) for r in out.collect()) == [(0, ["1"], "x"), (1, [], "x")]


def test_ratings_that_do_not_tell_give_no_grade(spark):
    rows = [(q, t) for q in (0, 1, None) for t in (0, 1, None)]
    got = spark.createDataFrame(rows, "quality int, toxic int").select("quality", "toxic", grade_of("quality", "toxic").alias("g")).collect()
    assert {(r.quality, r.toxic): r.g for r in got} == {(0, 0): 1, (0, 1): 0, (0, None): None, (1, 0): 2, (1, 1): 0, (1, None): None, (None, 0): None, (None, 1): 0, (None, None): None}


def test_very_long_texts(spark):
    r = np.random.default_rng(3)
    words = [f"w{i}" for i in range(4000)]
    long = " ".join(r.choice(words, 300_000))  # about 1.6 MB
    docs = brute.docs(spark, [long, long + " tail", "short text of the river", None, ""])
    got = {x.doc_id: (x.component_id, x.kept) for x in minhash_dedup(docs, 3, 85).collect()}
    assert got == {0: (0, True), 1: (0, False), 2: (2, True), 3: (3, True), 4: (4, True)}
    known = docs.withColumn("lang", F.when(F.col("doc_id") < 2, "a").otherwise("b"))
    assert {x.doc_id: x.lang_pred for x in langid.identify(known, known).collect()}[3] == "und"


@given
def test_registered_queries_equal_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.op3_minhash_dedup(spark, SF).collect())) == sorted(brute.near(rows))
    assert sorted(map(tuple, queries.op4_suffix_dedup(spark, SF).collect())) == sorted(brute.byte_strings(rows))
    assert sorted(map(tuple, queries.op1_substring_dedup(spark, SF).collect())) == sorted(brute.substring(rows))


@given
def test_registered_packing_holds_every_token_once(spark):
    import zlib

    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    pieces, total = {}, 0
    for r in queries.op6_packing(spark, SF).collect():
        pieces.setdefault(r.doc_id, []).append(r)
        total += r.length
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted(pieces[r.doc_id], key=lambda p: p.piece)
        assert [p.start for p in own] == list(range(0, len(ids), 2048)) and sum(p.length for p in own) == len(ids)
        assert all(p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in own)
    by_sequence = {}
    for p in sum(pieces.values(), []):
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for own in by_sequence.values():
        own.sort()
        assert [o for o, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1].tolist()] and sum(n for _, n in own) <= 2048
    assert len(by_sequence) <= -(-total // 2048) + 1


@given
def test_registered_models_on_held_out_rows(spark):
    larger = SF.replace("0.001", "0.01")
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{larger}/documents.parquet").collect()}
    held = [r for r in queries.op7_language_id(spark, larger).collect() if r.held_out and truth[r.doc_id]]
    assert len(held) > 200 and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.9
    toxic = {r.doc_id for r in spark.read.parquet(f"{larger}/labels.parquet").where("toxic = 1").collect()}
    kept = [r.doc_id for r in queries.op5_quality(spark, larger).where("kept").collect()]
    assert len(toxic) > 9 and len(toxic.intersection(kept)) < 0.3 * len(toxic)


@given
def test_quality_of_documents_whose_ratings_it_did_not_see(spark):
    from tallymart.llm.quality import grade_of

    largest = SF.replace("0.001", "0.1")
    ratings = spark.read.parquet(f"{largest}/labels.parquet").select("doc_id", grade_of("quality", "toxic").alias("grade"))
    truth = {r.doc_id: r.grade for r in ratings.where("grade is not null and doc_id % 3 = 0").collect()}
    got = {r.doc_id: r for r in grade_documents(spark.read.parquet(f"{largest}/documents.parquet"), ratings.where("doc_id % 3 > 0")).collect()}
    kept = [np.mean([got[i].kept for i, g in truth.items() if g == grade]) for grade in (0, 1, 2)]
    mean = [np.mean([got[i].expected_grade for i, g in truth.items() if g == grade and got[i].expected_grade is not None]) for grade in (0, 1, 2)]
    assert len(truth) > 1000 and kept[0] < 0.35 and kept[1] < 0.3 and kept[2] > 0.95 and mean[0] < mean[1] < mean[2]


@given
def test_registered_token_counts_equal_greedy_matching(spark):
    import public_tokenizers

    from tallymart.llm.token_counts import vocabulary

    pieces = set(vocabulary(public_tokenizers.path("word_bpe_49k.json")))
    longest, known = max(map(len, pieces)), {}

    def greedy(word):
        at = n = 0
        while at < len(word):
            at += next(k for k in range(min(longest, len(word) - at), 0, -1) if word[at : at + k] in pieces)
            n += 1
        return n

    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        words = (r.text or "").encode().lower().split()
        known[r.doc_id] = (len(words), sum(map(greedy, words)))
    assert {r.doc_id: (r.n_words, r.n_tokens) for r in queries.op8_token_counts(spark, SF).collect()} == known
