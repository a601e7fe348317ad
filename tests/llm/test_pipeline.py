import corpus_pipeline

from . import brute


def table(spark, path):
    import random

    r = random.Random(9)
    words = ["the", "of", "and", "river", "stone", "light", "tree", "water", "old", "that", "in", "by"]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(30, 80))) for _ in range(60)]
    leak = " ".join(f"item{i}" for i in range(12))
    texts[7] += " " + leak
    texts[20] = texts[3] + " end"
    texts[30] += "\nA line that two documents share"
    texts[31] += "\na line that two documents share "
    texts += [None, "", "123 456", "A line that two documents share"]
    rows = [(i, t, "en" if i % 2 else "fr", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)] + [(None, "of the river and that tree", "en", "s", 26)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return texts


def test_each_stage_keeps_its_contract(spark, tmp_path):
    texts = table(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_duplicates", "decontamination", "packing"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = {r.doc_id: r for r in docs.collect()}
        gone = {r.doc_id for r in before.collect()} - set(kept[name])
        if name == "language_id":
            assert gone >= {60, 61, 62} and len(gone) < 6
        if name == "line_dedup":
            assert gone == set() and kept[name][63].text == "" and kept[name][31].text == texts[31].split("\n")[0] and kept[name][31].n_chars == len(kept[name][31].text)
        if name == "near_duplicates":
            assert gone == {20}
        if name == "decontamination":
            assert gone == {7}
    assert None in kept["decontamination"]
    pieces = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in pieces.collect()} == set(kept["decontamination"])


def test_empty_table(spark, tmp_path):
    brute.docs(spark, []).select(*corpus_pipeline.COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
