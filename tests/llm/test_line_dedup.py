import zlib

import numpy as np
from pyspark.sql import functions as F

from tallymart.llm.line_dedup import line_dedup

from . import brute

LINES = ["A shared line of text", "  a SHARED line of text\t", "short", "Éé漢字Éé漢字Éé", "éé漢字Éé漢字Éé", "another passage here", "another passage here \r", ""]


def texts():
    import random

    r = random.Random(3)
    out = ["\n".join(r.choice(LINES + [f"own line number {i}"]) for _ in range(r.randint(1, 9))) for i in range(50)]
    return out + ["", None, "\n\n", out[0], out[0], "x" * 5000 + "\n" + LINES[0], None]


def test_equals_brute_force(spark):
    own = texts()
    ids = [(11 * i) % 59 - 9 for i in range(len(own))]
    got = line_dedup(brute.docs(spark, own, ids), text=True).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got)) == sorted(brute.lines(list(zip(ids, own))))


def test_bitmap_tells_the_kept_lines(spark):
    got = {r.doc_id: r for r in line_dedup(brute.docs(spark, ["one long line\nb", "one long line\nsome other line\none long line"])).collect()}
    bits = np.unpackbits(np.frombuffer(zlib.decompress(got[1].keep), np.uint8))[:3]
    assert bits.tolist() == [0, 1, 0] and got[0].n_dropped == 0


def test_empty_table_null_id_and_repeated_rows(spark):
    assert line_dedup(brute.docs(spark, [])).collect() == []
    rows = line_dedup(brute.docs(spark, ["one long line\nb"] * 4, [None, 3, 3, 8])).collect()
    assert sorted((r.doc_id or 0, r.n_dropped) for r in rows) == [(0, 0), (3, 0), (3, 0), (8, 1)]


def test_a_hot_line_over_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        own = [f"the very same line\nline of number {i}" for i in range(300)]
        rows = line_dedup(brute.docs(spark, own).repartition(16)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.doc_id: r.n_dropped for r in rows} == {i: int(i > 0) for i in range(300)}
