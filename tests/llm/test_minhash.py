import random

import pytest

from tallymart.llm import minhash
from tallymart.llm.components import components
from tallymart.llm.minhash import minhash_dedup

from . import brute


def texts():
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    out = []
    for _ in range(6):
        base = [r.choice(vocabulary) for _ in range(r.randint(60, 150))]
        for _ in range(12):  # near copies, many close to the limit
            own = list(base)
            for _ in range(r.randint(0, 6)):
                own[r.randrange(len(own))] = r.choice(vocabulary)
            out.append(" ".join(own))
    out += [" ".join(r.choice(vocabulary) for _ in range(r.randint(1, 80))) for _ in range(30)]
    out += ["", None, "a", "A", "a b", "a B", "a b c", "a b c a b c", out[0].upper(), out[0], out[0], " \n"]
    r.shuffle(out)
    return out


@pytest.mark.parametrize("block", [2048, 7])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    own = texts()
    ids = [(7 * i) % 211 - 30 for i in range(len(own))]
    got = sorted(map(tuple, minhash_dedup(brute.docs(spark, own, ids), 3, 85).collect()))
    expected = sorted(brute.near(list(zip(ids, own))))
    assert got == expected and sum(not x[3] for x in expected) > 20


def test_empty_table_null_id_and_repeated_rows(spark):
    assert minhash_dedup(brute.docs(spark, [])).collect() == []
    rows = minhash_dedup(brute.docs(spark, ["a b c d e f"] * 4, [None, 5, 5, 2])).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in rows) == [(0, 0, True), (2, 2, True), (5, 2, False), (5, 2, False)]


def test_components_of_a_chain_a_star_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (None, 3), (3, 2)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)}


def test_a_chain_of_near_copies_is_one_group(spark):
    """Each text is linked with the next one only: no centre links to all, so buckets are compared in blocks."""
    words = [f"w{i}" for i in range(400)]
    own = [" ".join(words[i * 8 : i * 8 + 130]) for i in range(30)]
    own = [own[i] for i in random.Random(2).sample(range(30), 30)]
    got = sorted(map(tuple, minhash_dedup(brute.docs(spark, own), 3, 85).collect()))
    assert got == sorted(brute.near(list(enumerate(own)))) and {g[2] for g in got} == {0}
