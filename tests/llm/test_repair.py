import hashlib
import os
import random
import re
import zlib

import duckdb
import pytest

from tallymart.llm import queries, repair
from tallymart.llm.repair import damaged, repair_conversations

SCHEMA = "conv_id long, turn long, role string, text string, times string, block long, code int"
SF = "/root/testdata/sf0.01"


def damage(rows):
    for c, t, role, text in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if k:
            row = (c, t, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)
            yield from [row] * (1 + (k == 3))


def plain(rows, ids):
    """Every audit by dynamic programming over whole strings."""
    for c in ids:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))
        seen, faults = set(), []
        for _, _, role, text in own:
            body = text.rstrip(" \t\n\x0b\f\r")
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [r[2][:1] for r in own]
        turns = [r[1] for r in own if r[1] is not None]
        best = {"": (0, "", ())}  # by roles so far, short form

        def put(to, key, way):
            if key not in to or way[:2] < to[key][:2]:
                to[key] = way

        def follow(key, i):  # roles so far: '', 's', '..u', '..a'
            return {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}[key].get(i)

        def grow(ways):
            for _ in range(3):
                for key, (cost, audit, lines) in list(ways.items()):
                    for role in ("user", "assistant"):
                        if to := follow(key, role[0]):
                            put(ways, to, (cost + 3, audit + "I", (*lines, f"{role}:")))
            return ways

        for (_, _, role, text), fault in zip(own, faults):
            after = {}
            for key, (cost, audit, lines) in grow(dict(best)).items():
                put(after, key, (cost + 4, audit + "D", lines))
                if fault in ("", "truncated"):
                    extra = 3 if fault else 0
                    if to := follow(key, role[:1]):
                        put(after, to, (cost + extra, audit + "K", (*lines, f"{role}:{text}")))
                    for other in ("user", "assistant"):
                        if to := follow(key, other[0]):
                            put(after, to, (cost + 3 + extra, audit + "R", (*lines, f"{other}:{text}")))
            best = after
        cost, audit, lines = min((w for key, w in grow(dict(best)).items() if key in ("", "a")), key=lambda w: w[:2])
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        yield (c, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def made(seed, conversations=60, most=9):
    r = random.Random(seed)
    rows = []
    for c in [None, *range(conversations)]:
        for t in range(r.randint(0, most)):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = r.choice(["Yes.", "No!", "Why?  \n", "cut", "", " \t", None, "Ends. \x0b", "é漢.", f"Turn {t}.", f"Turn {t}"])
            rows.append((c, r.choice([t, t, t + r.randint(0, 3), None]), role, text))
    return rows + rows[:5]


def order(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)


@pytest.mark.parametrize("seed, rows, fan", [(1, 1024, 1024), (2, 2, 2), (3, 1, 3)])
def test_equals_dynamic_programming_in_blocks_of_any_size(spark, monkeypatch, seed, rows, fan):
    monkeypatch.setattr(repair, "ROWS", rows)
    monkeypatch.setattr(repair, "FAN", fan)
    data = made(seed)
    ids = {r[0] for r in data}
    df = frame(spark, data)
    assert order(repair_conversations(damaged(df), df).collect()) == order(plain(list(damage(data)), ids))


def test_sql_gives_the_same(spark):
    data = made(7)
    df = frame(spark, data)
    duck = duckdb.connect()
    duck.sql("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    duck.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", data)
    assert order(repair_conversations(damaged(df), df).collect()) == order(duck.sql(queries.ORACLE["op11_conversation_repair"]).fetchall())


def test_long_conversation_long_text_and_copies(spark):
    r = random.Random(4)
    rows = [(5, t, r.choice(["user", "assistant", "system"]), r.choice(["Yes.", "no", f"Turn {t}."])) for t in range(5000)]
    rows += [(6, 1, "user", "A" * 3_000_000 + "."), (6, 2, "assistant", "Yes.")] + [(7, 1, "user", "Same.")] * 3000
    whole = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = repair_conversations(whole).collect()
    assert order(got) == order(plain(rows, {5, 6, 7}))


def test_conversation_without_rows_and_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair_conversations(empty).collect() == []
    nothing = hashlib.sha256(b"").hexdigest()
    assert [tuple(r) for r in repair_conversations(empty, spark.createDataFrame([(3,)], "conv_id long")).collect()] == [(3, 0, 0, 0, 0, 0, 0, "", nothing)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
def test_registered_query(spark):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    assert order(queries.op11_conversation_repair(spark, SF).collect()) == order(plain(list(damage(rows)), {r[0] for r in rows}))
