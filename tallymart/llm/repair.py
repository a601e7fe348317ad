"""Operator 11, conversation structure repair: Hirschberg's divide and conquer over four states, in rows of a block and in blocks of a conversation."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, discard

#: States: nothing yet, after system, after user, after assistant. Where an inserted turn leads, and what ends a conversation well.
INSERTED = (2, 2, 3, 2)
ENDING = ((0, ""), (6, "II"), (3, "I"), (0, ""))
ROLES = {b"s": 1, b"u": 2, b"a": 3}
NEVER = 1 << 60
#: Rows and bytes of text of a block; blocks, or nodes of blocks, under one node.
ROWS, BYTES, FAN = 1024, 4 << 20, 1024

BLOCK_SQL = """block long, conv_id long, body int, turn long, role string, key string, roles array<binary>, texts array<binary>, codes binary, times array<long>, cost array<long>, rank array<long>,
 low long, high long, turns long, first_turn long, last_turn long, first_role binary, last_role binary, blank long, duplicate long, truncated long, illegal long"""
STATS = ["blank", "duplicate", "truncated", "illegal"]
RESULT_SQL = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def row_options(role: int, fault: int) -> dict:
    """{(state before, state after): (cost, edits)} of one row; role 1 to 3 is s, u, a; fault 1 is truncated, 2 a row that has to go."""
    out: dict = {}
    for start in range(4):
        state, edits, passed = start, "", [start]
        while True:
            after = INSERTED[state]
            options = [(4, state, "D")]
            if fault < 2:
                options.append((3 + 3 * fault, after, "R"))
                if role == 1 and state == 0 or role > 1 and role == after:
                    options.append((3 * fault, role, "K"))
            for cost, end, edit in options:
                out[start, end] = min(out.get((start, end), (NEVER, "")), (cost + 3 * len(edits), edits + edit))
            state, edits = after, edits + "I"
            if state in passed:
                break
            passed.append(state)
    return out


OPTIONS = {code: row_options(code % 4, code // 4) for code in range(12)}


def as_matrix(cells: dict) -> tuple:
    """(costs, ranks) by state before and after; ranks order the edits of equal state before."""
    costs = tuple(tuple(cells.get((s, e), (NEVER, ""))[0] for e in range(4)) for s in range(4))
    ranks = tuple(tuple(sorted(x for (a, _), (_, x) in cells.items() if a == s).index(cells[s, e][1]) if (s, e) in cells else 9 for e in range(4)) for s in range(4))
    return costs, ranks


MATRIX = {code: as_matrix(cells) for code, cells in OPTIONS.items()}


def forward(items: list, start: int) -> tuple[list, list]:
    """Least costs from `start` to each state over all items, and the order of the least edits that give them.

    Edits of different states never are one the beginning of the other: each ends by taking the last row, and between rows there
    are only inserted turns. So the order of what is behind decides, and the order within the item only for one state before.
    """
    costs, ranks = [NEVER] * 4, [9] * 4
    costs[start] = ranks[start] = 0
    for own, order in items:
        best = [min((costs[s] + own[s][e], ranks[s], order[s][e]) for s in range(4) if costs[s] < NEVER) for e in range(4)]
        costs = [min(c, NEVER) for c, _, _ in best]
        among = sorted(b[1:] for b in best if b[0] < NEVER)
        ranks = [among.index(b[1:]) if b[0] < NEVER else 9 for b in best]
    return costs, ranks


def backward(items: list, end: int) -> list:
    """Least costs from each state to `end`."""
    costs = [NEVER] * 4
    costs[end] = 0
    for own, _ in reversed(items):
        costs = [min(NEVER, *(own[s][e] + costs[e] for e in range(4))) for s in range(4)]
    return costs


def crossings(items: list, start: int, end: int) -> list[int]:
    """States after each item on the cheapest way, of equally cheap ones that with the ASCII-least edits.

    Costs from the front and from the back meet in the middle; the crossing with the least edits before it is taken, and
    both halves are solved alike. Space is linear in the items.
    """
    out, todo = [0] * len(items), [(0, len(items), start, end)]
    while todo:
        low, high, start, end = todo.pop()
        if high - low == 1:
            out[low] = end
            continue
        middle = (low + high) // 2
        costs, ranks = forward(items[low:middle], start)
        rest = backward(items[middle:high], end)
        _, _, state = min((costs[s] + rest[s], ranks[s], s) for s in range(4))
        todo += [(low, middle, start, state), (middle, high, state, end)]
    return out


def summary(items: list) -> tuple[list, list]:
    """Costs and ranks of several items as of one, in rows of four."""
    if not items:
        return [0 if s == e else NEVER for s in range(4) for e in range(4)], [0 if s == e else 9 for s in range(4) for e in range(4)]
    ways = [forward(items, s) for s in range(4)]
    return [c for costs, _ in ways for c in costs], [r for _, ranks in ways for r in ranks]


def matrix(cost: list, rank: list) -> tuple:
    return tuple(tuple(cost[4 * s : 4 * s + 4]) for s in range(4)), tuple(tuple(rank[4 * s : 4 * s + 4]) for s in range(4))


def best_end(costs: list, ranks: list) -> int:
    """The last state: cheapest with what it takes to end well, then least edits."""
    return min((costs[s] + ENDING[s][0], ranks[s], s) for s in range(4))[2]


@lru_cache(1 << 14)
def short_summary(codes: bytes) -> tuple[list, list]:
    return summary([MATRIX[c] for c in codes])


def edits_of(codes: bytes, start: int, end: int) -> list[tuple[int, str]]:
    """(state before, edits) of each row."""
    after = crossings([MATRIX[c] for c in codes], start, end) if codes else []
    return [(s, OPTIONS[c][s, e][1]) for c, s, e in zip(codes, [start, *after], after)]


@lru_cache(1 << 14)
def short_edits(codes: bytes) -> tuple[list[tuple[int, str]], int]:
    """Edits of a whole conversation, and the state after them."""
    end = best_end(*forward([MATRIX[c] for c in codes], 0))
    return edits_of(codes, 0, end), end


def apply(block: dict, edits: list[tuple[int, str]]) -> tuple[str, int, list[bytes]]:
    """Audit, cost and lines of a block's rows under these edits; further copies of a row go."""
    audit, cost, lines = [], 0, []
    for (state, edit), code, times, role, text in zip(edits, block["codes"], block["times"], block["roles"], block["texts"]):
        for e in edit[:-1]:
            lines.append(b"assistant:" if state == 2 else b"user:")
            state = INSERTED[state]
        last = edit[-1]
        if last != "D":
            lines.append((role if last == "K" else b"assistant" if state == 2 else b"user") + b":" + text)
            cost += 3 * (code // 4)
        audit.append(edit + "D" * (times - 1))
        cost += 3 * (len(edit) - 1) + {"K": 0, "R": 3, "D": 4}[last] + 4 * (times - 1)
    return "".join(audit), cost, lines


def closing(state: int) -> tuple[str, int, list[bytes]]:
    cost, audit = ENDING[state]
    return audit, cost, [b"user:", b"assistant:"][-len(audit) :] if audit else []


def legal(before: bytes | None, after: bytes | None) -> bool:
    return (before or b"") + (after or b"") in (b"su", b"ua", b"au")


def gaps(low, high, turns) -> int:
    return 0 if low is None else high - low + 1 - turns


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and times of the rows left by the damage of the contract: crc32("conv_id:turn") % 20, nulls read as one space.

    0 drops the row, 1 empties its text, 2 takes its [.!?], 3 doubles it (times), 4 makes its role user.
    """
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind = F.crc32(name.cast("binary")) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    return conversations.where(kind != 0).select("conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), text.alias("text"), F.when(kind == 3, 2).otherwise(1).cast("long").alias("times"))


def sorted_rows(rows: DataFrame, ids: DataFrame | None) -> DataFrame:
    """Rows by conversation and place in ranges, so that a long conversation spans tasks: one header each, equal rows as one with `times`, a marker before a row whose role and text an earlier turn has."""
    times = F.col("times") if "times" in rows.columns else F.lit(1)
    named = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), times.cast("long").alias("times"))
    tail = F.substring(F.rtrim("text", F.lit(" \t\n\x0b\f\r")), -1, 1)
    whole = named.groupBy("conv_id", "turn", "role", "text").agg(F.sum("times").alias("times"))
    whole = cut(whole.withColumn("key", F.md5(F.col("text").cast("binary"))).withColumn("is_blank", tail == "").withColumn("is_cut", ~tail.isin(".", "!", "?")))
    at = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"))
    told = whole.select("conv_id", "turn", "role", "key", at.alias("at"))
    again = told.groupBy("conv_id", "role", "key").agg(F.min("at").alias("first"), F.max("at").alias("last")).where("first != last").withColumnsRenamed({"conv_id": "c", "role": "r", "key": "k"})
    markers = told.join(again, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("key") == F.col("k"))).where("at > first").select("conv_id", "turn", "role", "key")
    heads = (named if ids is None else ids.select(F.col("conv_id").cast("long").alias("conv_id"))).select("conv_id").distinct()
    parts = [whole.withColumns({"body": F.lit(1), "mark": F.lit(1)}), markers.withColumns({"body": F.lit(1), "mark": F.lit(0)}), heads.withColumns({"body": F.lit(0), "mark": F.lit(1)})]
    met = parts[0].unionByName(parts[1], True).unionByName(parts[2], True)
    order = ["conv_id", "body", "turn", "role", "key"]
    texts = [F.col(c).cast("binary").alias(f"{c}_bytes") for c in ("role", "text")]
    return met.repartitionByRange(*order).sortWithinPartitions(*order, "mark").select(*order, "mark", "times", "is_blank", "is_cut", *texts)


def in_blocks(batches):
    """Cut each task's sorted rows into blocks of one conversation."""
    number, out, size = TaskContext.get().partitionId() << 32, [], 0
    block: dict | None = None
    marked = None

    def fresh(r):
        nonlocal number
        number += 1
        own = {n: None for n in NAMES} | {n: 0 for n in ("turns", *STATS)}
        return own | {"block": number, "conv_id": r["conv_id"], "body": r["body"], "turn": r["turn"], "role": r["role"], "key": r["key"], "roles": [], "texts": [], "codes": bytearray(), "times": [], "bytes": 0}

    def closed(b):
        b["codes"] = bytes(b["codes"])
        b["cost"], b["rank"] = short_summary(b["codes"]) if len(b["codes"]) <= 16 else summary([MATRIX[c] for c in b["codes"]])
        out.append(b)

    def handed():
        rows = pa.RecordBatch.from_pylist(out, schema=KINDS)
        out.clear()
        return rows

    for batch in batches:
        for r in batch.to_pylist():
            if block is not None and (block["conv_id"] != r["conv_id"] or len(block["codes"]) >= ROWS or block["bytes"] >= BYTES):
                size += block["bytes"] + 400
                closed(block)
                block = None
                if size > BYTES:
                    yield handed()
                    size = 0
            if not r["mark"]:
                marked = (r["conv_id"], r["turn"], r["role"], r["key"])
                continue
            block = block or fresh(r)
            if not r["body"]:
                continue
            again = marked == (r["conv_id"], r["turn"], r["role"], r["key"])
            initial, times, b = r["role_bytes"][:1], r["times"], block
            fault = 2 if r["is_blank"] or again else int(r["is_cut"])
            b["codes"].append(4 * fault + ROLES.get(initial, 0))
            b["times"].append(times)
            b["roles"].append(r["role_bytes"])
            b["texts"].append(r["text_bytes"])
            b["bytes"] += len(r["text_bytes"]) + len(r["role_bytes"])
            b["blank"] += times if r["is_blank"] else 0
            b["duplicate"] += 0 if r["is_blank"] else times if again else times - 1
            b["truncated"] += fault == 1
            b["illegal"] += times - 1 + (b["last_role"] is not None and not legal(b["last_role"], initial))
            b["first_role"] = initial if b["first_role"] is None else b["first_role"]
            b["last_role"] = initial
            if r["turn"] is not None:
                b["turns"] += b["last_turn"] != r["turn"]
                if b["low"] is None:
                    b["low"] = b["first_turn"] = r["turn"]
                b["high"] = b["last_turn"] = r["turn"]
    if block is not None:
        closed(block)
    if out:
        yield handed()


NAMES = [c.split()[0] for c in BLOCK_SQL.split(",")]
TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<binary>": pa.list_(pa.binary()), "array<long>": pa.list_(pa.int64())}
KINDS = pa.schema([(n, TYPES[t]) for n, t in (c.split() for c in BLOCK_SQL.split(","))])


def result_rows(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema([(n, TYPES[t]) for n, t in (c.split() for c in RESULT_SQL.split(", "))]))


def whole_ones(batches):
    """Results of conversations that are one block."""
    for batch in batches:
        out = []
        for b in batch.to_pylist():
            codes = b["codes"]
            if len(codes) <= 16:
                edits, end = short_edits(codes)
            else:
                end = best_end(b["cost"][:4], b["rank"][:4])
                edits = edits_of(codes, 0, end)
            parts = [apply(b, edits), closing(end)]
            lines = parts[0][2] + parts[1][2]
            out.append({n: b[n] for n in ("conv_id", *STATS)} | {"gaps": gaps(b["low"], b["high"], b["turns"]), "cost": parts[0][1] + parts[1][1], "audit": parts[0][0] + parts[1][0], "repaired_sha256": hashlib.sha256(b"\n".join(lines)).hexdigest()})
        yield result_rows(out)


def applied(batches):
    """Audit, cost and lines of blocks whose first and last state are known."""
    for batch in batches:
        out = []
        for b in batch.to_pylist():
            audit, cost, lines = apply(b, edits_of(b["codes"], b["start"], b["end"]))
            out.append({n: b[n] for n in PART_NAMES if n in b} | {"audit": audit, "paid": cost, "lines": b"\n".join(lines) if lines else None})
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([(n, TYPES[t]) for n, t in (c.split() for c in PART_SQL.split(", "))]))


PART_SQL = "conv_id long, idx long, end long, audit string, paid long, lines binary, low long, high long, turns long, first_turn long, last_turn long, first_role binary, last_role binary, blank long, duplicate long, truncated long, illegal long"
PART_NAMES = [c.split()[0] for c in PART_SQL.split(", ")]


def joined(batches):
    """Stream the blocks of conversations in order: texts go through a hash, audits are put together."""
    own = None

    def done(x):
        audit, cost, lines = closing(x["end"])
        for line in lines:
            add(x, line)
        return {n: x[n] for n in ("conv_id", *STATS)} | {"gaps": gaps(x["low"], x["high"], x["turns"]), "cost": x["cost"] + cost, "audit": "".join([*x["audit"], audit]), "repaired_sha256": x["hash"].hexdigest()}

    def add(x, lines):
        x["hash"].update((b"\n" if x["any"] else b"") + lines)
        x["any"] = True

    for batch in batches:
        for b in batch.to_pylist():
            if own is None or own["conv_id"] != b["conv_id"]:
                if own is not None:
                    yield result_rows([done(own)])
                own = {"conv_id": b["conv_id"], "hash": hashlib.sha256(), "any": False, "cost": 0, "audit": [], "low": None, "high": None, "turns": 0, "last_role": None, **dict.fromkeys(STATS, 0)}
            own["audit"].append(b["audit"])
            own["cost"] += b["paid"]
            own["end"] = b["end"]
            if b["lines"] is not None:
                add(own, b["lines"])
            for n in STATS:
                own[n] += b[n]
            if b["first_role"] is not None:
                own["illegal"] += own["last_role"] is not None and not legal(own["last_role"], b["first_role"])
                own["last_role"] = b["last_role"]
            if b["low"] is not None:
                own["turns"] += b["turns"] - (own["high"] == b["first_turn"])
                own["low"], own["high"] = b["low"] if own["low"] is None else own["low"], b["high"]
    if own is not None:
        yield result_rows([done(own)])


def block_states(nodes: DataFrame) -> DataFrame:
    """(conv_id, idx, block, start, end) of the blocks (conv_id, idx, block, cost, rank) of conversations: up to one node a conversation, and down again, each node crossing its children as a block does its rows."""

    def combine(table):
        rows = sorted(table.to_pylist(), key=lambda r: r["idx"])
        cost, rank = summary([matrix(r["cost"], r["rank"]) for r in rows])
        return pa.Table.from_pylist([{"conv_id": rows[0]["conv_id"], "idx": rows[0]["idx"] // FAN, "cost": cost, "rank": rank}], schema=pa.schema([("conv_id", TYPES["long"]), ("idx", TYPES["long"]), ("cost", TYPES["array<long>"]), ("rank", TYPES["array<long>"])]))

    def split(table):
        rows = sorted(table.to_pylist(), key=lambda r: r["idx"])
        after = crossings([matrix(r["cost"], r["rank"]) for r in rows], rows[0]["start"], rows[0]["end"])
        out = [{"conv_id": r["conv_id"], "idx": r["idx"], "start": s, "end": e} for r, s, e in zip(rows, [rows[0]["start"], *after], after)]
        return pa.Table.from_pylist(out, schema=pa.schema([(n, TYPES["long"]) for n in ("conv_id", "idx", "start", "end")]))

    def top(batches):
        for batch in batches:
            rows = [{"conv_id": r["conv_id"], "idx": r["idx"], "start": 0, "end": best_end(r["cost"][:4], r["rank"][:4])} for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([(n, TYPES["long"]) for n in ("conv_id", "idx", "start", "end")]))

    up = F.floor(F.col("idx") / FAN).cast("long")
    levels = [nodes]
    while levels[-1].where("idx > 0").limit(1).count():
        levels.append(cut(levels[-1].select("conv_id", "idx", "cost", "rank", up.alias("node")).groupBy("conv_id", "node").applyInArrow(combine, "conv_id long, idx long, cost array<long>, rank array<long>")))
    states = cut(levels[-1].mapInArrow(top, "conv_id long, idx long, start long, end long"))
    for level in reversed(levels[:-1]):
        above = states.withColumnsRenamed({"conv_id": "c", "idx": "node"})
        below = level.select("conv_id", "idx", "cost", "rank", up.alias("of")).join(above, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("of") == F.col("node")))
        states = cut(below.select("conv_id", "idx", "cost", "rank", "of", "start", "end").groupBy("conv_id", "of").applyInArrow(split, "conv_id long, idx long, start long, end long"))
    discard(*levels[1:])
    return states


def repair_conversations(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Find faults of conversations and their cheapest repair to `(s?(ua)+)?`, s, u and a being the initials of roles.

    rows: conv_id, turn, role, text, and perhaps times (so many copies, one after another); ids: conversations to return though they have no rows (conv_id).
    Returns conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 for each conversation.
    Keep costs 0, Rerole to user or assistant 3, Delete 4, Insert an empty user or assistant 3, and a truncated row that stays 3; blank and duplicate rows are deleted. The audit
    holds the edits' initials; of equally cheap ones the ASCII-least is taken.

    Null roles and texts read as one space, a null conv_id is a conversation of its own, null turns come first. Rows
    of one turn are ordered by role, then by the MD5 of their text, copies behind each other. A role of other or no
    initial fits nowhere: it is reroled or deleted. Extra columns are ignored; no rows and no ids give no rows.

    Rows are sorted in ranges, so a conversation may span tasks. A task cuts its rows into blocks of up to 1024 rows, each with its
    least costs between any two states; blocks of a conversation are joined under nodes of up to 1024, and
    first and last states handed down. Only the hash, which has to see a conversation's lines one after another, streams a
    conversation of several blocks through one task, a block at a time; its audit, a letter per row, is one string.
    """
    blocks = cut(sorted_rows(rows, ids).mapInArrow(in_blocks, BLOCK_SQL))
    w = Window.partitionBy("conv_id")
    idx = F.row_number().over(w.orderBy("body", "turn", "role", "key")) - 1
    several = blocks.groupBy("conv_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("conv_id").alias("c"))
    nodes = cut(blocks.join(several, F.col("conv_id").eqNullSafe(F.col("c"))).select("conv_id", idx.cast("long").alias("idx"), "block", "cost", "rank"))
    if not nodes.limit(1).count():
        return blocks.mapInArrow(whole_ones, RESULT_SQL)
    states = block_states(nodes)
    at = nodes.select("block", "idx", F.col("conv_id").alias("c")).join(states.select(F.col("conv_id").alias("d"), F.col("idx").alias("i"), "start", "end"), F.col("c").eqNullSafe(F.col("d")) & (F.col("idx") == F.col("i")))
    at = cut(at.select("block", "idx", "start", "end"))
    parts = blocks.join(at, "block").mapInArrow(applied, PART_SQL)
    long_ones = parts.repartition("conv_id").sortWithinPartitions("conv_id", "idx").mapInArrow(joined, RESULT_SQL)
    return blocks.join(at, "block", "left_anti").select(*NAMES).mapInArrow(whole_ones, RESULT_SQL).unionByName(long_ones)
